"""The registered queries of the corpus operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexquarry.llm import near_dup

    return near_dup.find(spark, documents(spark, sf_dir)).select("doc_id", "n_shingles", "component_id", "kept")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from lexquarry.llm.token_count import count_tokens

    out = count_tokens(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)
    return out.select("doc_id", "n_bytes", "n_tokens", "over_limit")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexquarry.llm import decontaminate

    return decontaminate.leaks(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexquarry.llm import fingerprint

    return fingerprint.fingerprints(spark, documents(spark, sf_dir))


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from lexquarry.llm import token_files

    files = token_files.write(spark, documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"), end=2)
    return token_files.digests(*files).select("doc_id", "start", "n_tokens", "ids_crc32")


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexquarry.llm import license_scan

    return license_scan.scan_licenses(documents(spark, sf_dir)).drop("text")


def op5_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexquarry.llm import main_text

    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return main_text.main_text(pages, main_text.learn(pages)).select("page_id", "url", "text", "n_chars")


def op6_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from lexquarry.llm.bpe_codec import encode_digests

    out = encode_digests(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return out.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexquarry.llm import labelled, toxicity

    docs, labels = documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.Model.fit(labelled.sample(docs, labels.where(labelled.fold("doc_id", 5) != 0), "toxic"))
    scored = toxicity.score_toxicity(docs, model)
    return scored.select("doc_id", (labelled.fold("doc_id", 5) == 0).alias("held_out"), "score", "predicted", "spans")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexquarry.llm import labelled, quality

    docs, labels = documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality.Model.fit(labelled.sample(docs, labels.where(labelled.fold("doc_id", 3) != 1), "quality"))
    return quality.score_quality(docs, model).select("doc_id", (labelled.fold("doc_id", 3) == 1).alias("held_out"), "score", "predicted")


def op11_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexquarry.llm import katz, labelled

    fold = labelled.fold("doc_id", 7)
    scored, model = katz.evaluate(spark, documents(spark, sf_dir), fold != 2, tables=False)  # nothing but these texts is scored
    tokens = F.lit(model.tokens).cast("long").alias("train_tokens")
    return scored.select("doc_id", (fold == 2).alias("held_out"), "n_tokens", "n_known", tokens, "base_score", "score")


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexquarry.llm import whitening

    return whitening.whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexquarry.llm import collocations

    return collocations.collocations(spark, spark.read.parquet(f"{sf_dir}/documents.parquet").select("text", "lang"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and name[2].isdigit()}


def oracle_sql() -> dict[str, str]:
    return {}
