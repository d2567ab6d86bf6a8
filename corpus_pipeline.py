"""The corpus pipeline: toxicity, quality, near duplicates, decontamination, token ids.

Each stage takes (spark, docs, sf_dir) and works on all that the one before has
kept.  The first four return documents with all of their columns; the last one
returns the ids of each document and the digest of what they decode to.

A null text counts as empty in every stage; it is neither toxic, nor a copy, nor
a leak.  Without labels, or with one only, the first two stages keep what their
models say of nothing: all documents without labels.  Rows that repeat a doc_id
count as one document from the third stage on; a row without a doc_id stays.  An
empty table of documents gives an empty result, an empty benchmark no leaks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexquarry.llm import bpe_codec, decontaminate, labelled, near_dup, quality, toxicity
from lexquarry.sources.scratch import scratch


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.without_toxic(docs, toxicity.Model.fit(labelled.sample(docs, labels, "toxic")))


def with_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.with_quality(docs, quality.Model.fit(labelled.sample(docs, labels, "quality")))


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dup.one_of_each(spark, docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    coded = bpe_codec.encode_ids(docs.select("doc_id", "text"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return coded.select("doc_id", "token_ids", F.size("token_ids").cast("long").alias("n_tokens"), "decoded_sha256")


STAGES = [
    ("toxicity", without_toxic),
    ("quality", with_quality),
    ("near duplicates", without_near_duplicates),
    ("decontamination", without_benchmark),
    ("token ids", token_ids),
]
#: The models and the sketches have no SQL form; tests/llm hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, files, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), scratch(spark), None
    for name, stage in STAGES:
        docs = files.keep(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
        if before is not None:
            files.drop(before)
        before = docs
    return docs
