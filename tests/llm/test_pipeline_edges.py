"""The pipeline on empty tables, nulls, repeats and extra columns."""

import hashlib

import corpus_pipeline


def _tables(spark, folder, documents, labels=(), benchmark=()):
    spark.createDataFrame(documents, "doc_id long, text string, lang string, score string, row string").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int, note string").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(benchmark, "item_id long, text string, score int").write.parquet(f"{folder}/benchmark.parquet")


def test_empty_tables(spark, tmp_path):
    _tables(spark, tmp_path, [])
    assert corpus_pipeline.run(spark, str(tmp_path)).columns == ["doc_id", "token_ids", "n_tokens", "decoded_sha256"]
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_nulls_repeats_and_extra_columns(spark, tmp_path):
    """Without labels nothing is rejected; copies and what holds an item go; a row without an id stays as it is."""
    item = "It was a bright cold day in April, and the clocks were striking thirteen."
    rows = [(1, "Some text of a few words.", "en", "a", "x"), (1, "Some text of a few words.", "en", "a", "x"), (2, "some TEXT of a few words.", None, None, None), (3, None, "en", "c", "y"), (4, "", "en", "d", "z"), (None, "no id", "en", "e", "w"), (5, f"before {item} after", "en", "f", "v"), (6, "word " * 30_000, "en", "g", "u")]
    _tables(spark, tmp_path, rows, [(None, 1, 0, "x"), (77, None, None, "y")], [(1, item, 3), (2, None, 4), (None, "", 5)])
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, str(tmp_path))
        assert kept.columns == docs.columns, name
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert set(got) == {1, 3, 4, 6, None}
    text = {d: t or "" for d, t, *_ in rows}
    assert all(r.decoded_sha256 == hashlib.sha256(text[d].encode()).hexdigest() and r.n_tokens == len(r.token_ids) for d, r in got.items())
