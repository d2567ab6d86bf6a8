"""The pipeline's stages on the smallest tables."""

import corpus_pipeline
from lexquarry.llm import registry

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, bench = docs.columns, [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    sizes = [docs.count()]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r.doc_id for r in docs.collect()}
        stage(spark, docs, SF).write.parquet(str(tmp_path / str(i)))
        docs = spark.read.parquet(str(tmp_path / str(i)))
        assert {r.doc_id for r in docs.collect()} <= before
        sizes.append(docs.count())
        assert i == len(corpus_pipeline.STAGES) - 1 or docs.columns == columns
        if i == 3:
            assert not any(b in r.text for r in docs.collect() for b in bench)
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] == sizes[-2] > 0
    assert docs.columns == ["doc_id", "token_ids", "n_tokens", "decoded_sha256"]


def test_registry(spark):
    assert sorted({int(n[2:].split("_")[0]) for n in registry.queries()}) == list(range(1, 11))
    documents = {r.doc_id for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for name, query in registry.queries().items():
        rows = query(spark, SF).collect()
        if name not in ("op1_decontamination", "op5_main_text"):
            assert {r.doc_id for r in rows} == documents
