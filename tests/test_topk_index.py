"""The segmented index against the exhaustive search, and tables that grow by batches."""

import uuid

import pytest
from pyspark.sql import functions as F

from lexquarry.operators import retrieval, topk_index
from lexquarry.operators.topk_index import TopkIndex
from lexquarry.sources.committed import Committed, Conflict, append_rest

SF = "/root/testdata/sf0.01"


def _path(tmp_path):
    return f"file://{tmp_path}/{uuid.uuid4().hex}"


def _ranked(rows):
    return sorted((r["query_id"], r["doc_id"], r["score"], r["rank"]) for r in rows.collect())


def test_equal_to_exhaustive_after_additions_and_merge(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    asked = spark.read.parquet(f"{SF}/benchmark.parquet").selectExpr("item_id AS query_id", "text AS query").where("item_id < 8")
    index = TopkIndex(spark, _path(tmp_path))
    seen = [index.add(docs.where(w), n) for n, w in (("a", "lang = 'en'"), ("b", "lang IN ('en', 'fr')"), ("c", "true"), ("d", "true"))]
    assert sum(seen) == docs.count() and seen[-1] == 0
    want = {k: _ranked(retrieval.top_k(retrieval.bm25(docs, asked), k)) for k in (1, 20)}
    found = index.search(asked, 1)
    assert _ranked(found.ranking) == want[1]
    blocks, read = found.blocks.agg(F.sum("blocks"), F.sum("read")).first()
    assert read < blocks
    assert _ranked(index.search(asked, 20).ranking) == want[20]
    index.merge(["b", "c"], "m")
    assert [b["name"] for b in index.table.batches()] == ["a", "m"]
    assert _ranked(index.search(asked, 20).ranking) == want[20]


def test_edges(spark, tmp_path):
    index = TopkIndex(spark, _path(tmp_path))
    asked = spark.createDataFrame([(1, "alpha beta"), (2, None), (3, "zeta")], "query_id long, query string")
    assert _ranked(index.search(asked, 3).ranking) == []
    rows = [(1, "alpha alpha beta"), (2, None), (3, ""), (4, "beta"), (None, "alpha"), (5, "alpha beta gamma")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert index.add(docs.where("doc_id < 4"), "a") == 3 and index.add(docs, "b") == 2
    named = docs.where("doc_id IS NOT NULL")
    assert _ranked(index.search(asked, 2).ranking) == _ranked(retrieval.top_k(retrieval.bm25(named, asked), 2))
    with pytest.raises(ValueError):
        index.merge(["a", "x"], "m")
    with pytest.raises(ValueError):
        TopkIndex(spark, _path(tmp_path), retrieval.Bm25(idf="okapi"))
    assert topk_index.RANGE > 0


def test_counts_within_a_row(spark):
    rows = [(1, "b a b ab AB"), (2, None), (3, "1 2")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    cfg = retrieval.Bm25(longer_than=0)
    asked = spark.createDataFrame([("b",), ("ab",)], "term string")
    got = {r["doc_id"]: (r["dl"], [tuple(t) for t in r["terms"]]) for r in retrieval.counted(docs, None, cfg).collect()}
    assert got == {1: (5, [("a", 1), ("ab", 2), ("b", 2)]), 2: (None, []), 3: (0, [])}
    got = {r["doc_id"]: [tuple(t) for t in r["terms"]] for r in retrieval.counted(docs, asked, cfg).collect()}
    assert got[1] == [("ab", 2), ("b", 2)]


def test_batches_are_published_whole(spark, tmp_path):
    table = Committed(spark, _path(tmp_path))
    rows = lambda n: spark.range(n).withColumnRenamed("id", "query_id")
    assert table.read() is None
    assert append_rest(rows(5), table, "a") == 5 and append_rest(rows(9), table, "b") == 4 and append_rest(rows(9), table, "c") == 0
    assert table.append(rows(3), "a") is False
    # what a killed writer leaves in the folder is not there for readers
    rows(100).write.parquet(f"{table.path}/data/{uuid.uuid4().hex}")
    assert sorted(r[0] for r in table.read().select("query_id").collect()) == list(range(9))
    with pytest.raises(ValueError, match="which the input lacks"):
        append_rest(rows(7), table, "d")
    with pytest.raises(ValueError, match="without"):
        append_rest(rows(2).selectExpr("CAST(NULL AS LONG) AS query_id"), table, "e")
    with pytest.raises(Conflict):
        table._publish(2, [])
    assert [b["name"] for b in table.batches()] == ["a", "b"]


def test_no_table_grows_with_documents_times_queries(spark, tmp_path, monkeypatch):
    """As many queries as there may be, nothing has a row for each query, term and range; queries in several groups give the same rows."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").where("doc_id % 3 = 0")
    one = spark.read.parquet(f"{SF}/benchmark.parquet").where("item_id < 2").selectExpr("item_id", "text AS query")
    asked = one.crossJoin(spark.range(12)).selectExpr("item_id * 100 + id AS query_id", "query")
    index = TopkIndex(spark, _path(tmp_path))
    index.add(docs, "a")
    kept, keep = {}, topk_index.scratch(spark).__class__.keep

    def counted(self, df, name, *rest, **more):
        out = keep(self, df, name, *rest, **more)
        kept[name] = max(kept.get(name, 0), out.count())
        return out

    monkeypatch.setattr(topk_index.scratch(spark).__class__, "keep", counted)
    got = _ranked(index.search(asked, 3).ranking)
    assert max(n for name, n in kept.items() if name not in ("bounds", "index")) <= max(kept["bounds"], kept["weights"])
    monkeypatch.setattr(retrieval, "ASKED", 200)
    assert _ranked(index.search(asked, 3).ranking) == got == _ranked(retrieval.top_k(retrieval.bm25(docs, asked), 3))
