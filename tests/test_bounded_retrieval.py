"""Searches that leave a task with what may be among the best only, against all pairs."""

import pyarrow as pa
import pytest

from lexquarry.operators import retrieval
from lexquarry.operators.retrieval import Bm25

SF = "/root/testdata/sf0.01"


def _rows(df):
    return sorted(map(tuple, df.select("query_id", "doc_id", "score", "rank").collect()))


@pytest.mark.parametrize(("cfg", "scope"), [(Bm25(), None), (Bm25(), ["lang"]), (Bm25(idf="okapi"), None)])
def test_best_of_tasks_are_the_best(spark, cfg, scope):
    """with k, a task returns what may be among the best, with the same ranking; few pairs leave it."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    asked = spark.read.parquet(f"{SF}/benchmark.parquet").selectExpr("item_id AS query_id", "text AS query").where("item_id < 8")
    every, best = retrieval.bm25(docs, asked, cfg, scope), retrieval.bm25(docs, asked, cfg, scope, k=5)
    assert _rows(retrieval.top_k(best, 5)) == _rows(retrieval.top_k(every, 5))
    assert best.count() < every.count() // 4


def test_best_of_few_and_repeated_documents(spark):
    asked = spark.createDataFrame([(1, "alpha beta"), (2, None), (3, "zeta"), (4, "alpha alpha")], "query_id long, query string")
    rows = [(1, "alpha alpha beta"), (2, None), (3, ""), (4, "beta"), (None, "alpha"), (5, "alpha beta gamma")]
    for more in ([], [(5, "beta beta")]):
        docs = spark.createDataFrame(rows + more, "doc_id long, text string")
        for cfg in (Bm25(), Bm25(idf="okapi")):
            got, want = (sorted(map(str, retrieval.top_k(retrieval.bm25(docs, asked, cfg, k=k), 3).collect())) for k in (3, None))
            assert got == want and got


def test_batches_of_vector_blocks_are_bounded(spark):
    """a task that multiplies blocks holds a few of them at once."""
    vectors = spark.range(40_000).selectExpr("id AS key", "transform(sequence(1, 64), i -> CAST((id * i) % 97 AS FLOAT) / 97) AS embedding").repartition(1)
    retrieval.dense_top_k(vectors.where("key % 4000 = 0").withColumnRenamed("key", "query_id"), vectors, 3)
    sizes = retrieval.packed(vectors, "key", retrieval.VECTORS).coalesce(1).mapInArrow(lambda bs: (pa.RecordBatch.from_pydict({"n": pa.array([b.nbytes])}) for b in bs), "n long")
    assert max(r.n for r in sizes.collect()) < 8 << 20


def test_passages_of_asked_orders_only(spark):
    """only the orders that are asked for are gathered, as they are among all."""
    from lexquarry.plans.retrieval import passages

    only = spark.createDataFrame([(1,), (2,), (34,), (-5,)], "doc_id long")
    want = {r.doc_id: r.text for r in passages(spark, SF).where("doc_id IN (1, 2, 34, -5)").collect()}
    assert {r.doc_id: r.text for r in passages(spark, SF, only).collect()} == want and want
