"""Logical tables derived from the driver's tables, for Spark and as SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: Expressions that both engines read: what a retrieval source found for a query.
HITS = [
    "event_id", "ts", "user_id % 40 AS query_id",
    "CASE WHEN event_id % 3 = 0 THEN concat('BGE ', 100 + event_id % 17, ' II ', event_id % 11, ' E. ', event_id % 5) ELSE concat('Art. ', event_id % 59 + 1, ' Abs. ', event_id % 3, ' ', CASE event_id % 5 WHEN 0 THEN 'OR' WHEN 1 THEN 'ZGB' WHEN 2 THEN 'StGB' WHEN 3 THEN 'StPO' ELSE 'BGG' END) END AS citation",
    "CASE WHEN event_id % 3 = 0 THEN 'court' ELSE 'law' END AS kind",
    "CASE event_id % 7 WHEN 0 THEN 'dense' WHEN 1 THEN 'bm25' WHEN 2 THEN 'gpt_full' WHEN 3 THEN 'gpt_specific' WHEN 4 THEN 'gpt_case' WHEN 5 THEN 'court_dense' ELSE 'cocitation' END AS source",
    "CAST(event_id * 7919 % 1000 AS DOUBLE) / 1000 AS score", "event_id % 4 AS freq",
    "CASE WHEN event_id % 7 = 0 THEN event_id % 150 + 1 END AS dense_rank", "CASE WHEN event_id % 7 = 1 THEN event_id % 150 + 1 END AS bm25_rank",
    "CASE WHEN event_id % 7 = 5 THEN event_id % 150 + 1 END AS court_dense_rank", "event_id % 97 = 0 AS is_explicit", "event_id % 89 = 0 AS is_query_case",
]
CITED = [
    "l_orderkey", "l_linenumber", "(l_orderkey * 10 + l_linenumber) * 100000000 + l_partkey * 1000 + l_suppkey % 1000 AS pos", "l_orderkey % 40 AS query_id", "l_quantity", "l_tax",
    "CASE WHEN l_partkey % 3 = 0 THEN concat('BGE ', 100 + l_suppkey % 50, ' II ', l_orderkey % 400, ' E. ', l_linenumber) ELSE concat('Art. ', l_partkey % 300 + 1, ' Abs. ', l_linenumber, ' ', CASE l_partkey % 5 WHEN 0 THEN 'OR' WHEN 1 THEN 'ZGB' WHEN 2 THEN 'StGB' WHEN 3 THEN 'StPO' ELSE 'BGG' END) END AS citation",
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr(*HITS)


def cited(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").selectExpr(*CITED)


def gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hits(spark, sf_dir).where("score >= 0.8").select("query_id", "citation").distinct()


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """42 query ids, of which two have no hits."""
    return spark.range(42).withColumnRenamed("id", "query_id")


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(variant, query_id, citation) of five variants, each fed by some of the sources."""
    rows = hits(spark, sf_dir).where("score >= 0.55")
    fed = F.expr("CASE source WHEN 'dense' THEN array(0, 3) WHEN 'bm25' THEN array(0, 1, 4) WHEN 'gpt_full' THEN array(1, 2) WHEN 'gpt_specific' THEN array(2, 3) WHEN 'gpt_case' THEN array(0, 3, 4) WHEN 'court_dense' THEN array(1, 4) ELSE array(2) END")
    return rows.select(F.explode(fed).alias("variant"), "query_id", "citation").distinct()


def run(spark: SparkSession, sf_dir: str, variant: int) -> DataFrame:
    return runs(spark, sf_dir).where(F.col("variant") == variant).select("query_id", "citation")


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fused candidates with kind, estimate and rank."""
    from lexquarry.functions import text as fn
    from lexquarry.operators import fusion

    rows = fusion.fuse(hits(spark, sf_dir)).withColumn("kind", F.when(fn.is_law(F.col("citation")), "law").otherwise("court"))
    rows = rows.withColumn("final_score", F.round(fusion.boosted(F.col("raw_score"), F.size("sources")), 6)).withColumn("estimate", F.col("query_id") % 30 + 3)
    return fusion.ranked(rows.withColumn("score", F.col("final_score"))).withColumnRenamed("rank", "baseline_rank")


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text", F.when(F.col("lang") == "de", "law").otherwise("court").alias("kind"))


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


WITH_HITS = f"WITH hits AS (SELECT {', '.join(HITS)} FROM events)"
WITH_CITED = f"WITH cited AS (SELECT {', '.join(CITED)} FROM lineitem)"
GOLD = "gold AS (SELECT DISTINCT query_id, citation FROM hits WHERE score >= 0.8)"
IDS = "queries AS (SELECT range AS query_id FROM range(42))"
RUNS = """runs AS (SELECT DISTINCT unnest(CASE source WHEN 'dense' THEN [0, 3] WHEN 'bm25' THEN [0, 1, 4] WHEN 'gpt_full' THEN [1, 2] WHEN 'gpt_specific' THEN [2, 3] WHEN 'gpt_case' THEN [0, 3, 4] WHEN 'court_dense' THEN [1, 4] ELSE [2] END) AS variant, query_id, citation FROM hits WHERE score >= 0.55)"""
FUSED = "fused AS (SELECT query_id, citation, max(score) AS raw_score, list_sort(list(DISTINCT source)) AS sources, max(freq) AS freq, min(dense_rank) AS dense_rank, min(bm25_rank) AS bm25_rank, min(court_dense_rank) AS court_dense_rank, bool_or(is_explicit) AS is_explicit, bool_or(is_query_case) AS is_query_case FROM hits GROUP BY ALL)"
CANDIDATES = FUSED + """, boosted AS (SELECT *, CASE WHEN citation LIKE 'Art.%' THEN 'law' ELSE 'court' END AS kind, query_id % 30 + 3 AS estimate,
  round(CASE WHEN len(sources) >= 3 THEN least(least(raw_score * 1.25, 0.96) * 1.35, 0.98) WHEN len(sources) >= 2 THEN least(raw_score * 1.25, 0.96) ELSE raw_score END, 6) AS final_score FROM fused),
candidates AS (SELECT *, final_score AS score, row_number() OVER (PARTITION BY query_id ORDER BY final_score DESC, citation) AS baseline_rank FROM boosted)"""


def register(sql: str | None = None):
    """Registers a query under its function's name, with its SQL for DuckDB."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add
