"""The pipeline's generations as rows of a configuration table.

What a source's hit is worth, how agreement lifts it, how many siblings of a
decision follow, and where the list is cut, differ by generation; all of them
run in one job, each candidate keyed by (generation, query_id).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexquarry.functions import text as fn
from lexquarry.operators import fusion

SCHEMA = """generation string, dense double, dense_top int, dense_lift double, bm25 double, bm25_top int, bm25_div double,
 law double, law_else double, court double, court_else double, by_freq boolean, explicit double, explicit_fuzzy double, explicit_else double,
 siblings int, parents int, sibling_share double, sibling_flat double, counted array<string>, two double, two_cap double, three double, three_cap double, boost string, ranks array<struct<upto int, worth double>>, rank_else double, verify string, cut string"""
ANY, FOUR = ["*"], ["dense", "bm25", "gpt_full", "gpt_specific"]
NONE = 1e9
#: What a decision's best dense rank is worth, up to each rank.
V8_RANKS, V11_RANKS = [(20, 0.68), (50, 0.60), (100, 0.52)], [(10, 0.72), (25, 0.66), (50, 0.58), (100, 0.50)]
#: Fixed values of the generations; a null means that a generation has no such source or drops such hits.
ROWS = [
    ("v1", None, 0, 1.0, 1.0, 30, 15.0, 0.9, 0.8, 0.9, 0.8, False, 0.95, None, None, None, 15, 0.4, None, ["bm25", "court_dense"], 1.5, NONE, 1.0, NONE, "none", None, None, "none", "c1:0.10:15:60"),
    ("v2", None, 0, 1.0, 0.7, 20, 15.0, 0.95, 0.85, 0.85, 0.5, False, 0.98, None, 0.98, None, None, 0.4, None, [], 1.0, NONE, 1.0, NONE, "none", None, None, "after", "c1:0.15:15:55"),
    ("v3", None, 0, 1.0, 0.7, 40, None, 0.9, None, 0.85, 0.45, False, 0.95, None, 0.95, 20, None, 0.35, None, [], 1.0, NONE, 1.0, NONE, "bm25", None, None, "before", "c1:0.12:15:55"),
    ("v4", 0.75, 20, 1.2, 0.7, 60, None, 0.9, None, 0.85, 0.45, False, 0.95, None, 0.95, 20, None, 0.35, None, ["dense", "bm25"], 1.25, 0.95, 1.0, NONE, "all", None, None, "before", "c2"),
    ("v5", 1.0, 0, 1.0, 1.0, 80, None, 1.0, None, 1.0, 1.0, False, 1.0, None, 1.0, 15, None, None, 1.0, [], 1.0, NONE, 1.0, NONE, "none", None, None, "before", "c3"),
    ("v6", 0.65, 10, 1.3, 0.65, 80, None, 0.88, 0.40, 0.85, None, False, 0.95, None, 0.95, 15, None, 0.30, None, FOUR, 1.2, 0.95, 1.3, 0.98, "none", None, None, "before", "c4"),
    ("v7", 0.65, 10, 1.3, 0.65, 80, None, None, None, None, None, True, 0.95, 0.93, None, 15, None, 0.30, None, ANY, 1.25, 0.96, 1.35, 0.98, "none", None, None, "before", "c5"),
    ("v8", 0.65, 10, 1.3, 0.65, 80, None, None, None, None, None, True, 0.95, 0.93, None, 3, None, None, 0.50, ANY, 1.25, 0.96, 1.35, 0.98, "none", V8_RANKS, 0.42, "before", "c6"),
    ("v11", 0.65, 10, 1.3, 0.65, 80, None, None, None, None, None, True, 0.95, 0.93, 0.95, 15, None, 0.30, None, ANY, 1.25, 0.96, 1.35, 0.98, "none", V11_RANKS, 0.44, "before", "c5"),
]
#: What specific articles and cases are worth.
SPECIFIC, SPECIFIC_FUZZY, CASE = 0.92, 0.88, 0.85


def table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ROWS, SCHEMA)


def run_score(kind: Column, freq: Column, state: Column) -> Column:
    """Score of a citation by the runs that name it; one found by its key or in its decision is worth less or a constant."""
    law = F.least(F.lit(0.80) + freq * 0.05, F.lit(0.95)) - F.when(state == "fuzzy", 0.05).otherwise(0.0)
    court = F.when(state == "sibling", 0.70).when(state == "fuzzy", 0.85).otherwise(F.least(F.lit(0.78) + freq * 0.05, F.lit(0.93)))
    return F.when(kind == "law", law).otherwise(court)


def hit_score() -> Column:
    """What a hit is worth in its generation, null if nothing.

    A hit has source, kind, score, rank, freq, the best keyword score of its query
    and state: known, fuzzy, sibling or unknown, by how the corpus resolves its citation.
    """
    known, fuzzy = F.col("state") == "known", F.col("state").isin("fuzzy", "sibling")
    dense = F.col("score") * F.col("dense") * F.when(F.col("rank") <= F.col("dense_top"), F.col("dense_lift")).otherwise(1.0)
    bm25 = F.when(F.col("rank") <= F.col("bm25_top"), F.col("score") / F.coalesce("bm25_div", "bm25_best") * F.col("bm25"))
    plain = F.when(F.col("kind") == "law", F.when(known, F.col("law")).otherwise(F.col("law_else"))).otherwise(F.when(known, F.col("court")).otherwise(F.col("court_else")))
    full = F.when(F.col("by_freq"), F.when(F.col("state") != "unknown", run_score(F.col("kind"), F.col("freq"), F.col("state")))).otherwise(plain)
    explicit = F.when(known, F.col("explicit")).when(fuzzy, F.coalesce("explicit_fuzzy", "explicit_else")).otherwise(F.col("explicit_else"))
    step = F.get(F.filter("ranks", lambda r: F.col("rank") <= r["upto"]), F.lit(0))["worth"]
    court_dense = F.when(F.col("ranks").isNotNull(), F.coalesce(step, "rank_else")).when(F.col("generation") == "v1", F.col("score"))
    source = F.col("source")
    return (
        F.when(source == "dense", dense).when(source == "bm25", bm25).when(source == "gpt_full", full).when(source == "explicit", explicit).when(source == "court_dense", court_dense)
        .when(source == "gpt_specific", F.when(known, SPECIFIC).when(fuzzy, SPECIFIC_FUZZY)).when((source == "gpt_case") & known, CASE)
    )


def scored(hits: DataFrame, configs: DataFrame, statutes: DataFrame) -> DataFrame:
    """(generation, query_id, citation, kind, raw_score, score, sources): the hits of every generation, merged and lifted.

    The configurations are a constant table; statutes has (query_id, statutes), the key
    statutes of each query.  A generation that boosts them lifts what holds one - only
    keyword hits, or all - before cases come in.  Agreement counts the sources that a
    generation counts: two lift a score up to a cap, a third lifts it again.
    """
    keys = ["generation", "query_id", "citation"]
    best = hits.groupBy(F.col("query_id").alias("_query")).agg(F.max(F.when(F.col("source") == "bm25", F.col("score"))).alias("bm25_best"))
    hits = hits.join(F.broadcast(best), F.expr("query_id <=> _query"), "left").drop("_query")  # a row for each query
    rows = hits.crossJoin(F.broadcast(configs)).withColumn("worth", F.round(hit_score(), 9)).where("worth IS NOT NULL")
    late = (F.col("boost") != "none") & (F.col("source") == "gpt_case")
    one = rows.groupBy(*keys, "source").agg(F.max(F.when(~late, F.col("worth"))).alias("early"), F.max(F.when(late, F.col("worth"))).alias("late"))  # sets are of sources, not of hits
    one = one.groupBy(*keys).agg(F.max("early").alias("early"), F.max("late").alias("late"), F.array_sort(F.collect_set("source")).alias("sources"), F.bool_or(F.col("source") == "explicit").alias("is_explicit"))
    one = one.join(F.broadcast(configs.select("generation", "counted", "two", "two_cap", "three", "three_cap", "boost")), "generation").join(statutes, "query_id", "left")
    boosts = (F.col("boost") == "all") | ((F.col("boost") == "bm25") & F.array_contains("sources", "bm25"))
    named = F.coalesce("statutes", F.array().cast("array<string>"))
    lifted = F.when(boosts, fusion.statute_boost(F.col("early"), F.col("citation"), named)).otherwise(F.col("early"))
    n = F.when(F.array_contains("counted", "*"), F.size("sources")).otherwise(F.size(F.array_intersect("sources", "counted")))
    two = F.when(n >= 2, F.least(lifted * F.col("two"), F.greatest("two_cap", F.lit(0.0)))).otherwise(lifted)
    three = F.when(n >= 3, F.least(two * F.col("three"), F.col("three_cap"))).otherwise(two)
    law = fn.is_law(F.col("citation"))
    return one.select(*keys, F.when(law, "law").otherwise("court").alias("kind"), F.greatest("early", "late").alias("raw_score"), F.round(F.greatest(three, "late"), 6).alias("score"), "sources", "is_explicit")


def with_siblings(rows: DataFrame, corpus: DataFrame, configs: DataFrame) -> DataFrame:
    """rows and, for each decision among them, the first siblings that a generation adds, or all, at a share of the best score or flat.

    A generation may have the siblings of its first `parents` decisions only.
    """
    first = F.row_number().over(Window.partitionBy("generation", "query_id").orderBy(F.desc("score"), "citation"))
    court = rows.where("kind = 'court'").withColumn("base", fn.court_base(F.col("citation"))).withColumn("_n", first)
    court = court.join(F.broadcast(configs.select("generation", "parents")), "generation").where("parents IS NULL OR _n <= parents")
    parents = court.groupBy("generation", "query_id", "base").agg(F.max("score").alias("parent"))
    parents = parents.join(F.broadcast(configs.select("generation", "siblings", "sibling_share", "sibling_flat")), "generation")
    found = parents.join(fusion.siblings(corpus), "base").where("siblings IS NULL OR n <= siblings")
    new = found.join(rows.select("generation", "query_id", "citation"), ["generation", "query_id", "citation"], "left_anti")
    worth = F.round(F.coalesce("sibling_flat", F.col("parent") * F.col("sibling_share")), 6)
    return rows.unionByName(new.select("generation", "query_id", "citation", F.lit("court").alias("kind"), worth.alias("raw_score"), worth.alias("score"), F.array(F.lit("cocitation")).alias("sources"), F.lit(False).alias("is_explicit")))


def verified(rows: DataFrame, corpus: DataFrame, configs: DataFrame) -> DataFrame:
    """rows without citations that the corpus lacks, where a generation verifies them; what a query names stays in v11."""
    known = corpus.select("citation").distinct().withColumn("known", F.lit(True))
    kept = rows.join(F.broadcast(configs.select("generation", "verify")), "generation").join(known, "citation", "left")
    named = F.col("is_explicit") & (F.col("generation") == "v11")
    return kept.where((F.col("verify") == "none") | F.coalesce("known", F.lit(False)) | named).select(rows.columns)


def cut(rows: DataFrame, estimates: DataFrame) -> DataFrame:
    """(generation, query_id, citation, score, rank): each generation's list behind its own cutoff.

    Those of v2 are verified after their cut by the caller's order of calls;
    estimates has (query_id, estimate).
    """
    keyed = rows.join(estimates, "query_id").withColumn("query_id", F.struct("generation", "query_id"))
    out = None
    for row in ROWS:
        kind, *args = row[-1].split(":")
        part = keyed.where(F.col("generation") == row[0])
        if kind == "c1":
            part = fusion.threshold_walk(part, float(args[0]), int(args[1]), int(args[2]))
        else:
            part = {"c2": fusion.gap_elbow, "c3": fusion.knee, "c4": fusion.high_signal_cut, "c5": fusion.smart_cut, "c6": fusion.kind_caps}[kind](part)
        part = fusion.ranked(part.drop("rank")) if kind == "c6" else part
        part = part.select("generation", F.col("query_id.query_id").alias("query_id"), "citation", "score", "rank")
        out = part if out is None else out.unionByName(part)
    return out
