"""Set-based evaluation, shape statistics and gates."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexquarry.functions import text as fn
from lexquarry.sources.scratch import scratch


@dataclass(frozen=True)
class F1:
    both_empty: float = 1.0
    over: str = "gold"  # or "predictions": the queries that are averaged over


def per_query(predictions: DataFrame, gold: DataFrame, queries: DataFrame, cfg: F1 = F1()) -> DataFrame:
    """(query_id, tp, n_pred, n_gold, precision, recall, f1) for every query, with or without rows on either side."""
    p = predictions.select("query_id", "citation").distinct().withColumn("p", F.lit(1))
    g = gold.select("query_id", "citation").distinct().withColumn("g", F.lit(1))
    counts = p.join(g, ["query_id", "citation"], "full").groupBy("query_id").agg(F.count_if(F.col("p").isNotNull() & F.col("g").isNotNull()).alias("tp"), F.count("p").alias("n_pred"), F.count("g").alias("n_gold"))
    base = predictions if cfg.over == "predictions" else queries
    rows = base.select("query_id").distinct().join(counts, "query_id", "left").fillna(0, ["tp", "n_pred", "n_gold"])
    return rows.select("query_id", "tp", "n_pred", "n_gold", *_prf(cfg.both_empty))


def _prf(both_empty: float) -> list[Column]:
    tp, p, g = F.col("tp"), F.col("n_pred"), F.col("n_gold")
    empty = (p == 0) & (g == 0)
    ratio = lambda n: F.when(empty, both_empty).when(n == 0, 0.0).otherwise(F.round(tp / n, 6))
    return [ratio(p).alias("precision"), ratio(g).alias("recall"), F.when(empty, both_empty).when(p + g == 0, 0.0).otherwise(F.round(2 * tp / (p + g), 6)).alias("f1")]


def macro(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count("*").alias("queries"), F.round(F.avg("precision"), 4).alias("precision"), F.round(F.avg("recall"), 4).alias("recall"), F.round(F.avg("f1"), 4).alias("f1"))


def recall_curve(ranked: DataFrame, gold: DataFrame, ks: list[int]) -> DataFrame:
    """(k, hits, recall, oracle_f1): micro recall of the k best, and F1 of their gold part alone."""
    table = ranked.sparkSession.createDataFrame([(k,) for k in ks], "k int")
    hits = ranked.join(gold.select("query_id", "citation").distinct(), ["query_id", "citation"]).select("query_id", "rank")
    per = gold.groupBy("query_id").agg(F.count_distinct("citation").alias("n_gold")).crossJoin(F.broadcast(table))
    got = hits.join(F.broadcast(table), F.col("rank") <= F.col("k")).groupBy("query_id", "k").agg(F.count("*").alias("hits"))
    rows = per.join(got, ["query_id", "k"], "left").fillna(0, ["hits"])
    return rows.groupBy("k").agg(F.sum("hits").alias("hits"), F.round(F.sum("hits") / F.sum("n_gold"), 4).alias("recall"), F.round(F.avg(2 * F.col("hits") / (F.col("hits") + F.col("n_gold"))), 4).alias("oracle_f1"))


def source_attribution(hits: DataFrame, gold: DataFrame) -> DataFrame:
    """(source, hits, only): gold citations a source finds, and those that it alone finds."""
    found = hits.select("query_id", "citation", "source").distinct().join(gold.select("query_id", "citation").distinct(), ["query_id", "citation"])
    n = F.count("*").over(Window.partitionBy("query_id", "citation"))
    return found.withColumn("n", n).groupBy("source").agg(F.count("*").alias("hits"), F.count_if(F.col("n") == 1).alias("only"))


def numbered(rows: DataFrame, order: list[Column]) -> DataFrame:
    """rows with `row`, their place from 0 in a total order, and `rows`, how many there are.

    They are sorted by ranges and numbered within each; a range adds the rows of
    those before it, so that no task holds all rows.
    """
    ranged = rows.withColumn("_key", F.struct(*[c.alias(f"k{i}") for i, c in enumerate(order)])).repartitionByRange(F.col("_key")).withColumn("_part", F.spark_partition_id())
    ranged = scratch(rows.sparkSession).keep(ranged, "ranged")
    sizes = ranged.groupBy("_part").agg(F.count("*").alias("n"))  # a row for each range
    starts = sizes.select("_part", (F.sum("n").over(Window.orderBy("_part")) - F.col("n")).alias("_start"), F.sum("n").over(Window.partitionBy(F.lit(1))).alias("rows"))
    own = F.row_number().over(Window.partitionBy("_part").orderBy("_key")) - 1
    return ranged.withColumn("_own", own).join(F.broadcast(starts), "_part").withColumn("row", F.col("_own") + F.col("_start")).drop("_key", "_part", "_own", "_start")


def bootstrap(rows: DataFrame, rounds: int, alpha: float, value: str = "f1") -> DataFrame:
    """(rounds, lower_bound): the value at rank int(alpha * rounds) of the means of resampled queries.

    The draws come from a linear congruence of round and place, the same in any engine.
    """
    some = numbered(rows.select("query_id", F.col(value).alias("x")), [F.col("query_id")]).select(F.col("row").alias("i"), "x", "rows")
    total = some.agg(F.coalesce(F.max("rows"), F.lit(0)).alias("n"))
    places = some.select(F.col("i").alias("j")).crossJoin(F.broadcast(total))  # one row for each query
    draws = places.crossJoin(F.broadcast(rows.sparkSession.range(rounds).withColumnRenamed("id", "round")))
    draws = draws.select("round", F.expr("(((round * 7919 + j) * 1103515245 + 12345) % 2147483648) DIV 65536 % n").alias("i"))
    means = draws.groupBy("round", "i").agg(F.count("*").alias("k")).join(some.select("i", "x"), "i").groupBy("round").agg(F.round(F.sum(F.col("x") * F.col("k")) / F.sum("k"), 6).alias("mean"))
    first = means.orderBy("mean", "round").limit(int(alpha * rounds) + 1)  # of `rounds` means
    return first.orderBy(F.desc("mean"), F.desc("round")).limit(1).select(F.lit(rounds).alias("rounds"), F.col("mean").alias("lower_bound"))


def shape(predictions: DataFrame, queries: DataFrame) -> DataFrame:
    """Mean and median set size and the mean share of courts; a query without predictions counts 0."""
    per = predictions.groupBy("query_id").agg(F.count("*").alias("n"), F.count_if(~fn.is_law(F.col("citation"))).alias("courts"))
    rows = queries.select("query_id").distinct().join(per, "query_id", "left").fillna(0, ["n", "courts"])
    return rows.agg(F.round(F.avg("n"), 4).alias("avg_n"), F.median("n").alias("median_n"), F.round(F.avg(F.when(F.col("n") == 0, 0.0).otherwise(F.col("courts") / F.col("n"))), 4).alias("court_fraction"), F.round(1 - F.sum("courts") / F.sum("n"), 4).alias("law_share"))


def _sides(left: DataFrame, right: DataFrame) -> DataFrame:
    a = left.select("query_id", "citation").distinct().withColumn("l", F.lit(1))
    b = right.select("query_id", "citation").distinct().withColumn("r", F.lit(1))
    return a.join(b, ["query_id", "citation"], "full")


def jaccard(left: DataFrame, right: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, both, either, jaccard); two empty sets are alike."""
    counts = _sides(left, right).groupBy("query_id").agg(F.count_if(F.col("l").isNotNull() & F.col("r").isNotNull()).alias("both"), F.count("*").alias("either"))
    rows = queries.select("query_id").distinct().join(counts, "query_id", "left").fillna(0, ["both", "either"])
    return rows.withColumn("jaccard", F.when(F.col("either") == 0, 1.0).otherwise(F.round(F.col("both") / F.col("either"), 6)))


def diff_counts(candidate: DataFrame, anchor: DataFrame) -> DataFrame:
    """adds, removes, added_courts and the share of changed queries against an anchor."""
    rows = _sides(candidate, anchor)
    add, gone = F.col("r").isNull(), F.col("l").isNull()
    per = rows.groupBy("query_id").agg(F.count_if(add).alias("a"), F.count_if(gone).alias("g"), F.count_if(add & ~fn.is_law(F.col("citation"))).alias("c"))
    return per.agg(F.sum("a").alias("adds"), F.sum("g").alias("removes"), F.sum("c").alias("added_courts"), F.round(F.avg(F.when(F.col("a") + F.col("g") > 0, 1.0).otherwise(0.0)), 4).alias("changed_fraction"))


FEATURES = ["val_macro_f1", "test_avg_predictions", "test_avg_court_fraction", "test_jaccard_anchor", "adds_vs_anchor", "removes_vs_anchor", "added_courts_vs_anchor"]


def knn_scores(history: DataFrame, candidates: DataFrame, features: list[str], k: int = 3, loo: bool = False) -> DataFrame:
    """(name, predicted): distance-weighted score of the k nearest rows of a history, in robust units.

    With `loo`, a row of the history is predicted from the others.  A history
    has some dozens of rows; every candidate meets each of them.
    """
    h = history.select(F.col("name").alias("h_name"), F.col("public_score").alias("h_score"), *[F.col(f).alias(f"h_{f}") for f in features])
    pairs = candidates.select("name", *features).join(F.broadcast(h), F.col("name") != F.col("h_name") if loo else F.lit(True))
    w = Window.partitionBy("name")
    square = F.lit(0.0)
    for f in features:
        pairs = pairs.withColumn(f"m_{f}", F.median(f"h_{f}").over(w))
        pairs = pairs.withColumn(f"d_{f}", F.median(F.abs(F.col(f"h_{f}") - F.col(f"m_{f}"))).over(w))
        spread = F.max(f"h_{f}").over(w) - F.min(f"h_{f}").over(w)
        pairs = pairs.withColumn(f"d_{f}", F.when(F.col(f"d_{f}") == 0, F.when(spread == 0, 1.0).otherwise(spread)).otherwise(F.col(f"d_{f}")))
        square = square + F.pow((F.col(f) - F.col(f"h_{f}")) / F.col(f"d_{f}"), 2)
    pairs = pairs.withColumn("distance", F.round(F.sqrt(square), 9))
    near = pairs.withColumn("n", F.row_number().over(w.orderBy("distance", "h_name"))).where(F.col("n") <= k)
    weight = 1 / F.greatest(F.col("distance"), F.lit(1e-6))
    return near.groupBy("name").agg(F.round(F.sum(weight * F.col("h_score")) / F.sum(weight), 6).alias("predicted"))


def loo_quality(predicted: DataFrame) -> DataFrame:
    """(mae, pairwise_accuracy) of (name, public_score, predicted); equal scores form no pair."""
    a = predicted.select(F.col("name").alias("n1"), F.col("public_score").alias("s1"), F.col("predicted").alias("p1"))
    b = predicted.select(F.col("name").alias("n2"), F.col("public_score").alias("s2"), F.col("predicted").alias("p2"))
    pairs = a.join(b, (F.col("n1") < F.col("n2")) & (F.col("s1") != F.col("s2")))
    right = pairs.agg(F.round(F.avg(F.when((F.col("s1") - F.col("s2")) * (F.col("p1") - F.col("p2")) > 0, 1.0).otherwise(0.0)), 6).alias("pairwise_accuracy"))
    return predicted.agg(F.round(F.avg(F.abs(F.col("public_score") - F.col("predicted"))), 6).alias("mae")).crossJoin(right)


def verdict(row: dict[str, Column], anchor_n: Column, anchor_courts: Column) -> Column:
    """Whether a candidate is likely better, worse, or neither, by how it differs from the anchor."""
    better = (row["jaccard"] >= 0.92) & (row["adds"] <= 60) & (row["removes"] <= 10) & (row["added_courts"] == 0) & (row["avg_n"] <= anchor_n + 1.5) & (row["court_fraction"] <= anchor_courts + 0.02)
    worse = (row["jaccard"] < 0.85) | (row["adds"] > 120) | (row["added_courts"] > 30) | (row["avg_n"] > anchor_n + 2.0) | (row["court_fraction"] > anchor_courts + 0.03)
    return F.when(better, "likely_better_or_flat").when(worse, "likely_worse").otherwise("unclear")


def combined_verdict(predicted: Column, anchor: Column, heuristic: Column) -> Column:
    d = predicted - anchor
    return (
        F.when((heuristic == "likely_better_or_flat") & (d >= -0.001), "likely_better_or_flat").when((heuristic == "likely_worse") & (d <= 0.0), "likely_worse")
        .when(d >= 0.002, "possibly_better").when(d <= -0.004, "likely_worse").otherwise("unclear")
    )


#: What a citation of procedure holds.
PROCEDURE = ["BGG", "StBOG", "422", "428", "429", "436", "135 Abs. 3", "135 Abs. 4", "390", "382", "385", "384", "393", "396", "100 Abs. 1"]


def statute_histogram(gold: DataFrame) -> DataFrame:
    """(code, kind, n): gold citations by statute, procedural or substantive; decisions have no code."""
    c = F.col("citation")
    procedural = F.lit(False)
    for mark in PROCEDURE:
        procedural = procedural | F.contains(c, F.lit(mark))
    kind = F.when(~fn.is_law(c), "court").when(procedural, "procedural").otherwise("substantive")
    return gold.select(F.when(fn.is_law(c), fn.statute_token(c)).otherwise("").alias("code"), kind.alias("kind")).groupBy("code", "kind").agg(F.count("*").alias("n"))


def frequent(gold: DataFrame, least: int = 3) -> DataFrame:
    """Citations in at least so many gold sets, with the share of queries that have them."""
    total = gold.agg(F.count_distinct("query_id").alias("queries"))
    df = gold.groupBy("citation").agg(F.count_distinct("query_id").alias("df")).where(F.col("df") >= least)
    return df.crossJoin(F.broadcast(total)).select("citation", "df", F.round(F.col("df") / F.col("queries"), 4).alias("coverage"))
