"""Votes, consensus and perturbation of prediction sets (variant, query_id, citation)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexquarry.functions import text as fn


def votes(predictions: DataFrame) -> DataFrame:
    """(query_id, citation, votes): in how many variants a citation is."""
    return predictions.select("variant", "query_id", "citation").distinct().groupBy("query_id", "citation").agg(F.count("*").alias("votes"))


def threshold_sweep(predictions: DataFrame, queries: DataFrame, ks: list[int]) -> DataFrame:
    """(k, query_id, citations): what k variants agree on; a query without any keeps an empty set."""
    spark = predictions.sparkSession
    table = spark.createDataFrame([(k,) for k in ks], "k int")
    kept = votes(predictions).join(F.broadcast(table), F.col("votes") >= F.col("k")).groupBy("k", "query_id").agg(F.array_sort(F.collect_set("citation")).alias("citations"))
    every = queries.select("query_id").distinct().crossJoin(F.broadcast(table))
    return every.join(kept, ["k", "query_id"], "left").withColumn("citations", F.coalesce("citations", F.array().cast("array<string>")))


def consensus_target(predictions: DataFrame, share: float = 0.6, bias: int = 0, mode: str = "median", firsts: tuple[DataFrame, ...] = ()) -> DataFrame:
    """What enough variants agree on, filled by votes up to a target: the upper median, the mean or the largest of their sizes.

    Equal votes go by which of the sets in `firsts` hold a citation, in their order, then by citation.
    """
    sizes = predictions.groupBy("query_id", "variant").agg(F.count_distinct("citation").alias("n"))
    base = {"median": F.element_at(F.array_sort(F.collect_list("n")), (F.floor(F.count("*") / 2) + 1).cast("int")), "mean": F.bround(F.avg("n")).cast("long"), "max": F.max("n")}[mode]
    per = sizes.groupBy("query_id").agg(F.greatest(F.lit(1), base + bias).alias("target"), F.ceil(F.round(F.count("*") * share, 9)).alias("least"))
    rows, order = _held(votes(predictions), firsts)
    rows = rows.join(per, "query_id").withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("votes"), *order, "citation")))
    return rows.where((F.col("votes") >= F.col("least")) | (F.col("rank") <= F.col("target"))).select("query_id", "citation", "votes", "rank")


def _held(rows: DataFrame, firsts: tuple[DataFrame, ...]) -> tuple[DataFrame, list[Column]]:
    """rows with held_0, held_1, ...: whether each of the sets has the citation; and the order that puts those first."""
    for i, first in enumerate(firsts):
        rows = rows.join(first.select("query_id", "citation").distinct().withColumn(f"held_{i}", F.lit(1)), ["query_id", "citation"], "left").fillna(0, [f"held_{i}"])
    return rows, [F.desc(f"held_{i}") for i in range(len(firsts))]


def best_threshold(predictions: DataFrame, gold: DataFrame, queries: DataFrame, ks: list[int]) -> DataFrame:
    """(k, f1): the number of agreeing variants with the best macro F1; the smallest of equally good ones."""
    sets = threshold_sweep(predictions, queries, ks)
    size = gold.groupBy("query_id").agg(F.array_sort(F.collect_set("citation")).alias("gold"))
    rows = sets.join(size, "query_id", "left").withColumn("gold", F.coalesce("gold", F.array().cast("array<string>")))
    both, n = F.size(F.array_intersect("citations", "gold")), F.size("citations") + F.size("gold")
    means = rows.groupBy("k").agg(F.round(F.avg(F.when(n == 0, 1.0).otherwise(F.round(2 * both / n, 6))), 8).alias("f1"))
    return means.orderBy(F.desc("f1"), "k").limit(1)


def perturbed(anchor: DataFrame, neighbours: DataFrame, min_votes: int = 2, max_add: int = 3, max_court: int = 1, max_law: int = 3, max_remove: int = 2, firsts: tuple[DataFrame, ...] = (), max_remove_court: int | None = None) -> DataFrame:
    """(query_id, citation, change): the anchor, less what no neighbour has, and what enough of them add.

    Additions go by votes, then by which of `firsts` hold them, laws before courts;
    removals take what these don't hold first, and courts before laws.  Both are
    capped for each query, additions for each kind, removals for courts.
    """
    v = votes(neighbours)
    law = fn.is_law(F.col("citation"))
    q = Window.partitionBy("query_id")
    added = v.where(F.col("votes") >= min_votes).join(anchor, ["query_id", "citation"], "left_anti").withColumn("law", law)
    added, held = _held(added, firsts)
    order = [F.desc("votes"), *held, F.desc("law"), F.asc("citation")]
    added = added.withColumn("of_kind", F.row_number().over(Window.partitionBy("query_id", "law").orderBy(*order))).where(F.col("of_kind") <= F.when(F.col("law"), max_law).otherwise(max_court))
    added = added.withColumn("n", F.row_number().over(q.orderBy(*order))).where(F.col("n") <= max_add)
    gone, _ = _held(anchor.join(v, ["query_id", "citation"], "left_anti").withColumn("law", law), firsts)
    away = [*[F.asc(f"held_{i}") for i in range(len(firsts))], F.asc("law"), F.asc("citation")]
    if max_remove_court is not None:
        gone = gone.withColumn("of_kind", F.row_number().over(Window.partitionBy("query_id", "law").orderBy(*away))).where(F.col("law") | (F.col("of_kind") <= max_remove_court))
    gone = gone.withColumn("n", F.row_number().over(q.orderBy(*away))).where(F.col("n") <= max_remove)
    kept = anchor.join(gone, ["query_id", "citation"], "left_anti").select("query_id", "citation", F.lit("kept").alias("change"))
    return kept.unionByName(added.select("query_id", "citation", F.lit("added").alias("change"))).unionByName(gone.select("query_id", "citation", F.lit("removed").alias("change")))


def add_only(base: DataFrame, candidates: DataFrame, allowed: Column, most: int, order: list[Column]) -> DataFrame:
    """base and the first candidates of each query that pass and aren't in it."""
    new = candidates.where(allowed).join(base, ["query_id", "citation"], "left_anti")
    new = new.withColumn("n", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).where(F.col("n") <= most)
    return base.select("query_id", "citation").unionByName(new.select("query_id", "citation"))


def inject_rules(predictions: DataFrame, queries: DataFrame, rules: DataFrame, most: int = 5) -> DataFrame:
    """predictions and, for each rule that fires, the first of its citations.

    A rule (rule, statutes, pattern, citations) fires on a query that matches its
    pattern and whose predictions hold one of its statutes.
    """
    codes = predictions.groupBy("query_id").agg(F.collect_set(fn.statute_token(F.col("citation"))).alias("codes"))
    fired = queries.join(codes, "query_id").join(F.broadcast(rules), F.expr("rlike(query, concat('(?i)', pattern)) AND arrays_overlap(codes, statutes)"))
    new = fired.select("query_id", F.explode(F.slice("citations", 1, most)).alias("citation"))
    return predictions.select("query_id", "citation").unionByName(new).distinct()


def linear_score(candidates: DataFrame, weights: dict[str, float]) -> Column:
    """Weighted sum of columns; a missing value counts 0."""
    out = F.lit(0.0)
    for name, w in weights.items():
        out = out + F.coalesce(F.col(name).cast("double"), F.lit(0.0)) * w
    return out


#: Names of the 32 weights: plain terms, then priors by channel and level, then penalties.
PLAIN = ["v7_bonus", "v11_bonus", "both_bonus", "auto_keep_bonus", "explicit_bonus", "must_bonus", "plausible_bonus", "reject_penalty", "conf_weight", "final_weight", "raw_weight", "gpt_freq_weight", "source_count_weight", "law_bonus", "court_bonus"]
SOURCES = {"dense_bonus": "dense", "bm25_bonus": "bm25", "gpt_case_bonus": "gpt_case", "cocitation_penalty": "cocitation", "court_dense_bonus": "court_dense"}
PRIORS = {
    "exact_train_weight": ("all", "exact"), "dense_train_weight": ("dense", "exact"), "law_base_train_weight": ("all", "law_base"), "dense_law_base_train_weight": ("dense", "law_base"),
    **{f"{c}_{level}_weight": (c, level) for level in ("exact", "law_base") for c in ("dense100", "dense12", "sparse79")},
}
PENALTIES = ["court_dense_only_penalty", "single_source_penalty"]


def hybrid_terms(pool: DataFrame, candidates: DataFrame, priors: DataFrame) -> DataFrame:
    """(query_id, citation, a column for each weight): what the weights of the hybrid score multiply.

    pool has (query_id, citation, in_left, in_right) of v7 and v11 and of all candidates;
    priors has (channel, level, key, n).  A citation that is no candidate has its kind
    and priors alone, and a decision among these only those of the three channels.
    """
    c, keys = F.col("citation"), ["query_id", "citation"]
    rows = pool.join(candidates.withColumn("found", F.lit(True)), keys, "left").withColumn("base", F.when(fn.is_law(c), fn.law_base_by_tokens(c)))
    for level, key in (("exact", "citation"), ("law_base", "base")):
        counts = priors.where(F.col("level") == level).groupBy(F.col("key").alias(key)).pivot("channel", ["all", "dense", "dense100", "dense12", "sparse79"]).agg(F.max("n"))
        rows = rows.join(counts.withColumnsRenamed({x: f"{x}_{level}" for x in ("all", "dense", "dense100", "dense12", "sparse79")}), key, "left")
    found, one = F.coalesce("found", F.lit(False)), lambda x: F.coalesce(x, F.lit(False)).cast("int")
    law = F.coalesce(F.col("kind") == "law", fn.is_law(c))
    number = lambda name: F.coalesce(F.col(name).cast("double"), F.lit(0.0))
    size = F.size("sources")
    plain = [
        one(F.col("in_left")), one(F.col("in_right")), one(F.col("in_left") & F.col("in_right")), one(F.col("auto_bucket") == "auto_keep"), one(F.col("is_explicit")),
        *[one(F.col("judge_label") == x) for x in ("must_include", "plausible", "reject")], number("judge_confidence"), number("final_score"), number("raw_score"), number("freq"),
        F.when(found, size).otherwise(0), law.cast("int"), (~law).cast("int"),
    ]
    terms = dict(zip(PLAIN, plain)) | {name: one(F.array_contains("sources", s)) for name, s in SOURCES.items()}
    for name, (channel, level) in PRIORS.items():
        n = F.round(F.log1p(F.coalesce(F.col(f"{channel}_{level}"), F.lit(0))), 9)
        terms[name] = n if channel in ("dense100", "dense12", "sparse79") else F.when(found | law, n).otherwise(0.0)
    terms["court_dense_only_penalty"] = one(found & (size == 1) & F.array_contains("sources", "court_dense"))
    terms["single_source_penalty"] = one(found & (size <= 1))
    return rows.select(*keys, *[x.cast("double").alias(name) for name, x in terms.items()])


def pool_union(left: DataFrame, right: DataFrame) -> DataFrame:
    """All candidates of two pools, with in_left and in_right."""
    a, b = left.select("query_id", "citation", F.lit(True).alias("in_left")), right.select("query_id", "citation", F.lit(True).alias("in_right"))
    return a.distinct().join(b.distinct(), ["query_id", "citation"], "full").fillna(False, ["in_left", "in_right"])


def low_penalty(value: Column, floor: float, weight: float) -> Column:
    """What a value lacks to a floor, weighed."""
    return F.greatest(F.lit(0.0), F.lit(floor) - value) * weight


def _shapes(predictions: DataFrame, variants: DataFrame, queries: DataFrame, key: str, anchors: list[DataFrame]) -> DataFrame:
    """(key, n, courts, like_0, ...): mean set size, share of courts and Jaccard to each anchor, not rounded, over all queries."""
    sets = predictions.select(key, "query_id", "citation").distinct()
    per = sets.groupBy(key, "query_id").agg(F.count("*").alias("n"), F.count_if(~fn.is_law(F.col("citation"))).alias("c"))
    rows = variants.crossJoin(F.broadcast(queries.select("query_id").distinct())).join(per, [key, "query_id"], "left").fillna(0, ["n", "c"])
    for i, anchor in enumerate(anchors):
        a = anchor.select("query_id", "citation").distinct()
        both = sets.join(a, ["query_id", "citation"]).groupBy(key, "query_id").agg(F.count("*").alias("both"))
        rows = rows.join(a.groupBy("query_id").agg(F.count("*").alias("m")), "query_id", "left").join(both, [key, "query_id"], "left").fillna(0, ["m", "both"])
        either = F.col("n") + F.col("m") - F.col("both")
        rows = rows.withColumn(f"like_{i}", F.when(either == 0, 1.0).otherwise(F.col("both") / either)).drop("m", "both")
    courts = F.when(F.col("n") == 0, 0.0).otherwise(F.col("c") / F.col("n"))
    return rows.groupBy(key).agg(F.avg("n").alias("n"), F.avg(courts).alias("courts"), *[F.avg(f"like_{i}").alias(f"like_{i}") for i in range(len(anchors))])


def robust_objective(per_query: DataFrame, key: str, predictions: DataFrame, queries: DataFrame, test: DataFrame | None = None, test_queries: DataFrame | None = None, v11: DataFrame | None = None, v7: DataFrame | None = None) -> DataFrame:
    """(key, objective) of per-query F1: the mean, less its spread, with part of the least, and penalties below floors.

    The floors are for the share of courts and the size of the predicted sets;
    with a test set for its share, its size and its Jaccard to the anchors given.
    """
    stats = per_query.groupBy(key).agg(F.avg("f1").alias("mean"), F.stddev_pop("f1").alias("std"), F.min("f1").alias("least"))
    variants = per_query.select(key).distinct()
    rows = stats.join(_shapes(predictions, variants, queries, key, []), key)
    lack = low_penalty(F.col("courts"), 0.28, 0.9) + low_penalty(F.col("n"), 24.0, 0.01)
    if test is not None:
        floors = [(a, *f) for a, *f in ((v11, 0.60, 0.15), (v7, 0.30, 0.10)) if a is not None]
        shapes = _shapes(test, variants, test_queries, key, [a for a, *_ in floors])
        rows = rows.join(shapes.withColumnsRenamed({"n": "test_n", "courts": "test_courts"}), key)
        lack = lack + low_penalty(F.col("test_courts"), 0.24, 0.9) + low_penalty(F.col("test_n"), 23.0, 0.01)
        for i, (_, floor, weight) in enumerate(floors):
            lack = lack + low_penalty(F.col(f"like_{i}"), floor, weight)
    return rows.select(key, F.round(F.col("mean") - 0.45 * F.col("std") + 0.08 * F.col("least") - lack, 6).alias("objective"))
