"""Reranking, guards, injections, rollups and the remaining selection helpers."""

from __future__ import annotations

import itertools
import json
from collections.abc import Callable

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexquarry.functions import text as fn


def token_jaccard(a: Column, b: Column) -> Column:
    """Share of common tokens; the default scorer of a reranker."""
    x, y = F.array_distinct(fn.tokenize(a)), F.array_distinct(fn.tokenize(b))
    either = F.size(F.array_union(x, y))
    return F.when(either == 0, 0.0).otherwise(F.round(F.size(F.array_intersect(x, y)) / either, 6))


def rerank(ranked: DataFrame, texts: DataFrame, queries: DataFrame, scorer: Callable[[Column, Column], Column] = token_jaccard, key: str = "doc_id") -> DataFrame:
    """ranked with the scorer's value of (query, text) and the new rank."""
    rows = ranked.join(texts.select(key, "text"), key).join(queries.select("query_id", "query"), "query_id")
    rows = rows.withColumn("rerank_score", scorer(F.col("query"), F.col("text"))).drop("text", "query")
    return rows.withColumn("new_rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("rerank_score"), key)))


def bumped(scored: DataFrame, approved: DataFrame, low: float = 0.2, high: float = 0.8, most: int = 60, to: float = 0.82) -> DataFrame:
    """scored with the approved ones among the best uncertain candidates lifted to `to`."""
    unsure = scored.where((F.col("score") > low) & (F.col("score") < high))
    first = unsure.withColumn("n", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "citation"))).where(F.col("n") <= most)
    lifted = first.join(approved, ["query_id", "citation"], "left_semi").select("query_id", "citation", F.lit(to).alias("to"))
    return scored.join(lifted, ["query_id", "citation"], "left").withColumn("score", F.greatest("score", "to")).drop("to")


def closed_set(selected: DataFrame, pool: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The selections that are in the pool, and (query_id, dropped) for the others."""
    kept = selected.join(pool.select("query_id", "citation"), ["query_id", "citation"], "left_semi")
    gone = selected.join(pool.select("query_id", "citation"), ["query_id", "citation"], "left_anti").groupBy("query_id").agg(F.count("*").alias("dropped"))
    return kept, gone


def pass_agreement(passes: DataFrame) -> DataFrame:
    """(pass, label, share) and, as the label `agreed`, the share of candidates on which all passes agree."""
    n = F.sum("n").over(Window.partitionBy("pass"))
    shares = passes.groupBy("pass", "label").agg(F.count("*").alias("n")).select("pass", "label", F.round(F.col("n") / n, 4).alias("share"))
    each = passes.groupBy("query_id", "citation").agg((F.count_distinct("label") == 1).cast("int").alias("same"))
    return shares.unionByName(each.agg(F.round(F.avg("same"), 4).alias("share")).select(F.lit(-1).cast("long").alias("pass"), F.lit("agreed").alias("label"), "share"))


#: Least votes and most additions of the exhaustive perturbation.
PERTURB = [(1, 2), (1, 3), (1, 5), (2, 3), (2, 5), (2, 8), (3, 3), (3, 5)]


def triple_additions(variants: DataFrame, anchor: DataFrame, names: list[int], grid: list[tuple[int, int]]) -> DataFrame:
    """(i, j, k, min_votes, max_add, added): what enough of three variants have beyond the anchor, for every triple and setting.

    The triples come from a short list of variants; the rows of a variant are joined with the triples that hold it.
    """
    return _triple_rows(variants, anchor, names, grid).groupBy("i", "j", "k", "min_votes", "max_add").agg(F.count("*").alias("added"))


def triple_scores(variants: DataFrame, anchor: DataFrame, gold: DataFrame, queries: DataFrame, names: list[int], grid: list[tuple[int, int]]) -> DataFrame:
    """(i, j, k, min_votes, max_add, f1): macro F1 of the anchor with these additions."""
    marks = gold.select("query_id", "citation").distinct().withColumn("g", F.lit(1))
    keys = ["i", "j", "k", "min_votes", "max_add"]
    added = _triple_rows(variants, anchor, names, grid).join(marks, ["query_id", "citation"], "left").groupBy(*keys, "query_id").agg(F.count("*").alias("more"), F.count("g").alias("right"))
    own = anchor.select("query_id", "citation").distinct().join(marks, ["query_id", "citation"], "left").groupBy("query_id").agg(F.count("*").alias("n"), F.count("g").alias("tp"))
    size = queries.select("query_id").distinct().join(own, "query_id", "left").join(gold.groupBy("query_id").agg(F.count_distinct("citation").alias("n_gold")), "query_id", "left").fillna(0)
    every = size.crossJoin(F.broadcast(_triples(variants.sparkSession, names).select("i", "j", "k").distinct())).crossJoin(F.broadcast(_settings(variants.sparkSession, grid)))
    rows = every.join(added, [*keys, "query_id"], "left").fillna(0)
    both = F.col("n") + F.col("more") + F.col("n_gold")
    return rows.groupBy(*keys).agg(F.round(F.avg(F.when(both == 0, 1.0).otherwise(F.round(2 * (F.col("tp") + F.col("right")) / both, 6))), 8).alias("f1"))


def _triples(spark, names: list[int]) -> DataFrame:
    return spark.createDataFrame([(*t, v) for t in itertools.combinations(sorted(names), 3) for v in t], "i int, j int, k int, variant int")


def _settings(spark, grid: list[tuple[int, int]]) -> DataFrame:
    return spark.createDataFrame(grid, "min_votes int, max_add int")


def _triple_rows(variants: DataFrame, anchor: DataFrame, names: list[int], grid: list[tuple[int, int]]) -> DataFrame:
    spark = variants.sparkSession
    votes = variants.join(F.broadcast(_triples(spark, names)), "variant").groupBy("i", "j", "k", "query_id", "citation").agg(F.count("*").alias("votes"))
    new = votes.join(anchor, ["query_id", "citation"], "left_anti").join(F.broadcast(_settings(spark, grid)), F.col("votes") >= F.col("min_votes"))
    w = Window.partitionBy("i", "j", "k", "min_votes", "max_add", "query_id").orderBy("citation")
    return new.withColumn("n", F.row_number().over(w)).where(F.col("n") <= F.col("max_add"))


def rolling_neighbours(names: DataFrame, rounds: int, seed: int, size: int = 3) -> DataFrame:
    """(round, name): `size` names for each round, drawn by a seeded hash."""
    draws = names.crossJoin(F.broadcast(names.sparkSession.range(rounds).withColumnRenamed("id", "round")))
    w = Window.partitionBy("round").orderBy(F.md5(F.concat_ws(":", F.lit(seed), "round", "name")), "name")
    return draws.withColumn("n", F.row_number().over(w)).where(F.col("n") <= size).select("round", "name")


def inject_topics(predictions: DataFrame, offered: DataFrame) -> DataFrame:
    """predictions and every statute that was suggested as missing."""
    return predictions.select("query_id", "citation").unionByName(offered.where(fn.is_law(F.col("citation"))).select("query_id", "citation")).distinct()


def inject_verified(predictions: DataFrame, offered: DataFrame, corpus: DataFrame, least: float = 0.7, without: str = "BGG") -> DataFrame:
    """predictions and what was offered with enough confidence, as the corpus has it.

    What it lacks becomes its only citation of the same article and statute, or the
    first of several that are of the first paragraph; the statute `without` is left out.
    """
    c, known = F.col("citation"), corpus.select("citation").distinct()
    good = offered.where((F.col("confidence") >= least) & ~F.contains(c, F.lit(without))).select("query_id", "citation").distinct()
    own = good.join(known, "citation", "left_semi").select("query_id", "citation")
    base = lambda column: F.concat_ws(" ", F.regexp_extract(column, r"^(Art\.\s+\d+[a-z]?)\b", 1), fn.statute_token(column))
    several = known.where(c.startswith("Art.")).groupBy(base(c).alias("base")).agg(F.count("*").alias("n"), F.min("citation").alias("one"), F.min(F.when(F.contains(c, F.lit("Abs. 1")), c)).alias("first"))
    short = good.join(known, "citation", "left_anti").where(c.rlike(r"^Art\.\s+\d+[a-z]?\s*\S+\s*$")).select("query_id", base(c).alias("base"))
    near = short.join(several, "base").select("query_id", F.when(F.col("n") == 1, F.col("one")).otherwise(F.col("first")).alias("citation")).where("citation IS NOT NULL")
    return predictions.select("query_id", "citation").unionByName(own).unionByName(near).distinct()


def inject_confident(predictions: DataFrame, offered: DataFrame, least: float = 0.7) -> DataFrame:
    """predictions and the statutes that were offered with enough confidence."""
    new = offered.where((F.col("confidence") >= least) & fn.is_law(F.col("citation"))).select("query_id", "citation")
    return predictions.select("query_id", "citation").unionByName(new).distinct()


def keep_best(configs: DataFrame, n: int, by: str = "objective") -> DataFrame:
    return configs.orderBy(F.desc(by), "config_id").limit(n)


def model_rollup(predictions: DataFrame, gold: DataFrame, corpus: DataFrame, key: str) -> DataFrame:
    """(key, n, hit_rate, precision): size of each model's output, its share in the corpus, and in the gold sets."""
    known = corpus.select("citation").distinct().withColumn("known", F.lit(1))
    right = gold.select("query_id", "citation").distinct().withColumn("right", F.lit(1))
    rows = predictions.select(key, "query_id", "citation").distinct().join(known, "citation", "left").join(right, ["query_id", "citation"], "left")
    return rows.groupBy(key).agg(F.count("*").alias("n"), F.round(F.count("known") / F.count("*"), 4).alias("hit_rate"), F.round(F.count("right") / F.count("*"), 4).alias("precision"))


def model_summary(answers: DataFrame, gold: DataFrame, corpus: DataFrame, runs: DataFrame, key: str) -> DataFrame:
    """(key, f1, precision, recall, avg_n, hit_rate, tokens_in, tokens_out, cost, seconds): a model's quality and what it took.

    runs has (key, query_id, tokens_in, tokens_out, seconds, price_in, price_out), prices for a million tokens.
    """
    right = gold.select("query_id", "citation").distinct().withColumn("g", F.lit(1))
    known = corpus.select("citation").distinct().withColumn("k", F.lit(1))
    got = answers.select(key, "query_id", "citation").distinct().join(right, ["query_id", "citation"], "left").join(known, "citation", "left")
    got = got.groupBy(key, "query_id").agg(F.count("*").alias("n"), F.count("g").alias("tp"), F.count("k").alias("hits"))
    sizes = gold.groupBy("query_id").agg(F.count_distinct("citation").alias("n_gold"))
    rows = runs.join(got, [key, "query_id"], "left").join(sizes, "query_id", "left").fillna(0, ["n", "tp", "hits", "n_gold"])
    none, empty = (F.col("n") == 0) & (F.col("n_gold") == 0), (F.col("n") == 0) | (F.col("n_gold") == 0)
    share = lambda of, n: F.round(F.avg(F.when(none, 1.0).when(empty, 0.0).otherwise(F.round(of / n, 6))), 4)
    cost = F.sum(F.col("tokens_in") * F.col("price_in") + F.col("tokens_out") * F.col("price_out")) / 1e6
    return rows.groupBy(key).agg(
        share(2 * F.col("tp"), F.col("n") + F.col("n_gold")).alias("f1"), share(F.col("tp"), F.col("n")).alias("precision"), share(F.col("tp"), F.col("n_gold")).alias("recall"), F.round(F.avg("n"), 4).alias("avg_n"),
        F.round(F.sum("hits") / F.greatest(F.sum("n"), F.lit(1)), 4).alias("hit_rate"), F.sum("tokens_in").alias("tokens_in"), F.sum("tokens_out").alias("tokens_out"), F.round(cost, 6).alias("cost"), F.round(F.sum("seconds"), 4).alias("seconds"),
    )


def label_distribution(judged: DataFrame, selected: DataFrame, gold: DataFrame) -> DataFrame:
    """(judge_label, n, chosen, right): candidates of each label, how many a selection takes, and how many of these are gold."""
    keys = ["query_id", "citation"]
    chosen = selected.select(keys).distinct().withColumn("s", F.lit(1))
    right = gold.select(keys).distinct().withColumn("g", F.lit(1))
    rows = judged.join(chosen, keys, "left").join(right, keys, "left")
    return rows.groupBy("judge_label").agg(F.count("*").alias("n"), F.count("s").alias("chosen"), F.count_if(F.col("s").isNotNull() & F.col("g").isNotNull()).alias("right"))


def signal_pool(judged: DataFrame, most: int) -> DataFrame:
    """All musts and, up to `most`, the others with the best signal: the larger of both scores and the inverse ranks."""
    inverse = lambda c: F.coalesce(1.0 / (1 + F.col(c)), F.lit(0.0))
    must = F.col("judge_label") == "must_include"
    rows = judged.withColumn("signal", F.round(F.greatest("raw_score", "final_score", inverse("bm25_rank"), inverse("dense_rank")), 6))
    q = Window.partitionBy("query_id")
    rows = rows.withColumn("rank", F.row_number().over(q.orderBy(F.when(must, 0).otherwise(1), F.desc("signal"), "citation")))
    return rows.where(must | (F.col("rank") <= most))


def recovered(selected: DataFrame, baseline: DataFrame, gold: DataFrame) -> DataFrame:
    """(query_id, recovered, new): gold citations beyond the baseline that a selection has, and all that it has beyond it."""
    new = selected.select("query_id", "citation").distinct().join(baseline, ["query_id", "citation"], "left_anti")
    marks = gold.select("query_id", "citation").distinct().withColumn("g", F.lit(1))
    return new.join(marks, ["query_id", "citation"], "left").groupBy("query_id").agg(F.count("g").alias("recovered"), F.count("*").alias("new"))


def prune(scored: DataFrame, share: float = 0.15, cap: int = 60, floor: int = 10) -> DataFrame:
    """The estimate, extended while scores are a share of the best; short lists have a floor instead."""
    w = Window.partitionBy("query_id")
    rows = scored.withColumn("rank", F.row_number().over(w.orderBy(F.desc("score"), "citation"))).withColumn("n", F.count("*").over(w)).withColumn("top", F.max("score").over(w))
    above = F.sum(F.when(F.col("score") >= F.col("top") * share, 1).otherwise(0)).over(w)
    k = F.when(F.col("estimate") < F.col("n"), F.greatest(F.col("estimate"), above)).otherwise(F.least(F.col("n"), F.greatest(F.col("estimate"), F.lit(floor))))
    return rows.withColumn("cut", F.least(k, F.lit(cap))).where("rank <= cut").drop("n", "top")


def display_line(kind: Column, rank: Column, citation: Column, text: Column, width: int = 60) -> Column:
    return F.concat(F.lit("["), rank.cast("string"), F.lit("] "), F.upper(kind), F.lit(" "), citation, F.lit(": "), fn.compact(text, width))


def save_config(config: dict, path: str, spark) -> None:
    spark.createDataFrame([(json.dumps(config, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def load_config(path: str, spark) -> dict:
    return json.loads(spark.read.text(path).first()["value"])


def load_model(path: str) -> PipelineModel:
    """A fitted selector that was saved by its `write()`."""
    return PipelineModel.load(path)
