"""Fusion of candidate sources, cutoffs, buckets and judgements."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexquarry.functions import text as fn


def fuse(hits: DataFrame) -> DataFrame:
    """One row for each (query_id, citation): best score and ranks, all sources, any flag."""
    return hits.groupBy("query_id", "citation").agg(
        F.max("score").alias("raw_score"), F.array_sort(F.collect_set("source")).alias("sources"), F.max("freq").alias("freq"),
        F.min("dense_rank").alias("dense_rank"), F.min("bm25_rank").alias("bm25_rank"), F.min("court_dense_rank").alias("court_dense_rank"),
        F.bool_or("is_explicit").alias("is_explicit"), F.bool_or("is_query_case").alias("is_query_case"),
    )


def boosted(score: Column, n_sources: Column) -> Column:
    """Agreement of two sources, and of three, lifts a score up to a cap."""
    two = F.when(n_sources >= 2, F.least(score * 1.25, F.lit(0.96))).otherwise(score)
    return F.when(n_sources >= 3, F.least(two * 1.35, F.lit(0.98))).otherwise(two)


def run_score(kind: Column, freq: Column) -> Column:
    """Score of a citation by the number of runs that name it."""
    return F.when(kind == "law", F.least(F.lit(0.80) + freq * 0.05, F.lit(0.95))).otherwise(F.least(F.lit(0.78) + freq * 0.05, F.lit(0.93)))


def siblings(corpus: DataFrame, most: int | None = None) -> DataFrame:
    """(base, citation, n): the first considerations of each decision in key order, or all."""
    w = Window.partitionBy("base").orderBy("citation")
    named = corpus.select(fn.court_base(F.col("citation")).alias("base"), "citation").distinct()
    placed = named.withColumn("n", F.row_number().over(w))
    return placed if most is None else placed.where(F.col("n") <= most)


def cocited(scored: DataFrame, mentions: DataFrame, corpus: DataFrame, most: int = 15, share: float = 0.3, default: float = 0.5) -> DataFrame:
    """(query_id, citation, score): unseen siblings of the first mention of each decision.

    mentions has (query_id, citation, pos); a decision mentioned again adds nothing.
    """
    first = Window.partitionBy("query_id", "base").orderBy("pos", "citation")
    parents = mentions.withColumn("base", fn.court_base(F.col("citation"))).withColumn("n", F.row_number().over(first)).where("n = 1").drop("n", "pos")
    parents = parents.join(scored.select("query_id", "citation", "score"), ["query_id", "citation"], "left").select("query_id", "base", F.coalesce("score", F.lit(default)).alias("parent"))
    found = parents.join(siblings(corpus, most), "base").select("query_id", "citation", (F.col("parent") * share).alias("score"))
    return found.join(scored.select("query_id", "citation"), ["query_id", "citation"], "left_anti")


def with_floor(scored: DataFrame, queries: DataFrame, citation: str, floor: float, corpus: DataFrame) -> DataFrame:
    """scored with one constant citation at `floor` at least, for every query, if the corpus has it."""
    has = corpus.where(F.col("citation") == citation).limit(1).select("citation")
    constant = queries.select("query_id").distinct().crossJoin(F.broadcast(has)).select("query_id", "citation", F.lit(floor).alias("score"))
    return scored.select("query_id", "citation", "score").unionByName(constant).groupBy("query_id", "citation").agg(F.max("score").alias("score"))


def statute_boost(score: Column, citation: Column, statutes: Column, factor: float = 1.3, cap: float = 0.92) -> Column:
    """The factor once for each statute that the citation holds."""
    return F.aggregate(F.filter(statutes, lambda s: F.contains(citation, s)), score, lambda acc, s: F.least(acc * factor, F.lit(cap)))


def verified(scored: DataFrame, known: DataFrame, score: str = "score") -> DataFrame:
    """What stands in the corpus or is named by the query, with `baseline_rank` among what stays."""
    keep = scored.join(known.select("citation").distinct().withColumn("known", F.lit(True)), "citation", "left")
    keep = keep.where(F.coalesce("known", F.lit(False)) | F.col("is_explicit")).drop("known")
    return keep.withColumn("baseline_rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(score), "citation")))


# Cutoffs: how many of a ranked list stay.


def ranked(scored: DataFrame, score: str = "score") -> DataFrame:
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(score), "citation")))


def threshold_walk(scored: DataFrame, share: float, floor: int, cap: int) -> DataFrame:
    """At least max(estimate, floor); further as long as the score is a share of the best; at most cap."""
    w = Window.partitionBy("query_id")
    rows = ranked(scored).withColumn("top", F.max("score").over(w))
    rows = rows.withColumn("above", F.sum(F.when(F.col("score") >= F.col("top") * share, 1).otherwise(0)).over(w))
    return rows.where(F.col("rank") <= F.least(F.greatest(F.col("estimate"), F.lit(floor), F.col("above")), F.lit(cap))).drop("top", "above")


def gap_elbow(scored: DataFrame, cap: int = 45, least: int = 5, gap: float = 0.02, high: float = 0.6) -> DataFrame:
    """The cut behind one of the three largest gaps, near the estimate at most, and never before the high scores."""
    w = Window.partitionBy("query_id")
    rows = ranked(scored).withColumn("next", F.lead("score").over(w.orderBy("rank")))
    rows = rows.withColumn("gap", F.when(F.col("rank") < 50, F.round(F.col("score") - F.col("next"), 6)))
    rows = rows.withColumn("gap_rank", F.row_number().over(w.orderBy(F.desc_nulls_last("gap"), F.desc("rank"))))
    good = (F.col("gap_rank") <= 3) & F.col("rank").between(least, cap) & (F.col("gap") > gap)
    best = F.min(F.when(good, F.struct("gap_rank", "rank"))).over(w)["rank"]
    cut = F.least(F.coalesce(best, F.col("estimate")), F.col("estimate") + 10)
    cut = F.least(F.greatest(cut, F.sum(F.when(F.col("score") >= high, 1).otherwise(0)).over(w)), F.lit(cap))
    return rows.withColumn("cut", cut).where("rank <= cut").drop("next", "gap", "gap_rank")


def knee(scored: DataFrame, least: int = 5, most: int = 45, noise: float = 0.0005) -> DataFrame:
    """The cut at the largest gap between two ranks, or where scores become noise if that comes first."""
    w = Window.partitionBy("query_id")
    rows = ranked(scored).withColumn("before", F.lag("score").over(w.orderBy("rank")))
    at = F.max(F.when((F.col("rank") > least) & (F.col("rank") <= most), F.struct(F.round(F.col("before") - F.col("score"), 6).alias("gap"), (-F.col("rank")).alias("at")))).over(w)["at"]
    quiet = F.min(F.when(F.col("score") < noise, F.col("rank"))).over(w)
    cut = F.least(F.coalesce(-at - 1, F.lit(most)), F.coalesce(quiet - 1, F.lit(most)))
    return rows.withColumn("cut", cut).where("rank <= cut").drop("before")


def smart_cut(scored: DataFrame, high: float = 0.8, least: int = 10, over: int = 8, cap: int = 40) -> DataFrame:
    """The estimate or the number of high scores; a floor, then two caps, in this order."""
    n = F.sum(F.when(F.col("score") >= high, 1).otherwise(0)).over(Window.partitionBy("query_id"))
    target = F.least(F.least(F.greatest(F.greatest(F.col("estimate"), n), F.lit(least)), F.col("estimate") + over), F.lit(cap))
    return ranked(scored).withColumn("target", target).where("rank <= target")


def kind_caps(scored: DataFrame, least: int = 15, most: int = 32, law_share: float = 0.55) -> DataFrame:
    """A share of the total for laws and the rest for courts, and whatever the query names."""
    total = F.greatest(F.lit(least), F.least(F.col("estimate"), F.lit(most)))
    law = F.floor(total * law_share)
    rank = F.row_number().over(Window.partitionBy("query_id", "kind").orderBy(F.desc("score"), "citation"))
    cap = F.when(F.col("kind") == "law", law).otherwise(total - law)
    return scored.withColumn("kind_rank", rank).where((F.col("kind_rank") <= cap) | F.col("is_explicit"))


def high_signal_cut(scored: DataFrame, high: float = 0.8, extend: float = 0.5, least: int = 10, most: int = 40) -> DataFrame:
    """The high scores and a bonus of a third of them, five at least, and on while scores stay above a bound."""
    w = Window.partitionBy("query_id")
    base = F.sum(F.when(F.col("score") >= high, 1).otherwise(0)).over(w)
    k = F.least(F.greatest(base + F.greatest(F.lit(5), F.floor(base * 0.3)), F.lit(least)), F.lit(most))
    above = F.sum(F.when(F.col("score") >= extend, 1).otherwise(0)).over(w)
    return ranked(scored).withColumn("target", F.least(F.greatest(k, above), F.lit(most))).where("rank <= target")


# Buckets and judgements.


@dataclass(frozen=True)
class Buckets:
    law_budget: int = 60
    court_budget: int = 36


def auto_keep() -> Column:
    """Candidates that need no judgement."""
    has = lambda s: F.array_contains("sources", s)
    freq, raw = F.col("freq"), F.col("raw_score")
    law = (freq >= 3) & (raw >= 0.95) | (freq >= 2) & has("gpt_specific") & (raw >= 0.92) | (freq >= 2) & has("gpt_specific_fuzzy") & (raw >= 0.88)
    court = (freq >= 3) & (raw >= 0.90) | (freq >= 2) & has("gpt_case") & (raw >= 0.85)
    return F.col("is_explicit") | F.when(F.col("kind") == "law", law).otherwise(court)


def auto_drop() -> Column:
    """Candidates that no weak source carries far enough."""
    only = lambda *s: F.size(F.array_except("sources", F.array(*map(F.lit, s)))) == 0
    score, court = F.col("final_score"), F.col("kind") == "court"
    rules = [
        score < 0.20,
        only("cocitation") & (F.size("sources") > 0),
        court & only("cocitation", "gpt_court_sibling") & (score < 0.72),
        court & only("court_dense") & (F.size("sources") > 0) & (score < 0.50),
        court & only("court_dense", "cocitation", "gpt_court_sibling") & (score < 0.58),
        ~court & only("dense") & (score < 0.35),
        ~court & only("bm25") & (score < 0.35),
        ~court & only("dense", "bm25") & (score < 0.40),
    ]
    out = rules[0]
    for r in rules[1:]:
        out = out | r
    return out


def bucketed(candidates: DataFrame, cfg: Buckets = Buckets()) -> DataFrame:
    """auto_bucket: keep before drop; of the rest, the best of each kind go to the judge and the others are dropped."""
    rows = candidates.withColumn("auto_bucket", F.when(auto_keep(), "auto_keep").when(auto_drop(), "auto_drop").otherwise("judge"))
    slot = F.row_number().over(Window.partitionBy("query_id", "kind", "auto_bucket").orderBy("baseline_rank", "citation"))
    budget = F.when(F.col("kind") == "law", cfg.law_budget).otherwise(cfg.court_budget)
    return rows.withColumn("slot", slot).withColumn("auto_bucket", F.when((F.col("auto_bucket") == "judge") & (F.col("slot") > budget), "auto_drop").otherwise(F.col("auto_bucket")))


def rule_judge(final_score: Column) -> Column:
    return F.when(final_score >= 0.5, "plausible").otherwise("reject")


def judge_batches(candidates: DataFrame, law: int = 20, court: int = 12) -> DataFrame:
    """batch number, and id from 1 within it, in rank order of each kind."""
    n = F.row_number().over(Window.partitionBy("query_id", "kind").orderBy("baseline_rank", "citation")) - 1
    size = F.when(F.col("kind") == "law", law).otherwise(court)
    return candidates.withColumn("batch", F.floor(n / size).cast("int")).withColumn("id", (n % size + 1).cast("int"))


def decisions(raw: DataFrame) -> DataFrame:
    """(query_id, id, label, confidence) of raw answers (query_id, pos, id, label, confidence as text).

    Ids that are no numbers are skipped, unknown labels are rejections,
    confidences are held to 0..1, and the last answer for an id counts.
    """
    label = F.lower(F.trim(F.coalesce("label", F.lit("reject"))))
    rows = raw.select("query_id", "pos", F.expr("try_cast(id AS INT)").alias("id"), F.when(label.isin("must_include", "plausible", "reject"), label).otherwise("reject").alias("label"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.expr("try_cast(confidence AS DOUBLE)"), F.lit(0.0)))).alias("confidence"))
    last = F.max_by(F.struct("label", "confidence"), "pos")
    return rows.where("id IS NOT NULL").groupBy("query_id", "id").agg(last.alias("d")).select("query_id", "id", "d.label", "d.confidence")


def judged(candidates: DataFrame, answers: DataFrame) -> DataFrame:
    """judge_label and judge_confidence: kept and dropped ones by rule, the others by their answer or rejected."""
    rows = candidates.join(answers.select("query_id", "citation", "label", "confidence"), ["query_id", "citation"], "left")
    label = F.when(F.col("auto_bucket") == "auto_keep", "must_include").when(F.col("auto_bucket") == "auto_drop", "reject").otherwise(F.coalesce("label", F.lit("reject")))
    confidence = F.when(F.col("auto_bucket") == "auto_keep", 1.0).when(F.col("auto_bucket") == "auto_drop", 0.0).otherwise(F.coalesce("confidence", F.lit(0.0)))
    return rows.withColumn("judge_label", label).withColumn("judge_confidence", confidence).drop("label", "confidence")


def consensus(passes: DataFrame) -> DataFrame:
    """Majority of several passes (query_id, citation, pass, label, confidence)."""
    must, positive = F.count_if(F.col("label") == "must_include"), F.count_if(F.col("label").isin("must_include", "plausible"))
    rows = passes.groupBy("query_id", "citation").agg(F.count("label").alias("n"), must.alias("must"), positive.alias("positive"), F.round(F.avg("confidence"), 6).alias("mean_confidence"), F.min("confidence").alias("min_confidence"), F.max("confidence").alias("max_confidence"))
    return rows.withColumn("label", F.when(F.col("must") * 2 > F.col("n"), "must_include").when(F.col("positive") * 2 > F.col("n"), "plausible").otherwise("reject"))
