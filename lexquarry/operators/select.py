"""Budgeted selection in window form.

A greedy scan that skips rows over a cap, and stops at the first score below a
threshold, accepts a row by its place in the scan's order alone; so each cap is
a rank within its group, and the budget a rank among what the caps leave.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Staged:
    must_confidence: float = 0.86
    min_output: int = 10
    max_output: int = 40
    over: int = 8
    court_fraction: float = 0.25
    min_courts: int = 4


def staged_target(estimate: Column, locked: Column, cfg: Staged = Staged()) -> Column:
    """The order of the bounds matters: a small estimate beats the smallest output."""
    return F.least(F.least(F.greatest(F.greatest(estimate, locked), F.lit(cfg.min_output)), estimate + cfg.over), F.lit(cfg.max_output))


def staged(judged: DataFrame, cfg: Staged = Staged()) -> DataFrame:
    """Locked candidates, then courts up to a share of the target, then the rest; `position` is the order of selection."""
    q = Window.partitionBy("query_id")
    label = F.when(F.col("judge_label") == "must_include", 2).otherwise(1)
    rows = judged.where(F.col("judge_label").isin("must_include", "plausible"))
    rows = rows.withColumn("ord", F.row_number().over(q.orderBy(label.desc(), F.desc("judge_confidence"), F.desc("final_score"), "citation")))
    rows = rows.withColumn("locked", (F.col("judge_label") == "must_include") & ((F.col("auto_bucket") == "auto_keep") | (F.col("judge_confidence") >= cfg.must_confidence)))
    rows = rows.withColumn("target", staged_target(F.col("estimate"), F.count_if("locked").over(q), cfg))
    rows = rows.withColumn("first", F.col("locked") & (F.count_if("locked").over(q.orderBy("ord")) <= F.col("target")))
    court = F.col("kind") == "court"
    rows = rows.withColumn("n1", F.count_if("first").over(q)).withColumn("c1", F.count_if(F.col("first") & court).over(q))
    soft = F.greatest(F.lit(cfg.min_courts), F.bround(F.col("target") * cfg.court_fraction))
    more = F.greatest(F.lit(0), F.least(soft - F.col("c1"), F.col("target") - F.col("n1")))
    second = court & ~F.col("first") & (F.count_if(court & ~F.col("first")).over(q.orderBy("ord")) <= more)
    rows = rows.withColumn("phase", F.when(F.col("first"), 1).when(second, 2).otherwise(3))
    rows = rows.withColumn("position", F.row_number().over(q.orderBy("phase", "ord")))
    return rows.where(F.col("position") <= F.col("target")).drop("ord", "locked", "first", "n1", "c1")


def greedy(scored: DataFrame, target: Column, court_cap: Column, threshold: Column, floor: Column, keys: list[str] | None = None, score: str = "prob") -> DataFrame:
    """Best first up to the target; courts over their cap are skipped; below the threshold only up to the floor."""
    keys = keys or ["query_id"]
    order = [F.desc(score), F.asc("citation")]
    of_kind = F.row_number().over(Window.partitionBy(*keys, "kind").orderBy(*order))
    left = scored.withColumn("kind_rank", of_kind).where((F.col("kind") != "court") | (F.col("kind_rank") <= court_cap))
    left = left.withColumn("position", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return left.where((F.col("position") <= target) & ((F.col(score) >= threshold) | (F.col("position") <= floor)))


def per_base(scored: DataFrame, target: Column, law_cap: int, court_base_cap: int, court_cap: int, score: str = "prob") -> DataFrame:
    """As greedy, with caps for each base of a law or a decision as well."""
    order = [F.desc(score), F.asc("citation")]
    in_base = F.row_number().over(Window.partitionBy("query_id", "kind", "base").orderBy(*order))
    left = scored.withColumn("base_rank", in_base).where(F.col("base_rank") <= F.when(F.col("kind") == "law", law_cap).otherwise(court_base_cap))
    return greedy(left, target, F.lit(court_cap), F.lit(float("-inf")), F.lit(0), score=score)


def must_first(scored: DataFrame, target: Column, score: str = "prob") -> DataFrame:
    """All must_include candidates by score, then the others, up to the target."""
    order = [F.when(F.col("judge_label") == "must_include", 0).otherwise(1), F.desc(score), F.asc("citation")]
    return scored.withColumn("position", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).where(F.col("position") <= target)


@dataclass(frozen=True)
class Forced:
    """The target is mult * estimate + bias, halves to even, at least min_output, then at most max_output; courts have a share of it."""

    mult: float = 1.0
    bias: float = 0.0
    min_output: int = 5
    max_output: int = 40
    threshold: float = 0.5
    court_fraction: float = 0.25
    keep_explicit: bool = True
    keep_auto: bool = True


def forced(scored: DataFrame, cfg: Forced = Forced()) -> DataFrame:
    """Selection with forced rows: first those that the query names, whatever target and cap say; then kept buckets; then greedily.

    scored has query_id, citation, kind, prob, is_explicit, auto_bucket, final_score,
    baseline_rank and estimate.  A kept bucket that fills the target ends the
    selection, and the first one is taken even if the named rows have filled it.  In
    the third stage the target, and the threshold once min_output rows are there, end
    it.  Courts beyond their cap are passed over in the last two stages.  So a row's
    fate is its rank in its stage; `position` is the order of selection.  Null flags
    are false; a null prob is below every threshold.
    """
    q, court = Window.partitionBy("query_id"), F.col("kind") == "court"
    named, kept = F.coalesce("is_explicit", F.lit(False)), F.coalesce(F.col("auto_bucket") == "auto_keep", F.lit(False))
    target = F.least(F.greatest(F.bround(F.col("estimate") * cfg.mult + cfg.bias), F.lit(cfg.min_output)), F.lit(cfg.max_output))
    order = [F.desc("prob"), named.desc(), kept.desc(), F.desc("final_score"), F.asc("baseline_rank"), F.asc("citation")]
    stage = F.lit(3)
    if cfg.keep_auto:
        stage = F.when(kept, 2).otherwise(stage)
    if cfg.keep_explicit:
        stage = F.when(named, 1).otherwise(stage)
    rows = scored.withColumn("ord", F.row_number().over(q.orderBy(*order))).withColumn("stage", stage).withColumn("target", target)
    rows = rows.withColumn("left", F.greatest(F.lit(0), F.greatest(F.lit(0), F.bround(F.col("target") * cfg.court_fraction)) - F.count_if(court & (F.col("stage") == 1)).over(q)))
    rows = rows.withColumn("of_kind", F.row_number().over(Window.partitionBy("query_id", "stage", "kind").orderBy("ord")))
    second = F.least(F.count_if(court & (F.col("stage") == 2)).over(q), F.col("left"))
    rows = rows.withColumn("cap", F.col("left") - F.when(F.col("stage") == 3, second).otherwise(0))
    rows = rows.where(~court | (F.col("stage") == 1) | (F.col("of_kind") <= F.col("cap")))
    rows = rows.withColumn("first", F.count_if(F.col("stage") == 1).over(q)).withColumn("of_stage", F.row_number().over(Window.partitionBy("query_id", "stage").orderBy("ord")))
    rows = rows.where((F.col("stage") != 2) | (F.col("of_stage") <= F.greatest(F.lit(1), F.col("target") - F.col("first"))))
    rows = rows.withColumn("position", F.row_number().over(q.orderBy("stage", "ord")))
    good = (F.col("position") <= F.col("target")) & (F.coalesce(F.col("prob") >= cfg.threshold, F.lit(False)) | (F.col("position") <= cfg.min_output))
    return rows.where((F.col("stage") < 3) | good).select(*scored.columns, "position")


def meta_target(estimate: Column, mult: Column, bias: Column, least: Column, most: Column, least_first: bool = True) -> Column:
    """A target that follows the estimate, halves to even; with `least_first` the largest output beats the smallest, else the other way."""
    raw = F.bround(estimate * mult + bias)
    return F.least(most, F.greatest(least, raw)) if least_first else F.greatest(least, F.least(most, raw))
