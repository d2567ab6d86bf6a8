"""Feature sets of the learned selectors, as columns of judged candidates; all values are built-in expressions.

Candidates have query_id, citation, kind, raw_score, final_score, freq, dense_rank,
bm25_rank, court_dense_rank, baseline_rank, is_explicit, is_query_case, sources,
estimate, auto_bucket, judge_label and judge_confidence; a missing rank is null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexquarry.functions import text as fn
from lexquarry.operators.learn import inverse_rank

#: Fixed values of the feature sets.
LABELS = ["reject", "plausible", "must_include"]
STATUTES = ["ZGB", "OR", "StGB", "BV", "BGG", "StPO", "SchKG", "ZPO", "ATSG", "IVG", "IPRG", "DBG", "URG", "DSG", "RPG", "JStG"]


def _flag(x: Column) -> Column:
    return F.coalesce(x, F.lit(False)).cast("int")


def _inverse(name: str) -> Column:
    return F.round(F.coalesce(inverse_rank(F.col(name)), F.lit(0.0)), 6)


def _bucket() -> Column:
    return F.when(F.col("auto_bucket").isin("auto_drop", "auto_keep"), F.col("auto_bucket")).otherwise("other")


def kinds() -> dict[str, Column]:
    return {"is_law": _flag(F.col("kind") == "law"), "is_court": _flag(F.col("kind") == "court")}


def buckets() -> dict[str, Column]:
    return {f"bucket_{b}": _flag(_bucket() == b) for b in ("auto_drop", "auto_keep", "other")}


def labels() -> dict[str, Column]:
    return {f"label_{x}": _flag(F.col("judge_label") == x) for x in LABELS}


def sources(names: list[str]) -> dict[str, Column]:
    return {f"src_{s}": _flag(F.array_contains("sources", s)) for s in names}


def ranks(names: tuple[str, ...] = ("dense_rank", "bm25_rank", "court_dense_rank")) -> dict[str, Column]:
    return {f"inv_{n}": _inverse(n) for n in names}


def meta(candidates: DataFrame, names: list[str]) -> DataFrame:
    """Kind, label and bucket one-hots, scores, inverse ranks, source one-hots and counts."""
    rest = {"confidence": F.col("judge_confidence"), "final": F.col("final_score"), "raw": F.col("raw_score"), "gpt_freq": F.col("freq"), "explicit": _flag(F.col("is_explicit")), "query_case": _flag(F.col("is_query_case"))}
    return _columns(candidates, kinds() | labels() | buckets() | rest | ranks() | sources(names) | {"n_sources": F.size("sources"), "estimated": F.col("estimate")})


#: What a judge adds to the features.
JUDGE = ("label_", "confidence", "bonus", "law_must", "must_kept", "final_conf", "conf_pct", "conf_top10")


def masked(features: DataFrame) -> DataFrame:
    """The same columns with everything a judge adds at zero, for an ablation."""
    return features.select([F.lit(0).cast(t).alias(c) if c.startswith(JUDGE) else F.col(c) for c, t in features.dtypes])


def train(candidates: DataFrame, names: list[str], priors: DataFrame, codes: list[str]) -> DataFrame:
    """Without a judge: scores, frequency steps, forms, pool counts, priors (level, key, n) and statute one-hots."""
    q, c = Window.partitionBy("query_id"), F.col("citation")
    rows = candidates
    for level, key in (("exact", c), ("base", F.when(fn.is_law(c), fn.law_base_by_tokens(c)).otherwise(fn.court_base(c))), ("code", fn.statute_code(c))):
        own = priors.where(F.col("level") == level).select(F.col("key").alias(f"key_{level}"), F.col("n").alias(f"prior_{level}"))
        rows = rows.withColumn(f"key_{level}", key).join(own, f"key_{level}", "left")
    steps = {f"freq_{k}": _flag(F.col("freq") >= k) for k in (1, 2, 3)}
    forms = {"form_art": _flag(c.startswith("Art. ")), "form_bge": _flag(c.startswith("BGE ")), "form_bger": _flag(c.startswith("BGer ")), "form_e": _flag(F.contains(c, F.lit(" E. ")))}
    pool = {"n_sources": F.size("sources"), "estimated": F.col("estimate"), "pool": F.count("*").over(q), "laws": F.count_if(F.col("kind") == "law").over(q), "courts": F.count_if(F.col("kind") != "law").over(q)}
    before = {f"prior_{x}": F.coalesce(f"prior_{x}", F.lit(0)) for x in ("exact", "base", "code")}
    scores = {"raw": F.col("raw_score"), "final": F.col("final_score"), "lift": F.round(F.col("final_score") - F.col("raw_score"), 6), "gpt_freq": F.col("freq"), "explicit": _flag(F.col("is_explicit")), "query_case": _flag(F.col("is_query_case"))}
    hot = {f"code_{x}": _flag(fn.statute_code(c) == x) for x in codes}
    return _columns(rows, kinds() | buckets() | scores | steps | forms | ranks(("baseline_rank", "dense_rank", "bm25_rank", "court_dense_rank")) | pool | before | sources(names) | hot)


def boosted(candidates: DataFrame, names: list[str]) -> DataFrame:
    """The eight groups of the boosted trees: retrieval, judge, bucket, sources, forms, context, crosses, place in the list."""
    q, c = Window.partitionBy("query_id"), F.col("citation")
    n = F.count("*").over(q)
    law, must = F.col("kind") == "law", F.col("judge_label") == "must_include"
    place = F.row_number().over(q.orderBy(F.desc("final_score"), "citation")) - 1
    sure = F.row_number().over(q.orderBy(F.desc("judge_confidence"), "citation")) - 1
    share = lambda at: F.round(at / F.greatest(n - 1, F.lit(1)), 6)
    freq, final, conf, size = F.col("freq"), F.col("final_score"), F.col("judge_confidence"), F.size("sources")
    bonus = F.when(must, 2.0).when(F.col("judge_label") == "plausible", 1.0).otherwise(0.0)
    retrieval = {"raw": F.col("raw_score"), "final": final, "lift": F.round(final - F.col("raw_score"), 6), "gpt_freq": freq, "freq_1": _flag(freq >= 1), "freq_2": _flag(freq >= 2), "explicit": _flag(F.col("is_explicit")), "query_case": _flag(F.col("is_query_case"))}
    judge = {"confidence": conf, "bonus": F.round(bonus * conf, 6)}
    counts = {"n_sources": size, "agree": _flag(size >= 2)}
    statute = F.when(fn.is_law(c), fn.statute_token(c)).otherwise("")
    forms = {"form_art": _flag(fn.is_law(c)), "form_bge": _flag(c.startswith("BGE"))} | {f"code_{s}": _flag(statute == s) for s in STATUTES}
    context = {"estimated": F.col("estimate"), "log_estimated": F.round(F.log1p("estimate"), 6), "pool": n, "laws": F.count_if(law).over(q), "courts": F.count_if(~law).over(q), "rank_pct": share(place)}
    crosses = {
        "law_must": _flag(law & must), "law_freq": _flag(law) * freq, "court_inv": _flag(F.col("kind") == "court") * _inverse("court_dense_rank"),
        "must_kept": _flag(must & (F.col("auto_bucket") == "auto_keep")), "final_conf": F.round(final * conf, 6), "both_near": _flag((F.col("dense_rank") < 50) & (F.col("bm25_rank") < 50)),
    }
    near = {"score_pct": share(place), "conf_pct": share(sure), "top_5pct": _flag(share(place) <= 0.05), "conf_top10": _flag(sure < 10)}
    return _columns(candidates, kinds() | retrieval | ranks(("dense_rank", "bm25_rank", "court_dense_rank", "baseline_rank")) | labels() | judge | buckets() | sources(names) | counts | forms | context | crosses | near)


def _columns(rows: DataFrame, columns: dict[str, Column]) -> DataFrame:
    return rows.select("query_id", "citation", *[x.alias(name) for name, x in columns.items()])
