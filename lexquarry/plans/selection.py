"""Queries over candidates: fusion, cutoffs, buckets, judgements and budgeted selection."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lexquarry.functions import text as fn
from lexquarry.operators import fusion, select
from lexquarry.plans import base
from lexquarry.plans.base import CANDIDATES, FUSED, WITH_HITS, register

_C = f"{WITH_HITS}, {CANDIDATES}"


@register(f"{WITH_HITS}, {FUSED} SELECT query_id, citation, raw_score, array_to_string(sources, ';') AS sources, freq, dense_rank, bm25_rank, court_dense_rank, is_explicit, is_query_case FROM fused")
def fusion_max_merge(spark, sf_dir):
    return fusion.fuse(base.hits(spark, sf_dir)).withColumn("sources", F.array_join("sources", ";"))


@register(f"{_C} SELECT query_id, citation, raw_score, final_score FROM candidates")
def agreement_boost(spark, sf_dir):
    return base.candidates(spark, sf_dir).select("query_id", "citation", "raw_score", "final_score")


@register(f"{WITH_HITS} SELECT event_id, CASE WHEN kind = 'law' THEN least(0.80 + freq * 0.05, 0.95) ELSE least(0.78 + freq * 0.05, 0.93) END AS run_score FROM hits".replace("SELECT event_id, CASE", "SELECT event_id, round(CASE").replace("END AS run_score", "END::DOUBLE, 4) AS run_score"))
def run_frequency_score(spark, sf_dir):
    return base.hits(spark, sf_dir).select("event_id", F.round(fusion.run_score(F.col("kind"), F.col("freq")), 4).alias("run_score"))


@register(rf"""{_C}, known AS (SELECT DISTINCT citation FROM hits WHERE kind = 'court'), scored AS (SELECT query_id, citation, final_score AS score FROM candidates),
mentions AS (SELECT query_id, citation, min(event_id) AS pos FROM hits WHERE kind = 'court' GROUP BY ALL),
parents AS (SELECT query_id, trim(regexp_replace(citation, '\s+E\.\s+.*$', '')) AS base, citation FROM mentions QUALIFY row_number() OVER (PARTITION BY query_id, base ORDER BY pos, citation) = 1),
sib AS (SELECT trim(regexp_replace(citation, '\s+E\.\s+.*$', '')) AS base, citation FROM known QUALIFY row_number() OVER (PARTITION BY base ORDER BY citation) <= 15)
SELECT p.query_id, s.citation, round(coalesce(c.score, 0.5) * 0.3, 6) AS score FROM parents p JOIN sib s USING (base) LEFT JOIN scored c ON c.query_id = p.query_id AND c.citation = p.citation
WHERE NOT EXISTS (FROM scored x WHERE x.query_id = p.query_id AND x.citation = s.citation)""")
def cocitation_expand(spark, sf_dir):
    rows = base.hits(spark, sf_dir)
    scored = base.candidates(spark, sf_dir).select("query_id", "citation", F.col("final_score").alias("score"))
    mentions = rows.where("kind = 'court'").groupBy("query_id", "citation").agg(F.min("event_id").alias("pos"))
    found = fusion.cocited(scored, mentions, rows.where("kind = 'court'").select("citation"))
    return found.withColumn("score", F.round("score", 6))


@register(f"{_C}, k AS (SELECT range AS query_id, unnest(['Art. 10 Abs. 1 BGG', 'Art. 999 BGG']) AS citation, 0.8 AS score FROM range(42)), known AS (SELECT DISTINCT citation FROM hits) SELECT query_id, citation, max(score)::DOUBLE AS score FROM (SELECT query_id, citation, final_score AS score FROM candidates UNION ALL FROM k SEMI JOIN known USING (citation)) GROUP BY ALL")
def boilerplate_floor(spark, sf_dir):
    scored = base.candidates(spark, sf_dir).select("query_id", "citation", F.col("final_score").alias("score"))
    known = base.hits(spark, sf_dir).select("citation")
    once = fusion.with_floor(scored, base.queries(spark, sf_dir), "Art. 10 Abs. 1 BGG", 0.8, known)
    return fusion.with_floor(once, base.queries(spark, sf_dir), "Art. 999 BGG", 0.8, known)  # which the corpus lacks


@register(f"""{_C} SELECT query_id, citation, round(CASE WHEN contains(citation, 'ZGB') AND contains(citation, 'GB') THEN least(least(raw_score * 1.3, 0.92) * 1.3, 0.92) WHEN contains(citation, 'GB') OR contains(citation, 'ZGB') THEN least(raw_score * 1.3, 0.92) ELSE raw_score END, 4) AS score FROM candidates""")
def statute_boost(spark, sf_dir):
    statutes = F.array(F.lit("ZGB"), F.lit("GB"))
    return base.candidates(spark, sf_dir).select("query_id", "citation", F.round(fusion.statute_boost(F.col("raw_score"), F.col("citation"), statutes), 4).alias("score"))


@register(f"""{_C}, known AS (SELECT DISTINCT citation FROM hits WHERE score < 0.5) SELECT query_id, citation, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, citation) AS baseline_rank FROM candidates c
WHERE is_explicit OR citation IN (FROM known)""".replace("SELECT query_id, citation, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, citation) AS baseline_rank FROM", "SELECT query_id, citation, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, citation) AS place FROM"))
def verified_rank(spark, sf_dir):
    known = base.hits(spark, sf_dir).where("score < 0.5").select("citation")
    rows = base.candidates(spark, sf_dir).drop("baseline_rank")
    return fusion.verified(rows, known).select("query_id", "citation", "score", F.col("baseline_rank").alias("place"))


@register(f"{_C} SELECT query_id, citation, array_to_string(list_concat(list_filter([CASE WHEN freq > 0 THEN concat('predicted_by_', freq, '_gpt_runs') END, CASE WHEN is_explicit THEN 'citation_appears_in_question' END, CASE WHEN is_query_case THEN 'gpt_case_citation' END, 'law_dense_rank=' || dense_rank, 'court_dense_rank=' || court_dense_rank, 'bm25_rank=' || bm25_rank], lambda x: x IS NOT NULL), list_filter(sources, lambda x: x NOT IN ('dense', 'bm25')))[1:8], ';') AS evidence FROM candidates")
def evidence_strings(spark, sf_dir):
    notes = fn.evidence(*[F.col(c) for c in ("freq", "is_explicit", "is_query_case", "dense_rank", "court_dense_rank", "bm25_rank", "sources")])
    return base.candidates(spark, sf_dir).select("query_id", "citation", F.array_join(notes, ";").alias("evidence"))


#: Scores with gaps of all sizes.
_M = "1.0D / (1 + (coalesce(dense_rank, 0) * 7 + coalesce(bm25_rank, 0) * 3 + freq) % 97)"
_SPREAD = f"spread AS (SELECT * REPLACE (round({_M.replace('1.0D', '1.0::DOUBLE')}, 6) AS score) FROM candidates)"


def _spread(spark, sf_dir):
    return base.candidates(spark, sf_dir).drop("baseline_rank").withColumn("score", F.round(F.expr(_M), 6))


_K = "SELECT query_id, citation, baseline_rank AS rank FROM x WHERE baseline_rank <= "


@register(f"{_C}, x AS (SELECT *, count(*) FILTER (score >= 0.98 * top) OVER (PARTITION BY query_id) AS above FROM (SELECT *, max(score) OVER (PARTITION BY query_id) AS top FROM candidates)) {_K} least(greatest(estimate, 15, above), 60)")
def cutoff_threshold_walk(spark, sf_dir):
    rows = base.candidates(spark, sf_dir).drop("baseline_rank")
    return fusion.threshold_walk(rows, 0.98, 15, 60).select("query_id", "citation", "rank")


@register(f"""{_C}, {_SPREAD}, thin AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, citation) AS rank FROM spread),
g AS (SELECT *, CASE WHEN rank < 50 THEN round(score - lead(score) OVER (PARTITION BY query_id ORDER BY rank), 6) END AS gap FROM thin), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY gap DESC NULLS LAST, rank DESC) AS gap_rank FROM g),
c AS (SELECT query_id, any_value(estimate) AS estimate, arg_min(rank, gap_rank) FILTER (gap_rank <= 3 AND rank BETWEEN 5 AND 45 AND gap > 0.02) AS best, count(*) FILTER (score >= 0.6) AS high FROM r GROUP BY ALL)
SELECT r.query_id, citation, rank FROM r JOIN c USING (query_id) WHERE rank <= least(greatest(least(coalesce(best, c.estimate), c.estimate + 10), high), 45)""")
def cutoff_gap_elbow(spark, sf_dir):
    rows = _spread(spark, sf_dir)
    return fusion.gap_elbow(rows).select("query_id", "citation", "rank")


@register(f"""{_C}, {_SPREAD}, thin AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, citation) AS rank FROM spread),
g AS (SELECT *, round(lag(score) OVER (PARTITION BY query_id ORDER BY rank) - score, 6) AS gap FROM thin),
c AS (SELECT query_id, arg_max(rank, row(gap, 0 - rank)) FILTER (rank > 5 AND rank <= 45) AS best, min(rank) FILTER (score < 0.2) AS quiet FROM g GROUP BY ALL)
SELECT g.query_id, citation, rank FROM g JOIN c USING (query_id) WHERE rank <= least(coalesce(best - 1, 45), coalesce(quiet - 1, 45))""")
def cutoff_knee(spark, sf_dir):
    rows = _spread(spark, sf_dir)
    return fusion.knee(rows, noise=0.2).select("query_id", "citation", "rank")


@register(f"{_C}, x AS (SELECT *, count(*) FILTER (score >= 0.97) OVER (PARTITION BY query_id) AS high FROM candidates) {_K} least(least(greatest(greatest(estimate, high), 10), estimate + 8), 40)")
def cutoff_smart(spark, sf_dir):
    return fusion.smart_cut(base.candidates(spark, sf_dir).drop("baseline_rank"), high=0.97).select("query_id", "citation", "rank")


@register(f"{_C}, x AS (SELECT *, count(*) FILTER (score >= 0.975) OVER (PARTITION BY query_id) AS b, count(*) FILTER (score >= 0.97) OVER (PARTITION BY query_id) AS above FROM candidates) {_K} least(greatest(least(greatest(b + greatest(5, floor(b * 0.3)), 10), 40), above), 40)")
def cutoff_high_signal(spark, sf_dir):
    return fusion.high_signal_cut(base.candidates(spark, sf_dir).drop("baseline_rank"), 0.975, 0.97).select("query_id", "citation", "rank")


@register(f"{_C}, x AS (SELECT *, row_number() OVER (PARTITION BY query_id, kind ORDER BY score DESC, citation) AS kr, greatest(15, least(estimate, 32)) AS total FROM candidates) SELECT query_id, citation, kind FROM x WHERE is_explicit OR kr <= CASE WHEN kind = 'law' THEN floor(total * 0.55) ELSE total - floor(total * 0.55) END")
def cutoff_kind_caps(spark, sf_dir):
    return fusion.kind_caps(base.candidates(spark, sf_dir)).select("query_id", "citation", "kind")


@register(f"{_C}, ks AS (SELECT unnest([5, 10, 20, 40]) AS k) SELECT k, count(*) AS n, count(DISTINCT query_id) AS queries, count(*) FILTER (kind = 'court') AS courts FROM candidates JOIN ks ON baseline_rank <= k GROUP BY k")
def topk_sweep(spark, sf_dir):
    ks = spark.createDataFrame([(k,) for k in (5, 10, 20, 40)], "k int")
    rows = base.candidates(spark, sf_dir).join(F.broadcast(ks), F.col("baseline_rank") <= F.col("k"))
    return rows.groupBy("k").agg(F.count("*").alias("n"), F.count_distinct("query_id").alias("queries"), F.count_if(F.col("kind") == "court").alias("courts"))


_KEEP = """(is_explicit OR CASE WHEN kind = 'law' THEN freq >= 3 AND raw_score >= 0.95 OR freq >= 2 AND list_contains(sources, 'gpt_specific') AND raw_score >= 0.92 OR freq >= 2 AND list_contains(sources, 'gpt_specific_fuzzy') AND raw_score >= 0.88
 ELSE freq >= 3 AND raw_score >= 0.90 OR freq >= 2 AND list_contains(sources, 'gpt_case') AND raw_score >= 0.85 END)"""
_DROP = """(final_score < 0.2 OR sources = ['cocitation'] OR kind = 'court' AND len(list_filter(sources, lambda s: s NOT IN ('cocitation', 'gpt_court_sibling'))) = 0 AND final_score < 0.72
 OR kind = 'court' AND sources = ['court_dense'] AND final_score < 0.5 OR kind = 'court' AND len(list_filter(sources, lambda s: s NOT IN ('court_dense', 'cocitation', 'gpt_court_sibling'))) = 0 AND final_score < 0.58
 OR kind = 'law' AND len(list_filter(sources, lambda s: s <> 'dense')) = 0 AND final_score < 0.35 OR kind = 'law' AND len(list_filter(sources, lambda s: s <> 'bm25')) = 0 AND final_score < 0.35
 OR kind = 'law' AND len(list_filter(sources, lambda s: s NOT IN ('dense', 'bm25'))) = 0 AND final_score < 0.4)"""


@register(f"{_C} SELECT query_id, citation, {_KEEP} AS keep FROM candidates")
def auto_keep(spark, sf_dir):
    return base.candidates(spark, sf_dir).select("query_id", "citation", fusion.auto_keep().alias("keep"))


@register(f"{_C} SELECT query_id, citation, {_DROP} AS gone FROM candidates")
def auto_drop(spark, sf_dir):
    return base.candidates(spark, sf_dir).select("query_id", "citation", fusion.auto_drop().alias("gone"))


_BUCKETS = f"""b0 AS (SELECT *, CASE WHEN {_KEEP} THEN 'auto_keep' WHEN {_DROP} THEN 'auto_drop' ELSE 'judge' END AS b FROM candidates),
bucketed AS (SELECT * EXCLUDE (b), CASE WHEN b = 'judge' AND row_number() OVER (PARTITION BY query_id, kind, b ORDER BY baseline_rank, citation) > CASE WHEN kind = 'law' THEN 60 ELSE 36 END THEN 'auto_drop' ELSE b END AS auto_bucket FROM b0)"""


@register(f"{_C}, {_BUCKETS} SELECT query_id, citation, auto_bucket FROM bucketed")
def bucket_overflow(spark, sf_dir):
    return fusion.bucketed(base.candidates(spark, sf_dir)).select("query_id", "citation", "auto_bucket")


_JUDGED = """judged AS (SELECT *, CASE auto_bucket WHEN 'auto_keep' THEN 'must_include' WHEN 'auto_drop' THEN 'reject' ELSE CASE WHEN final_score >= 0.5 THEN CASE WHEN baseline_rank % 3 = 0 THEN 'must_include' ELSE 'plausible' END ELSE 'reject' END END AS judge_label,
 CASE auto_bucket WHEN 'auto_keep' THEN 1.0 WHEN 'auto_drop' THEN 0.0 ELSE CAST(baseline_rank % 50 AS DOUBLE) / 50 END::DOUBLE AS judge_confidence FROM bucketed)"""


def judged(spark, sf_dir):
    """Buckets with answers by rule; every third plausible one is made a must."""
    rows = fusion.bucketed(base.candidates(spark, sf_dir))
    label = F.when((fusion.rule_judge(F.col("final_score")) == "plausible") & (F.col("baseline_rank") % 3 == 0), "must_include").otherwise(fusion.rule_judge(F.col("final_score")))
    answers = rows.where("auto_bucket = 'judge'").select("query_id", "citation", label.alias("label"), ((F.col("baseline_rank") % 50).cast("double") / 50).alias("confidence"))
    return fusion.judged(rows, answers)


@register(f"{_C}, {_BUCKETS}, {_JUDGED} SELECT judge_label, kind, auto_bucket, count(*) AS n, round(avg(judge_confidence), 4) AS confidence FROM judged GROUP BY ALL")
def judge_rule(spark, sf_dir):
    return judged(spark, sf_dir).groupBy("judge_label", "kind", "auto_bucket").agg(F.count("*").alias("n"), F.round(F.avg("judge_confidence"), 4).alias("confidence"))


@register(f"{_C}, x AS (SELECT *, row_number() OVER (PARTITION BY query_id, kind ORDER BY baseline_rank, citation) - 1 AS n, CASE WHEN kind = 'law' THEN 20 ELSE 12 END AS size FROM candidates) SELECT query_id, citation, (n // size)::INTEGER AS batch, (n % size + 1)::INTEGER AS id FROM x")
def judge_batches(spark, sf_dir):
    return fusion.judge_batches(base.candidates(spark, sf_dir)).select("query_id", "citation", "batch", "id")


_RAW = ["query_id", "event_id AS pos", "CASE WHEN event_id % 11 = 0 THEN 'x' ELSE CAST(event_id % 50 AS STRING) END AS id", "CASE event_id % 5 WHEN 0 THEN ' Must_Include' WHEN 1 THEN 'plausible' WHEN 2 THEN 'MAYBE' WHEN 3 THEN 'reject' END AS label", "CASE event_id % 4 WHEN 0 THEN '1.7' WHEN 1 THEN 'high' WHEN 2 THEN '-0.2' ELSE '0.45' END AS confidence"]


@register(f"""{WITH_HITS}, raw AS (SELECT {', '.join(_RAW)} FROM hits), n AS (SELECT query_id, pos, TRY_CAST(id AS INTEGER) AS id, CASE WHEN lower(trim(coalesce(label, 'reject'))) IN ('must_include', 'plausible', 'reject') THEN lower(trim(coalesce(label, 'reject'))) ELSE 'reject' END AS label,
 greatest(0, least(1, coalesce(TRY_CAST(confidence AS DOUBLE), 0))) AS confidence FROM raw) SELECT query_id, id, arg_max(label, pos) AS label, arg_max(confidence, pos) AS confidence FROM n WHERE id IS NOT NULL GROUP BY ALL""")
def decision_normalize(spark, sf_dir):
    return fusion.decisions(base.hits(spark, sf_dir).selectExpr(*_RAW))


@register(f"""{WITH_HITS}, p AS (SELECT query_id, citation, event_id % 3 AS pass, min(CASE event_id % 4 WHEN 0 THEN 'must_include' WHEN 1 THEN 'plausible' ELSE 'reject' END) AS label, max(score) AS confidence FROM hits GROUP BY ALL)
SELECT query_id, citation, count(*) AS n, count(*) FILTER (label = 'must_include') AS must, count(*) FILTER (label <> 'reject') AS positive, round(avg(confidence), 4) AS mean_confidence, CASE WHEN count(*) FILTER (label = 'must_include') * 2 > count(*) THEN 'must_include' WHEN count(*) FILTER (label <> 'reject') * 2 > count(*) THEN 'plausible' ELSE 'reject' END AS label FROM p GROUP BY ALL""")
def multipass_consensus(spark, sf_dir):
    label = F.expr("CASE event_id % 4 WHEN 0 THEN 'must_include' WHEN 1 THEN 'plausible' ELSE 'reject' END")
    passes = base.hits(spark, sf_dir).groupBy("query_id", "citation", (F.col("event_id") % 3).alias("pass")).agg(F.min(label).alias("label"), F.max("score").alias("confidence"))
    return fusion.consensus(passes).select("query_id", "citation", "n", "must", "positive", F.round("mean_confidence", 4).alias("mean_confidence"), "label")


@register(f"""{_C}, {_BUCKETS}, {_JUDGED}, pos AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY CASE judge_label WHEN 'must_include' THEN 2 ELSE 1 END DESC, judge_confidence DESC, final_score DESC, citation) AS ord, judge_label = 'must_include' AND (auto_bucket = 'auto_keep' OR judge_confidence >= 0.86) AS locked FROM judged WHERE judge_label <> 'reject'),
t AS (SELECT *, least(least(greatest(greatest(estimate, count(*) FILTER (locked) OVER (PARTITION BY query_id)), 10), estimate + 8), 40) AS target, count(*) FILTER (locked) OVER (PARTITION BY query_id ORDER BY ord ROWS UNBOUNDED PRECEDING) AS lr FROM pos),
f AS (SELECT *, locked AND lr <= target AS first FROM t), c AS (SELECT *, count(*) FILTER (first) OVER (PARTITION BY query_id) AS n1, count(*) FILTER (first AND kind = 'court') OVER (PARTITION BY query_id) AS c1, count(*) FILTER (NOT first AND kind = 'court') OVER (PARTITION BY query_id ORDER BY ord ROWS UNBOUNDED PRECEDING) AS cr FROM f),
ph AS (SELECT *, CASE WHEN first THEN 1 WHEN kind = 'court' AND cr <= greatest(0, least(greatest(4, round_even(target * 0.25, 0)) - c1, target - n1)) THEN 2 ELSE 3 END AS phase FROM c)
SELECT query_id, citation, phase, row_number() OVER (PARTITION BY query_id ORDER BY phase, ord) AS position FROM ph QUALIFY position <= target""")
def select_v11(spark, sf_dir):
    return select.staged(judged(spark, sf_dir)).select("query_id", "citation", "phase", "position")


_GREEDY = "x AS (SELECT *, row_number() OVER (PARTITION BY query_id, kind ORDER BY raw_score DESC, citation) AS kr FROM candidates), y AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY raw_score DESC, citation) AS position FROM x WHERE kind <> 'court' OR kr <= 5)"


@register(f"{_C}, {_GREEDY} SELECT query_id, citation, position FROM y WHERE position <= estimate + 4 AND (raw_score >= 0.99 OR position <= 8)")
def select_budget(spark, sf_dir):
    rows = base.candidates(spark, sf_dir)
    return select.greedy(rows, F.col("estimate") + 4, F.lit(5), F.lit(0.99), F.lit(8), score="raw_score").select("query_id", "citation", "position")


@register(f"""{_C}, w AS (SELECT *, CASE WHEN kind = 'law' THEN concat(split_part(citation, ' ', 1), ' ', split_part(citation, ' ', 2), ' ', split_part(citation, ' ', -1)) ELSE split_part(citation, ' E. ', 1) END AS base FROM candidates),
b AS (SELECT *, row_number() OVER (PARTITION BY query_id, kind, base ORDER BY raw_score DESC, citation) AS br FROM w), x AS (SELECT *, row_number() OVER (PARTITION BY query_id, kind ORDER BY raw_score DESC, citation) AS kr FROM b WHERE br <= CASE WHEN kind = 'law' THEN 2 ELSE 1 END)
SELECT query_id, citation, row_number() OVER (PARTITION BY query_id ORDER BY raw_score DESC, citation) AS position FROM x WHERE kind <> 'court' OR kr <= 6 QUALIFY position <= estimate + 2""")
def select_per_base_caps(spark, sf_dir):
    c = F.col("citation")
    rows = base.candidates(spark, sf_dir).withColumn("base", F.when(F.col("kind") == "law", fn.law_base_by_tokens(c)).otherwise(fn.court_base(c)))
    return select.per_base(rows, F.col("estimate") + 2, 2, 1, 6, "raw_score").select("query_id", "citation", "position")


@register(f"{_C}, {_BUCKETS}, {_JUDGED} SELECT query_id, citation, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN judge_label = 'must_include' THEN 0 ELSE 1 END, raw_score DESC, citation) AS position FROM judged QUALIFY position <= estimate")
def select_must_first(spark, sf_dir):
    return select.must_first(judged(spark, sf_dir), F.col("estimate"), "raw_score").select("query_id", "citation", "position")


#: The loop of the selection, a row a step: what is chosen, how many courts are, and whether it has ended.
_FORCED = f"""{_C}, {_BUCKETS}, o AS (SELECT query_id, citation, kind, raw_score AS prob, is_explicit, auto_bucket = 'auto_keep' AS keep, least(28, greatest(6, round_even(estimate * 0.8 + 1.5, 0)))::INT AS target,
  row_number() OVER (PARTITION BY query_id ORDER BY raw_score DESC, is_explicit DESC, auto_bucket = 'auto_keep' DESC, final_score DESC, baseline_rank, citation) AS ord FROM bucketed),
steps AS (SELECT *, greatest(0, round_even(target * 0.3, 0))::INT AS cap, row_number() OVER (PARTITION BY query_id ORDER BY stage, ord) AS step FROM (SELECT *, 1 AS stage FROM o WHERE is_explicit UNION ALL SELECT *, 2 FROM o WHERE keep UNION ALL SELECT *, 3 FROM o)),
scan AS (SELECT query_id, 0::BIGINT AS step, []::VARCHAR[] AS chosen, 0 AS courts, false AS done FROM steps GROUP BY query_id UNION ALL
  SELECT query_id, step, CASE WHEN take THEN list_append(chosen, citation) ELSE chosen END, courts + CASE WHEN take AND kind = 'court' THEN 1 ELSE 0 END, done OR stop OR (take AND stage = 2 AND len(chosen) + 1 >= target) FROM (
    SELECT *, NOT done AND NOT stop AND NOT list_contains(chosen, citation) AND (stage = 1 OR kind <> 'court' OR courts < cap) AS take FROM (
      SELECT s.*, c.chosen, c.courts, c.done, s.stage = 3 AND (len(c.chosen) >= s.target OR (s.prob < 0.9 AND len(c.chosen) >= 6)) AS stop FROM scan c JOIN steps s ON s.query_id = c.query_id AND s.step = c.step + 1)))
SELECT query_id, unnest(chosen) AS citation, generate_subscripts(chosen, 1) AS position FROM (SELECT query_id, arg_max(chosen, step) AS chosen FROM scan GROUP BY query_id)"""


@register(_FORCED.replace("WITH ", "WITH RECURSIVE ", 1))
def select_forced(spark, sf_dir):
    rows = judged(spark, sf_dir).withColumn("prob", F.col("raw_score"))
    cfg = select.Forced(mult=0.8, bias=1.5, min_output=6, max_output=28, threshold=0.9, court_fraction=0.3)
    return select.forced(rows, cfg).select("query_id", "citation", "position")


@register(f"""{_C}, s AS (SELECT query_id, citation, round(greatest(raw_score, final_score, coalesce(1.0 / (1 + bm25_rank), 0), coalesce(1.0 / (1 + dense_rank), 0)), 6) AS signal FROM candidates) SELECT query_id, citation, signal, row_number() OVER (PARTITION BY query_id ORDER BY signal DESC, citation) AS rank FROM s QUALIFY rank <= 30""")
def signal_pool(spark, sf_dir):
    inv = lambda c: F.coalesce(1.0 / (1 + F.col(c)), F.lit(0.0))
    rows = base.candidates(spark, sf_dir).select("query_id", "citation", F.round(F.greatest("raw_score", "final_score", inv("bm25_rank"), inv("dense_rank")), 6).alias("signal"))
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("signal"), "citation"))).where("rank <= 30")
