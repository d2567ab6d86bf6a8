"""Queries over prediction sets: votes, perturbation, features, sweeps and evaluation."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from lexquarry.operators import ensemble, learn, metrics
from lexquarry.plans import base
from lexquarry.plans.base import CANDIDATES, GOLD, IDS, RUNS, WITH_HITS, register

_R = f"{WITH_HITS}, {RUNS}, {IDS}, {GOLD}"
_C = f"{WITH_HITS}, {CANDIDATES}, {IDS}, {GOLD}"


def _run(i: int) -> str:
    return f"(SELECT query_id, citation FROM runs WHERE variant = {i})"


@register(f"""{_R}, v AS (SELECT query_id, citation, count(*) AS votes FROM runs GROUP BY ALL), ks AS (SELECT unnest([1, 2, 3, 4]) AS k), kept AS (SELECT k, query_id, array_to_string(list_sort(list(citation)), ';') AS citations FROM v JOIN ks ON votes >= k GROUP BY ALL)
SELECT k, query_id, coalesce(citations, '') AS citations FROM queries CROSS JOIN ks LEFT JOIN kept USING (k, query_id)""")
def vote_threshold(spark, sf_dir):
    return ensemble.threshold_sweep(base.runs(spark, sf_dir), base.queries(spark, sf_dir), [1, 2, 3, 4]).withColumn("citations", F.array_join("citations", ";"))


@register(f"""{_R}, v AS (SELECT query_id, citation, count(*) AS votes FROM runs GROUP BY ALL), z AS (SELECT query_id, variant, count(*) AS n FROM runs GROUP BY ALL), p AS (SELECT query_id, greatest(1, list_sort(list(n))[len(list(n)) // 2 + 1]) AS target, ceil(round(count(*) * 0.6, 9)) AS least FROM z GROUP BY ALL)
SELECT query_id, citation, votes, row_number() OVER (PARTITION BY query_id ORDER BY votes DESC, citation) AS rank FROM v JOIN p USING (query_id) QUALIFY votes >= least OR rank <= target""")
def consensus_target(spark, sf_dir):
    return ensemble.consensus_target(base.runs(spark, sf_dir))


@register(f"""{_R}, a AS {_run(0)}, v AS (SELECT query_id, citation, count(*) AS votes, citation LIKE 'Art.%' AS law FROM runs WHERE variant > 0 GROUP BY ALL),
ad AS (SELECT *, row_number() OVER (PARTITION BY query_id, law ORDER BY votes DESC, law DESC, citation) AS k FROM v ANTI JOIN a ON v.query_id = a.query_id AND v.citation = a.citation WHERE votes >= 2 QUALIFY k <= CASE WHEN law THEN 3 ELSE 1 END),
added AS (SELECT query_id, citation FROM ad QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY votes DESC, law DESC, citation) <= 3),
gone AS (SELECT query_id, citation FROM a ANTI JOIN v ON v.query_id = a.query_id AND v.citation = a.citation QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY citation LIKE 'Art.%', citation) <= 2)
SELECT *, 'kept' AS change FROM a ANTI JOIN gone ON gone.query_id = a.query_id AND gone.citation = a.citation UNION ALL SELECT *, 'added' FROM added UNION ALL SELECT *, 'removed' FROM gone""")
def perturb_anchor(spark, sf_dir):
    return ensemble.perturbed(base.run(spark, sf_dir, 0), base.runs(spark, sf_dir).where("variant > 0"))


@register(f"""{_C}, {RUNS}, b AS {_run(2)}, n AS (SELECT c.query_id, c.citation FROM candidates c ANTI JOIN b ON b.query_id = c.query_id AND b.citation = c.citation WHERE kind = 'law' AND raw_score >= 0.9 QUALIFY row_number() OVER (PARTITION BY c.query_id ORDER BY raw_score DESC, c.citation) <= 3) FROM b UNION ALL FROM n""")
def add_only(spark, sf_dir):
    rows = base.candidates(spark, sf_dir)
    return ensemble.add_only(base.run(spark, sf_dir, 2), rows, (F.col("kind") == "law") & (F.col("raw_score") >= 0.9), 3, [F.desc("raw_score"), F.asc("citation")])


@register(f"""{_R}, p AS {_run(3)}, q AS (SELECT query_id, CASE WHEN query_id % 3 = 0 THEN 'Appeal and Costs' ELSE 'detention' END AS query FROM queries),
rules AS (SELECT * FROM (VALUES ('bgg', ['BGG'], 'appeal|costs', ['Art. 100 BGG', 'Art. 42 BGG']), ('stpo', ['StPO', 'StGB'], 'detention', ['Art. 221 StPO'])) t(rule, statutes, pattern, citations)),
codes AS (SELECT query_id, list(DISTINCT split_part(citation, ' ', -1)) AS codes FROM p GROUP BY ALL)
SELECT query_id, citation FROM p UNION SELECT query_id, unnest(citations) FROM q JOIN codes USING (query_id), rules WHERE regexp_matches(query, pattern, 'i') AND list_has_any(codes, statutes)""")
def rule_injection(spark, sf_dir):
    rules = spark.createDataFrame([("bgg", ["BGG"], "appeal|costs", ["Art. 100 BGG", "Art. 42 BGG"]), ("stpo", ["StPO", "StGB"], "detention", ["Art. 221 StPO"])], "rule string, statutes array<string>, pattern string, citations array<string>")
    queries = base.queries(spark, sf_dir).withColumn("query", F.when(F.col("query_id") % 3 == 0, "Appeal and Costs").otherwise("detention"))
    return ensemble.inject_rules(base.run(spark, sf_dir, 3), queries, rules)


_PRIORS = """priors AS (SELECT level, key, count(*) AS n FROM (SELECT unnest(['exact', 'base', 'code']) AS level, unnest([citation, CASE WHEN citation LIKE 'Art.%' THEN concat(split_part(citation, ' ', 1), ' ', split_part(citation, ' ', 2), ' ', split_part(citation, ' ', -1)) ELSE split_part(citation, ' E. ', 1) END, regexp_extract(citation, '\\s+([A-ZÄÖÜ]{2,}[A-Za-zÄÖÜäöü]*)$', 1)]) AS key FROM gold) WHERE key <> '' GROUP BY ALL)"""


@register(f"{_R}, {_PRIORS} FROM priors")
def priors_exact_base(spark, sf_dir):
    return learn.priors(base.gold(spark, sf_dir))


@register(f"""{_C}, {RUNS}, {_PRIORS}, u AS (SELECT query_id, citation, l.x IS NOT NULL AS in_left, r.x IS NOT NULL AS in_right FROM (SELECT *, 1 AS x FROM {_run(1)}) l FULL JOIN (SELECT *, 1 AS x FROM {_run(2)}) r USING (query_id, citation))
SELECT query_id, citation, round(0.5 * in_left::INT + 0.3 * in_right::INT + 0.2 * ln(coalesce(p.n, 0) + 1) + 0.4 * coalesce(c.raw_score, 0), 4) AS score FROM u LEFT JOIN priors p ON p.level = 'exact' AND p.key = u.citation LEFT JOIN candidates c USING (query_id, citation)""")
def hybrid_linear(spark, sf_dir):
    pool = ensemble.pool_union(base.run(spark, sf_dir, 1), base.run(spark, sf_dir, 2))
    exact = learn.priors(base.gold(spark, sf_dir)).where("level = 'exact'").select(F.col("key").alias("citation"), F.log1p("n").alias("prior"))
    rows = pool.join(exact, "citation", "left").join(base.candidates(spark, sf_dir).select("query_id", "citation", "raw_score"), ["query_id", "citation"], "left")
    rows = rows.withColumns({"l": F.col("in_left").cast("int"), "r": F.col("in_right").cast("int")})
    return rows.select("query_id", "citation", F.round(ensemble.linear_score(rows, {"l": 0.5, "r": 0.3, "prior": 0.2, "raw_score": 0.4}), 4).alias("score"))


_F1 = """SELECT {key} query_id, coalesce(tp, 0) AS tp, coalesce(n_pred, 0) AS n_pred, coalesce(n_gold, 0) AS n_gold,
 CASE WHEN coalesce(n_pred, 0) + coalesce(n_gold, 0) = 0 THEN 1 WHEN coalesce(n_pred, 0) = 0 THEN 0 ELSE round(coalesce(tp, 0) / n_pred, 6) END::DOUBLE AS precision, CASE WHEN coalesce(n_pred, 0) + coalesce(n_gold, 0) = 0 THEN 1 WHEN coalesce(n_gold, 0) = 0 THEN 0 ELSE round(coalesce(tp, 0) / n_gold, 6) END::DOUBLE AS recall,
 CASE WHEN coalesce(n_pred, 0) + coalesce(n_gold, 0) = 0 THEN 1 ELSE round(2 * coalesce(tp, 0) / (coalesce(n_pred, 0) + coalesce(n_gold, 0)), 6) END::DOUBLE AS f1"""
_PER = f"""counts AS (SELECT query_id, count(p.x) AS n_pred, count(g.x) AS n_gold, count(*) FILTER (p.x = 1 AND g.x = 1) AS tp FROM (SELECT *, 1 AS x FROM {_run(1)}) p FULL JOIN (SELECT *, 1 AS x FROM gold) g USING (query_id, citation) GROUP BY ALL),
per AS ({_F1.format(key="")} FROM queries LEFT JOIN counts USING (query_id))"""


def _per(spark, sf_dir):
    return metrics.per_query(base.run(spark, sf_dir, 1), base.gold(spark, sf_dir), base.queries(spark, sf_dir))


@register(f"{_R}, {_PER} FROM per")
def f1_per_query(spark, sf_dir):
    return _per(spark, sf_dir)


@register(f"{_R}, {_PER} SELECT count(*) AS queries, round(avg(precision), 4) AS precision, round(avg(recall), 4) AS recall, round(avg(f1), 4) AS f1 FROM per")
def f1_macro(spark, sf_dir):
    return metrics.macro(_per(spark, sf_dir))


_ALL = f"""counts AS (SELECT variant, query_id, count(*) AS n_pred, count(g.query_id) AS tp FROM runs r LEFT JOIN gold g USING (query_id, citation) GROUP BY ALL), sizes AS (SELECT query_id, count(*) AS n_gold FROM gold GROUP BY ALL),
per AS (SELECT variant, query_id, CASE WHEN coalesce(n_pred, 0) + coalesce(n_gold, 0) = 0 THEN 1 ELSE round(2 * coalesce(tp, 0) / (coalesce(n_pred, 0) + coalesce(n_gold, 0)), 6) END::DOUBLE AS f1 FROM queries CROSS JOIN (SELECT range AS variant FROM range(5)) LEFT JOIN counts USING (variant, query_id) LEFT JOIN sizes USING (query_id))"""


@register(f"""{_R}, {_ALL}, sets AS (SELECT variant, query_id, count(*) AS n, count(*) FILTER (citation NOT LIKE 'Art.%') AS c FROM runs GROUP BY ALL),
shape AS (SELECT variant, avg(coalesce(n, 0)) AS n, avg(CASE WHEN coalesce(n, 0) = 0 THEN 0 ELSE c / n END) AS courts FROM queries CROSS JOIN (SELECT range AS variant FROM range(5)) LEFT JOIN sets USING (variant, query_id) GROUP BY ALL)
SELECT variant, round(avg(f1) - 0.45 * stddev_pop(f1) + 0.08 * min(f1) - 0.9 * greatest(0, 0.28 - any_value(courts)) - 0.01 * greatest(0, 24 - any_value(n)), 4) AS objective FROM per JOIN shape USING (variant) GROUP BY ALL""".replace("count(g.query_id) AS tp", "count(*) FILTER (g.x = 1) AS tp").replace("LEFT JOIN gold g USING", "LEFT JOIN (SELECT *, 1 AS x FROM gold) g USING"))
def robust_objective(spark, sf_dir):
    rows = None
    for v in range(5):
        part = metrics.per_query(base.run(spark, sf_dir, v), base.gold(spark, sf_dir), base.queries(spark, sf_dir)).select(F.lit(v).alias("variant"), "f1")
        rows = part if rows is None else rows.unionByName(part)
    return ensemble.robust_objective(rows, "variant", base.runs(spark, sf_dir), base.queries(spark, sf_dir)).select("variant", F.round("objective", 4).alias("objective"))


@register(f"""{_C}, ks AS (SELECT unnest([10, 50, 100, 400]) AS k), s AS (SELECT query_id, count(*) AS n_gold FROM gold GROUP BY ALL), h AS (SELECT query_id, k, count(*) AS hits FROM candidates SEMI JOIN gold USING (query_id, citation) JOIN ks ON baseline_rank <= k GROUP BY ALL)
SELECT k, sum(coalesce(hits, 0))::BIGINT AS hits, round(sum(coalesce(hits, 0)) / sum(n_gold), 4) AS recall, round(avg(2 * coalesce(hits, 0) / (coalesce(hits, 0) + n_gold)), 4) AS oracle_f1 FROM s CROSS JOIN ks LEFT JOIN h USING (query_id, k) GROUP BY k""")
def pool_recall_curve(spark, sf_dir):
    return metrics.recall_curve(base.candidates(spark, sf_dir).withColumnRenamed("baseline_rank", "rank"), base.gold(spark, sf_dir), [10, 50, 100, 400])


@register(f"{_R}, f AS (SELECT DISTINCT query_id, citation, source FROM hits SEMI JOIN gold USING (query_id, citation)), n AS (SELECT *, count(*) OVER (PARTITION BY query_id, citation) AS n FROM f) SELECT source, count(*) AS hits, count(*) FILTER (n = 1) AS only FROM n GROUP BY ALL".replace("AS only", 'AS "only"'))
def source_attribution(spark, sf_dir):
    return metrics.source_attribution(base.hits(spark, sf_dir), base.gold(spark, sf_dir))


@register(f"""{_R}, {_PER}, num AS (SELECT row_number() OVER (ORDER BY query_id) - 1 AS i, f1 FROM per), t AS (SELECT count(*) AS n FROM per), d AS (SELECT r.range AS round, (((r.range * 7919 + j.range) * 1103515245 + 12345) % 2147483648) // 65536 % n AS i FROM range(200) r, t, range(42) j),
m AS (SELECT round, round(avg(f1), 6) AS mean FROM d JOIN num USING (i) GROUP BY ALL) SELECT 200 AS rounds, mean AS lower_bound FROM m QUALIFY row_number() OVER (ORDER BY mean, m.round) = 21""")
def bootstrap_lb(spark, sf_dir):
    return metrics.bootstrap(_per(spark, sf_dir), 200, 0.1)


@register(f"""{_R}, p AS (SELECT query_id, count(*) AS n, count(*) FILTER (citation NOT LIKE 'Art.%') AS c FROM {_run(1)} GROUP BY ALL), r AS (SELECT query_id, coalesce(n, 0) AS n, coalesce(c, 0) AS c FROM queries LEFT JOIN p USING (query_id))
SELECT round(avg(n), 4) AS avg_n, median(n) AS median_n, round(avg(CASE WHEN n = 0 THEN 0 ELSE c / n END), 4) AS court_fraction, round(1 - sum(c) / sum(n), 4) AS law_share FROM r""")
def shape_stats(spark, sf_dir):
    return metrics.shape(base.run(spark, sf_dir, 1), base.queries(spark, sf_dir))


@register(f"""{_R}, c AS (SELECT query_id, count(*) FILTER (l.x = 1 AND r.x = 1) AS both, count(*) AS either FROM (SELECT *, 1 AS x FROM {_run(1)}) l FULL JOIN (SELECT *, 1 AS x FROM {_run(3)}) r USING (query_id, citation) GROUP BY ALL)
SELECT query_id, coalesce(both, 0) AS "both", coalesce(either, 0) AS either, CASE WHEN coalesce(either, 0) = 0 THEN 1 ELSE round(both / either, 6) END::DOUBLE AS jaccard FROM queries LEFT JOIN c USING (query_id)""".replace(" AS both,", ' AS "both",').replace("coalesce(both", 'coalesce("both"').replace("round(both", 'round("both"'))
def jaccard_overlap(spark, sf_dir):
    return metrics.jaccard(base.run(spark, sf_dir, 1), base.run(spark, sf_dir, 3), base.queries(spark, sf_dir))


@register(f"""{_R}, s AS (SELECT query_id, citation, l.x AS l, r.x AS r FROM (SELECT *, 1 AS x FROM {_run(1)}) l FULL JOIN (SELECT *, 1 AS x FROM {_run(3)}) r USING (query_id, citation)), p AS (SELECT query_id, count(*) FILTER (r IS NULL) AS a, count(*) FILTER (l IS NULL) AS g, count(*) FILTER (r IS NULL AND citation NOT LIKE 'Art.%') AS c FROM s GROUP BY ALL)
SELECT sum(a)::BIGINT AS adds, sum(g)::BIGINT AS removes, sum(c)::BIGINT AS added_courts, round(avg(CASE WHEN a + g > 0 THEN 1.0 ELSE 0.0 END), 4) AS changed_fraction FROM p""")
def diff_counts(spark, sf_dir):
    return metrics.diff_counts(base.run(spark, sf_dir, 1), base.run(spark, sf_dir, 3))


_HISTORY = ["n_name AS name", "CAST(n_nationkey % 7 AS DOUBLE) / 10 + CAST(n_regionkey AS DOUBLE) / 100 AS public_score", "CAST(n_nationkey * 37 % 11 AS DOUBLE) AS f1", "CAST(n_nationkey * 13 % 5 AS DOUBLE) AS f2", "CAST(n_regionkey AS DOUBLE) AS f3"]


def _knn(loo: bool) -> str:
    on = "c.name <> h.name" if loo else "true"
    pairs = ", ".join(f"c.{f}, h.{f} AS h{f}" for f in ("f1", "f2", "f3"))
    med = ", ".join(f"median(h{f}) OVER w AS m{f}" for f in ("f1", "f2", "f3"))
    mad = ", ".join(f"median(abs(h{f} - m{f})) OVER w AS d{f}, max(h{f}) OVER w - min(h{f}) OVER w AS r{f}" for f in ("f1", "f2", "f3"))
    square = " + ".join(f"(({f} - h{f}) / CASE WHEN d{f} = 0 THEN CASE WHEN r{f} = 0 THEN 1 ELSE r{f} END ELSE d{f} END) ** 2" for f in ("f1", "f2", "f3"))
    return f"""WITH h AS (SELECT {', '.join(_HISTORY)} FROM nation), p AS (SELECT c.name, h.name AS hname, h.public_score AS s, {pairs} FROM h c JOIN h ON {on}), a AS (SELECT *, {med} FROM p WINDOW w AS (PARTITION BY name)), b AS (SELECT *, {mad} FROM a WINDOW w AS (PARTITION BY name)),
d AS (SELECT *, round(sqrt({square}), 9) AS distance FROM b), k AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY name ORDER BY distance, hname) <= 3), knn AS (SELECT name, round(sum(s / greatest(distance, 1e-6)) / sum(1 / greatest(distance, 1e-6)), 6) AS predicted FROM k GROUP BY ALL)"""


def _history(spark, sf_dir):
    return base.table(spark, sf_dir, "nation").selectExpr(*_HISTORY)


@register(_knn(False) + " SELECT name, round(predicted, 4) AS predicted FROM knn")
def knn_gate(spark, sf_dir):
    h = _history(spark, sf_dir)
    return metrics.knn_scores(h, h, ["f1", "f2", "f3"]).withColumn("predicted", F.round("predicted", 4))


_LOO = ", j AS (SELECT h.name, h.public_score, predicted FROM knn JOIN h USING (name))"


@register(_knn(True) + _LOO + """ SELECT round(avg(abs(public_score - predicted)), 4) AS mae, (SELECT round(avg(CASE WHEN (a.public_score - b.public_score) * (a.predicted - b.predicted) > 0 THEN 1.0 ELSE 0.0 END), 4) FROM j a JOIN j b ON a.name < b.name AND a.public_score <> b.public_score) AS pairwise_accuracy FROM j""")
def loo_gate(spark, sf_dir):
    h = _history(spark, sf_dir)
    rows = h.select("name", "public_score").join(metrics.knn_scores(h, h, ["f1", "f2", "f3"], loo=True), "name")
    return metrics.loo_quality(rows).select(F.round("mae", 4).alias("mae"), F.round("pairwise_accuracy", 4).alias("pairwise_accuracy"))


_V = ["o_orderkey", "CAST(o_orderkey % 100 AS DOUBLE) / 100 AS jaccard", "o_custkey % 150 AS adds", "o_custkey % 13 AS removes", "o_orderkey % 40 AS added_courts", "CAST(o_custkey % 40 AS DOUBLE) AS avg_n", "CAST(o_orderkey % 10 AS DOUBLE) / 100 AS court_fraction", "CAST(o_custkey % 21 AS DOUBLE) / 1000 AS predicted"]


@register(f"""WITH v AS (SELECT {', '.join(_V)} FROM orders), h AS (SELECT *, CASE WHEN jaccard >= 0.92 AND adds <= 60 AND removes <= 10 AND added_courts = 0 AND avg_n <= 25.0 + 1.5 AND court_fraction <= 0.05::DOUBLE + 0.02::DOUBLE THEN 'likely_better_or_flat' WHEN jaccard < 0.85 OR adds > 120 OR added_courts > 30 OR avg_n > 25.0 + 2 OR court_fraction > 0.05::DOUBLE + 0.03::DOUBLE THEN 'likely_worse' ELSE 'unclear' END AS heuristic, predicted - 0.01::DOUBLE AS d FROM v)
SELECT o_orderkey, heuristic, CASE WHEN heuristic = 'likely_better_or_flat' AND d >= -0.001 THEN 'likely_better_or_flat' WHEN heuristic = 'likely_worse' AND d <= 0 THEN 'likely_worse' WHEN d >= 0.002 THEN 'possibly_better' WHEN d <= -0.004 THEN 'likely_worse' ELSE 'unclear' END AS verdict FROM h""")
def verdict(spark, sf_dir):
    names = ("jaccard", "adds", "removes", "added_courts", "avg_n", "court_fraction")
    rows = base.table(spark, sf_dir, "orders").selectExpr(*_V).withColumn("heuristic", metrics.verdict({n: F.col(n) for n in names}, F.lit(25.0), F.lit(0.05)))
    return rows.select("o_orderkey", "heuristic", metrics.combined_verdict(F.col("predicted"), F.lit(0.01), F.col("heuristic")).alias("verdict"))


@register(f"{_R} SELECT citation, count(DISTINCT query_id) AS df, round(count(DISTINCT query_id) / (SELECT count(DISTINCT query_id) FROM gold), 4) AS coverage FROM gold GROUP BY citation HAVING count(DISTINCT query_id) >= 3")
def boilerplate_coverage(spark, sf_dir):
    return metrics.frequent(base.gold(spark, sf_dir))


@register(f"{_C} SELECT query_id, citation, (kind = 'law')::INT AS is_law, CASE WHEN dense_rank > 0 THEN round(1.0::DOUBLE / (1 + dense_rank), 6) ELSE 0 END AS inv_dense, CASE WHEN bm25_rank > 0 THEN round(1.0::DOUBLE / (1 + bm25_rank), 6) ELSE 0 END AS inv_bm25, len(sources)::INT AS n_sources, list_contains(sources, 'dense')::INT AS src_dense, list_contains(sources, 'bm25')::INT AS src_bm25 FROM candidates")
def features_meta(spark, sf_dir):
    rows = learn.base_features(base.candidates(spark, sf_dir), ["dense", "bm25"])
    return rows.select("query_id", "citation", "is_law", "inv_dense", "inv_bm25", "n_sources", "src_dense", "src_bm25")


@register(f"{_C} SELECT query_id, citation, count(*) OVER w AS pool, round((row_number() OVER (PARTITION BY query_id ORDER BY raw_score, citation) - 1) / greatest(count(*) OVER w - 1, 1), 6) AS score_pct, round(raw_score / max(raw_score) OVER w, 6) AS to_best, count(*) FILTER (kind = 'law') OVER w AS laws_in_pool FROM candidates WINDOW w AS (PARTITION BY query_id)")
def relative_features(spark, sf_dir):
    rows = learn.relative_features(base.candidates(spark, sf_dir))
    return rows.select("query_id", "citation", "pool", "score_pct", "to_best", "laws_in_pool")


@register(f"{_C} SELECT query_id, citation, (g.x IS NOT NULL)::INT AS label FROM candidates LEFT JOIN (SELECT *, 1 AS x FROM gold) g USING (query_id, citation)")
def label_join(spark, sf_dir):
    return learn.labelled(base.candidates(spark, sf_dir).select("query_id", "citation"), base.gold(spark, sf_dir))


_FOLDS = "folds AS (SELECT query_id, coalesce(n_gold, 0) AS n_gold, ((row_number() OVER (ORDER BY coalesce(n_gold, 0), query_id) - 1) % 5)::INT AS fold FROM queries LEFT JOIN (SELECT query_id, count(*) AS n_gold FROM gold GROUP BY ALL) USING (query_id))"


@register(f"{_R}, {_FOLDS} FROM folds")
def group_kfold(spark, sf_dir):
    return learn.stratified_folds(base.gold(spark, sf_dir), base.queries(spark, sf_dir), 5)


_GRID = dict(target=[10, 40], thresh=[0.5, 0.95], min_out=[5], court_cap=[3, 20])
_SWEEP = """configs AS (SELECT (row_number() OVER (ORDER BY target, thresh, court_cap) - 1)::INT AS config_id, * FROM (SELECT unnest([10, 40]) AS target), (SELECT unnest([0.5, 0.95]) AS thresh), (SELECT 5 AS min_out), (SELECT unnest([3, 20]) AS court_cap)),
m AS (SELECT c.query_id, c.citation, kind, raw_score AS prob, (g.x IS NOT NULL)::INT AS label, row_number() OVER (PARTITION BY c.query_id, kind ORDER BY raw_score DESC, c.citation) AS kr FROM candidates c LEFT JOIN (SELECT *, 1 AS x FROM gold) g ON g.query_id = c.query_id AND g.citation = c.citation),
pl AS (SELECT *, row_number() OVER (PARTITION BY config_id, query_id ORDER BY prob DESC, citation) AS position FROM m, configs WHERE kind <> 'court' OR kr <= court_cap),
got AS (SELECT config_id, query_id, count(*) AS n_pred, sum(label) AS tp FROM pl WHERE position <= target AND (prob >= thresh OR position <= min_out) GROUP BY ALL),
per AS (SELECT config_id, query_id, CASE WHEN coalesce(n_pred, 0) + coalesce(n_gold, 0) = 0 THEN 1 ELSE round(2 * coalesce(tp, 0) / (coalesce(n_pred, 0) + coalesce(n_gold, 0)), 6) END::DOUBLE AS f1 FROM queries CROSS JOIN (SELECT config_id FROM configs) LEFT JOIN got USING (config_id, query_id) LEFT JOIN (SELECT query_id, count(*) AS n_gold FROM gold GROUP BY ALL) USING (query_id))"""


def _sweep(spark, sf_dir):
    scored = base.candidates(spark, sf_dir).withColumn("prob", F.col("raw_score"))
    return learn.sweep(scored, base.gold(spark, sf_dir), base.queries(spark, sf_dir), learn.grid(spark, **_GRID))


@register(f"{_C}, {_SWEEP} SELECT config_id, round(avg(f1), 4) AS mean_f1 FROM per GROUP BY ALL")
def grid_sweep(spark, sf_dir):
    return _sweep(spark, sf_dir).groupBy("config_id").agg(F.round(F.avg("f1"), 4).alias("mean_f1"))


@register(f"""{_C}, {_SWEEP}, {_FOLDS}, s AS (SELECT config_id, fold, sum(f1) AS s, count(*) AS n FROM per JOIN folds USING (query_id) GROUP BY ALL), t AS (SELECT config_id, fold, round((sum(s) OVER w - s) / (sum(n) OVER w - n), 6) AS train_f1, round(s / n, 6) AS test_f1 FROM s WINDOW w AS (PARTITION BY config_id))
SELECT fold, config_id, round(train_f1, 4) AS train_f1, round(test_f1, 4) AS test_f1 FROM t QUALIFY row_number() OVER (PARTITION BY fold ORDER BY train_f1 DESC, config_id) = 1""".replace("ORDER BY train_f1 DESC", "ORDER BY t.train_f1 DESC"))
def cv_sweep(spark, sf_dir):
    folds = learn.stratified_folds(base.gold(spark, sf_dir), base.queries(spark, sf_dir), 5)
    return learn.cross_validated(_sweep(spark, sf_dir), folds).select("fold", "config_id", F.round("train_f1", 4).alias("train_f1"), F.round("test_f1", 4).alias("test_f1"))


def _out_of_fold(spark, sf_dir):
    rows = learn.base_features(base.candidates(spark, sf_dir), ["dense", "bm25", "gpt_full"])
    rows = learn.labelled(rows.select("query_id", "citation", "kind", "raw_score", "inv_dense", "inv_bm25", "n_sources", "src_dense", "src_bm25", "src_gpt_full"), base.gold(spark, sf_dir))
    folds = learn.stratified_folds(base.gold(spark, sf_dir), base.queries(spark, sf_dir), 2)
    return learn.out_of_fold(rows, folds, ["raw_score", "inv_dense", "inv_bm25", "n_sources", "src_dense", "src_bm25", "src_gpt_full"], 2)


@register(f"{_C}, {_FOLDS.replace('% 5', '% 2')} SELECT query_id, citation, (g.x IS NOT NULL)::INT AS label, fold, true AS in_range FROM candidates LEFT JOIN (SELECT *, 1 AS x FROM gold) g USING (query_id, citation) JOIN folds USING (query_id)")
def out_of_fold(spark, sf_dir):
    """Each candidate once, with its label and fold, and whether its probability is one."""
    return _out_of_fold(spark, sf_dir).select("query_id", "citation", "label", "fold", F.col("prob").between(0, 1).alias("in_range"))


@register()
def learned_selector(spark, sf_dir):
    """The 20 likeliest of each query; the model has no SQL form, `out_of_fold` holds the rows."""
    return _out_of_fold(spark, sf_dir).select("query_id", "citation", "label", "prob", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("prob"), "citation")).alias("rank")).where("rank <= 20")


@register(f"{_R} SELECT query_id, array_to_string(list_sort(list(citation)), ';') AS predicted_citations FROM {_run(1)} GROUP BY ALL")
def prediction_rows(spark, sf_dir):
    from lexquarry.sources.io import prediction_rows as rows

    return rows(base.run(spark, sf_dir, 1))


@register(f"{_R}, a AS {_run(1)}, b AS {_run(3)} SELECT 'union' AS op, count(*) AS n FROM (FROM a UNION FROM b) UNION ALL SELECT 'both', count(*) FROM (FROM a INTERSECT FROM b) UNION ALL SELECT 'less', count(*) FROM (FROM a EXCEPT FROM b)")
def set_algebra(spark, sf_dir):
    a, b = base.run(spark, sf_dir, 1), base.run(spark, sf_dir, 3)
    parts = [(n, d) for n, d in (("union", a.union(b).distinct()), ("both", a.intersect(b)), ("less", a.subtract(b)))]
    out = [d.agg(F.count("*").alias("n")).select(F.lit(n).alias("op"), "n") for n, d in parts]
    return out[0].unionByName(out[1]).unionByName(out[2])


@register(f"{WITH_HITS} SELECT date_trunc('day', ts) AS day, source, count(*) AS votes FROM hits GROUP BY ALL")
def windowed_votes(spark, sf_dir):
    from lexquarry.streaming.cache import windowed_votes as votes

    return votes(base.hits(spark, sf_dir).select("ts", "source"))


@register(f"{WITH_HITS}, k AS (SELECT user_key AS key, max(created) AS created_at, arg_max(source, (created, source)) AS label FROM (SELECT query_id AS user_key, event_id // 3 AS created, source FROM hits) GROUP BY ALL) SELECT key, label, created_at FROM k")
def cache_latest(spark, sf_dir):
    from lexquarry.streaming.cache import latest

    return latest(base.hits(spark, sf_dir).select(F.col("query_id").alias("key"), F.expr("event_id DIV 3").alias("created_at"), F.col("source").alias("label")))


@register(f"{_R}, {_PER}, p AS (SELECT query_id, list_sort(list(DISTINCT citation)) AS c FROM gold GROUP BY ALL) SELECT query_id, CASE WHEN len(c) <= 3 THEN 'few' WHEN len(c) <= 10 THEN 'some' ELSE 'many' END AS stratum, f1 FROM p JOIN per USING (query_id)")
def domain_strata(spark, sf_dir):
    n = F.col("n_gold")
    return _per(spark, sf_dir).where(n > 0).select("query_id", F.when(n <= 3, "few").when(n <= 10, "some").otherwise("many").alias("stratum"), "f1")




@register(f"""{_R}, {_PER}, s AS (SELECT query_id, count(*) AS n FROM {_run(1)} GROUP BY ALL), j AS (SELECT query_id, count(*) FILTER (l.x = 1 AND r.x = 1) / count(*) AS jac FROM (SELECT *, 1 AS x FROM {_run(1)}) l FULL JOIN (SELECT *, 1 AS x FROM {_run(3)}) r USING (query_id, citation) GROUP BY ALL)
SELECT round(avg(f1), 4) AS f1, round(avg(coalesce(n, 0)), 4) AS avg_n, round(avg(coalesce(jac, 1)), 4) AS jaccard FROM per LEFT JOIN s USING (query_id) LEFT JOIN j USING (query_id)""")
def scorecard(spark, sf_dir):
    """One row of quality, shape and likeness to an anchor."""
    queries = base.queries(spark, sf_dir)
    quality = metrics.macro(_per(spark, sf_dir)).select("f1")
    size = metrics.shape(base.run(spark, sf_dir, 1), queries).select("avg_n")
    like = metrics.jaccard(base.run(spark, sf_dir, 1), base.run(spark, sf_dir, 3), queries).agg(F.round(F.avg("jaccard"), 4).alias("jaccard"))
    return quality.crossJoin(size).crossJoin(like)  # three single rows


_FED = "CASE WHEN source IN ('dense', 'bm25') THEN 0 WHEN source LIKE 'gpt%' THEN 1 ELSE 2 END"


@register(f"{WITH_HITS} SELECT concat(query_id, '/', citation) AS key, arg_max(source, {_FED} * 1000000000000 + event_id) AS label, arg_max(event_id, {_FED} * 1000000000000 + event_id) AS pos FROM hits GROUP BY ALL")
def judge_cache_stream(spark, sf_dir):
    """Answers that come in three batches, one of them twice, and are compacted: the last of each key."""
    from lexquarry.sources.committed import Committed
    from lexquarry.sources.scratch import scratch
    from lexquarry.streaming import cache

    root = f"{scratch(spark).root}/stream-{uuid.uuid4().hex}"
    rows = base.hits(spark, sf_dir).select(F.concat(F.col("query_id").cast("string"), F.lit("/"), "citation").alias("key"), F.col("source").alias("label"), F.col("event_id").alias("pos"), F.expr(_FED).alias("fed"))
    table = Committed(spark, f"{root}/table")
    for batch in range(3):  # a file each, so a batch each
        rows.where(F.col("fed") == batch).drop("fed").coalesce(1).write.mode("append").parquet(f"{root}/in")
        cache.follow_into(spark, f"{root}/in", "key string, label string, pos long", table, f"{root}/checkpoint").awaitTermination()
    cache.keeper(table)(rows.where("fed = 0").drop("fed"), 0)  # a batch that comes again
    cache.compact(table)
    cache.keeper(table)(rows.where("fed = 1").drop("fed"), 1)
    return cache.current(table).select("key", "label", "pos")


@register("""WITH RECURSIVE q AS (SELECT conv_id AS session, turn, length(text) % 17 + 1 AS estimate, length(text) % 40 AS available, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS step FROM conversations),
r AS (SELECT session, 0::BIGINT AS step, 0::BIGINT AS turn, 0::BIGINT AS target, 0::BIGINT AS taken, 0::BIGINT AS total FROM q GROUP BY ALL UNION ALL
  SELECT session, step, turn, target, least(target, available), total + least(target, available) FROM (SELECT q.session, q.step, q.turn, q.available, r.total, CASE WHEN r.step = 0 THEN q.estimate ELSE greatest(q.estimate, floor(r.total / r.step * 0.8::DOUBLE)::BIGINT) END AS target FROM r JOIN q ON q.session = r.session AND q.step = r.step + 1))
SELECT session, turn, target, taken FROM r WHERE step > 0""")
def session_targets(spark, sf_dir):
    """Each turn's target, which follows what the conversation has taken before."""
    from lexquarry.streaming import cache

    size = F.length("text")
    rows = base.table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("session"), "turn", (size % 17 + 1).alias("estimate"), (size % 40).alias("available"))
    return cache.carried(rows, pos="turn").select("session", "turn", "target", "taken")
