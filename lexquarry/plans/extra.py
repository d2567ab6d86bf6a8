"""Queries over reranking, guards, injections and rollups."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexquarry.operators import extra, retrieval
from lexquarry.plans import base
from lexquarry.plans.base import CANDIDATES, GOLD, IDS, RUNS, WITH_HITS, asked, corpus, register
from lexquarry.plans.retrieval import _TOP, _bm25

_R = f"{WITH_HITS}, {RUNS}, {IDS}, {GOLD}"
_C = f"{WITH_HITS}, {CANDIDATES}, {IDS}, {GOLD}, {RUNS}"


@register(_bm25() + ", a AS (" + _TOP.format(k=10) + """), t AS (SELECT a.query_id, a.doc_id, list_distinct(list_filter(regexp_extract_all(lower(d.text), '[a-zäöüß]+'), lambda t: length(t) > 1)) AS x, list_distinct(list_filter(regexp_extract_all(lower(b.text), '[a-zäöüß]+'), lambda t: length(t) > 1)) AS y FROM a JOIN documents d USING (doc_id) JOIN benchmark b ON b.item_id = a.query_id),
s AS (SELECT query_id, doc_id, round(len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y))), 6) AS rerank_score FROM t) SELECT query_id, doc_id, rerank_score, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, doc_id) AS new_rank FROM s""")
def rerank_topk(spark, sf_dir):
    top = retrieval.top_k(retrieval.bm25(corpus(spark, sf_dir), asked(spark, sf_dir), k=10), 10).select("query_id", "doc_id")
    return extra.rerank(top, corpus(spark, sf_dir), asked(spark, sf_dir))


@register(f"""{_C}, s AS (SELECT query_id, citation, raw_score AS score FROM candidates), f AS (SELECT * FROM s WHERE score > 0.2 AND score < 0.8 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, citation) <= 60), l AS (SELECT query_id, citation FROM f SEMI JOIN gold USING (query_id, citation))
SELECT s.query_id, s.citation, CASE WHEN l.citation IS NOT NULL THEN greatest(score, 0.82) ELSE score END::DOUBLE AS score FROM s LEFT JOIN l ON l.query_id = s.query_id AND l.citation = s.citation""")
def rerank_bump(spark, sf_dir):
    scored = base.candidates(spark, sf_dir).select("query_id", "citation", F.col("raw_score").alias("score"))
    return extra.bumped(scored, base.gold(spark, sf_dir))


@register(f"{_C}, p AS (SELECT query_id, citation FROM candidates WHERE baseline_rank <= 100), r AS (SELECT query_id, citation FROM runs WHERE variant = 0) SELECT query_id, count(*) AS dropped FROM r ANTI JOIN p USING (query_id, citation) GROUP BY ALL")
def closed_set_guard(spark, sf_dir):
    return extra.closed_set(base.run(spark, sf_dir, 0), base.candidates(spark, sf_dir).where("baseline_rank <= 100"))[1]


@register(f"""{WITH_HITS}, p AS (SELECT query_id, citation, event_id % 3 AS pass, min(CASE event_id % 4 WHEN 0 THEN 'must_include' WHEN 1 THEN 'plausible' ELSE 'reject' END) AS label FROM hits GROUP BY ALL), s AS (SELECT pass, label, count(*) AS n FROM p GROUP BY ALL)
SELECT pass, label, round(n / sum(n) OVER (PARTITION BY pass), 4) AS share FROM s UNION ALL SELECT -1, 'agreed', round(avg(same), 4) FROM (SELECT (count(DISTINCT label) = 1)::INT AS same FROM p GROUP BY query_id, citation)""")
def pass_agreement(spark, sf_dir):
    label = F.expr("CASE event_id % 4 WHEN 0 THEN 'must_include' WHEN 1 THEN 'plausible' ELSE 'reject' END")
    return extra.pass_agreement(base.hits(spark, sf_dir).groupBy("query_id", "citation", (F.col("event_id") % 3).alias("pass")).agg(F.min(label).alias("label")))


@register(f"""{_R}, t AS (SELECT i.range AS i, j.range AS j, k.range AS k FROM range(1, 5) i, range(1, 5) j, range(1, 5) k WHERE i.range < j.range AND j.range < k.range), v AS (SELECT i, j, k, query_id, citation, count(*) AS votes FROM runs JOIN t ON variant IN (i, j, k) GROUP BY ALL), p AS (SELECT * FROM (VALUES (1, 2), (1, 3), (1, 5), (2, 3), (2, 5), (2, 8), (3, 3), (3, 5)) x(min_votes, max_add)),
n AS (SELECT i, j, k, min_votes, max_add, query_id, citation, row_number() OVER (PARTITION BY i, j, k, min_votes, max_add, query_id ORDER BY citation) AS n FROM v ANTI JOIN (SELECT query_id, citation FROM runs WHERE variant = 0) a USING (query_id, citation) JOIN p ON votes >= min_votes) SELECT i, j, k, min_votes, max_add, count(*) AS added FROM n WHERE n <= max_add GROUP BY ALL""")
def perturb_triples(spark, sf_dir):
    rows = base.runs(spark, sf_dir)
    return extra.triple_additions(rows.where("variant > 0"), base.run(spark, sf_dir, 0), [1, 2, 3, 4], extra.PERTURB)


@register(f"{_R}, n AS (SELECT DISTINCT variant AS name FROM runs) SELECT range AS round, name FROM range(10), n QUALIFY row_number() OVER (PARTITION BY range ORDER BY md5(concat_ws(':', 7, range, name)), name) <= 3")
def rolling_neighbours(spark, sf_dir):
    return extra.rolling_neighbours(base.runs(spark, sf_dir).select(F.col("variant").alias("name")).distinct(), 10, 7)


@register(f"{_R} SELECT query_id, citation FROM runs WHERE variant = 2 UNION SELECT query_id, citation FROM hits WHERE score >= 0.97 AND citation LIKE 'Art.%'")
def confident_injection(spark, sf_dir):
    offered = base.hits(spark, sf_dir).select("query_id", "citation", F.col("score").alias("confidence"))
    return extra.inject_confident(base.run(spark, sf_dir, 2), offered, 0.97)


@register(f"""{_R}, k AS (SELECT DISTINCT citation, 1 AS k FROM hits WHERE score < 0.5), g AS (SELECT *, 1 AS g FROM gold) SELECT variant, count(*) AS n, round(count(k) / count(*), 4) AS hit_rate, round(count(g) / count(*), 4) AS precision FROM runs LEFT JOIN k USING (citation) LEFT JOIN g USING (query_id, citation) GROUP BY ALL""".replace("count(g) /", "count(g.g) /").replace("count(k) /", "count(k.k) /"))
def model_rollup(spark, sf_dir):
    known = base.hits(spark, sf_dir).where("score < 0.5")
    return extra.model_rollup(base.runs(spark, sf_dir), base.gold(spark, sf_dir), known, "variant")


@register(f"{_R}, n AS (SELECT query_id, citation FROM runs WHERE variant = 1 EXCEPT SELECT query_id, citation FROM runs WHERE variant = 3), g AS (SELECT *, 1 AS x FROM gold) SELECT query_id, count(g.x) AS recovered, count(*) AS new FROM n LEFT JOIN g USING (query_id, citation) GROUP BY ALL".replace("AS new", 'AS "new"'))
def recovered_gold(spark, sf_dir):
    return extra.recovered(base.run(spark, sf_dir, 1), base.run(spark, sf_dir, 3), base.gold(spark, sf_dir))


@register(f"""{_C}, x AS (SELECT *, count(*) OVER w AS n, max(score) OVER w AS top FROM candidates WINDOW w AS (PARTITION BY query_id)), y AS (SELECT *, count(*) FILTER (score >= top * 0.985) OVER (PARTITION BY query_id) AS above FROM x)
SELECT query_id, citation, baseline_rank AS rank FROM y WHERE baseline_rank <= least(CASE WHEN estimate < n THEN greatest(estimate, above) ELSE least(n, greatest(estimate, 10)) END, 60)""")
def cutoff_prune(spark, sf_dir):
    return extra.prune(base.candidates(spark, sf_dir).drop("baseline_rank"), 0.985).select("query_id", "citation", "rank")


@register(f"{_C} SELECT query_id, concat('[', baseline_rank, '] ', upper(kind), ' ', citation, ': ', array_to_string(sources, ' ')) AS line FROM candidates WHERE baseline_rank <= 5")
def display_lines(spark, sf_dir):
    rows = base.candidates(spark, sf_dir).where("baseline_rank <= 5")
    return rows.select("query_id", extra.display_line(F.col("kind"), F.col("baseline_rank"), F.col("citation"), F.array_join("sources", " "), 500).alias("line"))


@register("""WITH w AS (SELECT conv_id, list(text ORDER BY turn) AS named FROM conversations WHERE role = 'user' GROUP BY ALL), t AS (SELECT conv_id, list(role ORDER BY turn) AS terms FROM conversations GROUP BY ALL),
f AS (SELECT t.conv_id AS query_id, list_filter(w.named[1:8], lambda q: trim(q) <> '') AS l, terms FROM t LEFT JOIN w USING (conv_id)) SELECT query_id, (i - 1)::INT AS sub_id, q[i] AS query FROM (SELECT query_id, CASE WHEN len(l) > 0 THEN l ELSE [array_to_string(terms[1:20], ' ')] END AS q, unnest(range(1, len(CASE WHEN len(l) > 0 THEN l ELSE [1::VARCHAR] END) + 1)) AS i FROM f)""")
def sub_queries(spark, sf_dir):
    rows = base.table(spark, sf_dir, "conversations")
    inner = lambda c: F.transform(F.array_sort(F.collect_list(c)), lambda x: x["v"])
    named = inner(F.when(F.col("role") == "user", F.struct("turn", F.col("text").alias("v"))))
    return retrieval.sub_queries(rows.groupBy(F.col("conv_id").alias("query_id")).agg(named.alias("named"), inner(F.struct("turn", F.col("role").alias("v"))).alias("terms")), "named", "terms")


@register(f"""{_C}, o AS (SELECT (row_number() OVER (ORDER BY citation) - 1)::INT AS config_id, round(avg(raw_score), 6) AS objective FROM candidates GROUP BY citation) FROM o ORDER BY objective DESC, config_id LIMIT 10""".replace("AS config_id, round", "AS config_id, round"))
def top_configs(spark, sf_dir):
    from lexquarry.operators.metrics import numbered

    per = base.candidates(spark, sf_dir).groupBy("citation").agg(F.round(F.avg("raw_score"), 6).alias("objective"))
    return extra.keep_best(numbered(per, [F.col("citation")]).select(F.col("row").alias("config_id"), "objective"), 10)
