"""Queries over texts, vectors and citations."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from lexquarry.functions import text as fn
from lexquarry.operators import fusion, resolve, retrieval, substrings
from lexquarry.operators.retrieval import Bm25
from lexquarry.plans.base import WITH_CITED, asked, cited, corpus, register, table


def _bm25(k1: float = 1.5, b: float = 0.75, scope: str = "", longer: int = 1) -> str:
    part, using, comma = (f"{scope},", f"AND df.{scope} = p.{scope}", f", {scope}") if scope else ("", "", "")
    stats = f"JOIN stats s ON s.{scope} = p.{scope}" if scope else ", stats s"
    return f"""WITH corpus AS (SELECT doc_id, text, CASE WHEN lang = 'de' THEN 'law' ELSE 'court' END AS kind FROM documents),
tok AS (SELECT doc_id, {part} list_filter(regexp_extract_all(lower(text), '[a-zäöüß]+'), lambda t: length(t) > {longer}) AS ts FROM corpus),
stats AS (SELECT {part} count(*) AS n, avg(len(ts)) AS avgdl FROM tok GROUP BY ALL),
qt AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT item_id AS query_id, unnest(list_filter(regexp_extract_all(lower(text), '[a-zäöüß]+'), lambda t: length(t) > {longer})) AS term FROM benchmark) GROUP BY ALL),
post AS (SELECT term, doc_id, dl{comma}, count(*) AS tf FROM (SELECT doc_id, {part} len(ts) AS dl, unnest(ts) AS term FROM tok) WHERE term IN (SELECT term FROM qt) GROUP BY ALL),
df AS (SELECT term{comma}, count(*) AS df FROM post GROUP BY ALL),
bm AS (SELECT q.query_id, p.doc_id, round(sum(q.qtf * ln((s.n - df.df + 0.5) / (df.df + 0.5) + 1) * p.tf * {k1 + 1} / (p.tf + {k1} * (1 - {b} + {b} * p.dl / s.avgdl))), 6) AS score
  FROM post p {stats}, df, qt q WHERE df.term = p.term {using} AND q.term = p.term GROUP BY ALL)"""


_TOP = "SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM bm QUALIFY rank <= {k}"


@register("""WITH t AS (SELECT doc_id, list_filter(regexp_extract_all(lower(text), '[a-zäöüß]+'), lambda t: length(t) > 1) AS a, list_filter(regexp_extract_all(lower(text), '[a-zäöüß]+'), lambda t: length(t) > 2) AS b FROM documents)
SELECT doc_id, len(a) AS tokens, len(list_distinct(a)) AS terms, len(b) AS longer FROM t""")
def tokenize_stats(spark, sf_dir):
    rows = corpus(spark, sf_dir).select("doc_id", fn.tokenize(F.col("text")).alias("a"), fn.tokenize(F.col("text"), 2).alias("b"))
    return rows.select("doc_id", F.size("a").alias("tokens"), F.size(F.array_distinct("a")).alias("terms"), F.size("b").alias("longer"))


@register("""SELECT term, count(DISTINCT doc_id) AS df, count(*) AS cf FROM (SELECT doc_id, unnest(list_filter(regexp_extract_all(lower(text), '[a-zäöüß]+'), lambda t: length(t) > 1)) AS term FROM documents)
WHERE term IN (SELECT unnest(regexp_extract_all(lower(text), '[a-zäöüß]+')) FROM benchmark) GROUP BY term""")
def doc_freq(spark, sf_dir):
    post = retrieval.postings(retrieval.counted(corpus(spark, sf_dir), retrieval.query_terms(asked(spark, sf_dir))))
    return post.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


@register(_bm25() + " " + _TOP.format(k=20))
def bm25_topk(spark, sf_dir):
    return retrieval.top_k(retrieval.bm25(corpus(spark, sf_dir), asked(spark, sf_dir), k=20), 20)


@register(_bm25() + " " + _TOP.format(k=20))
def index_topk(spark, sf_dir):
    """bm25_topk by an index that took the texts of three groups of languages one after another and merged two segments."""
    from lexquarry.operators.topk_index import TopkIndex
    from lexquarry.sources.scratch import scratch

    index = TopkIndex(spark, f"{scratch(spark).root}/topk-{uuid.uuid4().hex}")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    for name, rows in (("en", docs.where("lang = 'en'")), ("fr", docs.where("lang IN ('en', 'fr')")), ("rest", docs)):
        index.add(rows, name)
    index.merge(["fr", "rest"], "merged")
    return index.search(asked(spark, sf_dir), 20).ranking


@register(_bm25() + ", a AS (" + _TOP.format(k=20) + """), m AS (SELECT query_id % 10 AS query_id, doc_id, max(score) AS score, min(rank) AS rank FROM a WHERE score > 0 GROUP BY ALL)
SELECT query_id, doc_id, score, rank AS best_rank, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM m QUALIFY rank <= 15""".replace("AS rank FROM m QUALIFY rank", "AS place FROM m QUALIFY place"))
def bm25_multi_query_merge(spark, sf_dir):
    top = retrieval.top_k(retrieval.bm25(corpus(spark, sf_dir), asked(spark, sf_dir), k=20), 20).withColumn("query_id", F.col("query_id") % 10)
    merged = retrieval.merge_queries(top).withColumnRenamed("rank", "best_rank")
    return retrieval.top_k(merged, 15).withColumnRenamed("rank", "place")


@register(_bm25(scope="kind") + " " + _TOP.format(k=20))
def bm25_sharded_stats(spark, sf_dir):
    return retrieval.top_k(retrieval.bm25(corpus(spark, sf_dir), asked(spark, sf_dir), scope=["kind"], k=20), 20)


@register(_bm25(1.2, 0.5, longer=2) + ", a AS (" + _TOP.format(k=20) + ") SELECT query_id, doc_id, round(score / max(score) OVER (PARTITION BY query_id) * 0.65, 4) AS norm FROM a")
def bm25_maxnorm(spark, sf_dir):
    top = retrieval.top_k(retrieval.bm25(corpus(spark, sf_dir), asked(spark, sf_dir), Bm25(1.2, 0.5, 2), k=20), 20)
    return retrieval.max_normalized(top, 0.65).select("query_id", "doc_id", F.round("norm", 4).alias("norm"))


_MINED = "list_distinct(list_concat(regexp_extract_all(c, 'BGE\\s+\\d+\\s+[IV]+\\s+\\d+(?:\\s+E\\.\\s*[\\d.]+)?'), list_concat(regexp_extract_all(c, '\\d[A-Z]_\\d+/\\d{4}(?:\\s+E\\.\\s*[\\d.]+)?'), regexp_extract_all(c, 'Art\\.\\s+\\d+[a-z]?(?:\\s+Abs\\.\\s+\\d+)?(?:\\s+lit\\.\\s+[a-z])?(?:\\s+(?:Ziff|Bst)\\.\\s+\\d+)?\\s+[A-ZÄÖÜ][A-Za-zÄÖÜäöü]+'))))"
_PASSAGES = ", passages AS (SELECT l_orderkey AS doc_id, string_agg(citation, ' und ' ORDER BY pos) AS c FROM cited GROUP BY ALL)"


def passages(spark, sf_dir, only=None):
    """(doc_id, text): the citations of an order, as a passage that holds them; only(doc_id) names the orders that are asked for."""
    parts, rows = F.array_sort(F.collect_list(F.struct("pos", "citation"))), cited(spark, sf_dir).withColumnRenamed("l_orderkey", "doc_id")
    if only is not None:  # before rows are gathered, which takes memory with their number
        rows = rows.join(only, "doc_id", "left_semi")
    return rows.groupBy("doc_id").agg(F.array_join(F.transform(parts, lambda x: x["citation"]), " und ").alias("text"))


_RETRIEVED = ", found AS (SELECT o_orderkey AS doc_id, o_custkey % 40 AS query_id, row_number() OVER (PARTITION BY o_custkey % 40 ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders QUALIFY rank <= 100)"
_VOTES = f", votes AS (SELECT query_id, citation, count(*) AS votes FROM found JOIN (SELECT doc_id, unnest({_MINED}) AS citation FROM passages) USING (doc_id) GROUP BY ALL)"


def _neighbours(spark, sf_dir, k):
    orders = table(spark, sf_dir, "orders").selectExpr("o_orderkey AS doc_id", "o_custkey % 40 AS query_id", "o_totalprice AS score")
    found = retrieval.top_k(orders, 100).select("query_id", "doc_id")
    return retrieval.neighbour_votes(found, passages(spark, sf_dir, found.select("doc_id")), fn.mined_citations(F.col("text")), k)


@register(WITH_CITED + _PASSAGES + _RETRIEVED + _VOTES + " SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY votes DESC, citation) AS rank FROM votes QUALIFY rank <= 100")
def neighbour_votes(spark, sf_dir):
    return _neighbours(spark, sf_dir, 100)


@register(WITH_CITED + _PASSAGES + _RETRIEVED + _VOTES + """, gold AS (SELECT DISTINCT query_id, citation FROM cited WHERE l_tax >= 0.07), ks AS (SELECT unnest([1, 2, 3, 5]) AS min_votes)
SELECT min_votes, (SELECT count(*) FROM votes v SEMI JOIN gold g ON v.query_id = g.query_id AND v.citation = g.citation WHERE votes >= min_votes) AS hits, (SELECT count(*) FROM votes WHERE votes >= min_votes) AS candidates FROM ks""")
def vote_threshold_recall(spark, sf_dir):
    votes = _neighbours(spark, sf_dir, 1 << 30).drop("rank")
    gold = cited(spark, sf_dir).where("l_tax >= 0.07").select("query_id", "citation", F.lit(1).alias("g")).distinct()
    ks = spark.createDataFrame([(k,) for k in (1, 2, 3, 5)], "min_votes int")
    rows = votes.join(gold, ["query_id", "citation"], "left").groupBy("votes").agg(F.count("g").alias("g"), F.count("*").alias("n"))
    rows = ks.join(rows, F.col("votes") >= F.col("min_votes"), "left").groupBy("min_votes").agg(F.sum("g").alias("hits"), F.sum("n").alias("candidates"))
    return rows.fillna(0, ["hits", "candidates"])


_DENSE = """WITH q AS (SELECT vec_id AS query_id, embedding AS qe FROM embeddings WHERE vec_id % 50 = 0),
s AS (SELECT query_id, vec_id AS key, round(list_inner_product(embedding::DOUBLE[], qe::DOUBLE[]), 6) AS score FROM embeddings, q),
t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, key) AS rank FROM s QUALIFY rank <= 50)"""


def _dense(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("key"), "embedding")
    return retrieval.dense_top_k(vectors.where("key % 50 = 0").withColumnRenamed("key", "query_id"), vectors, 50)


@register(_DENSE + " SELECT query_id, key, score, rank FROM t")
def dense_topk(spark, sf_dir):
    return _dense(spark, sf_dir)


@register(_DENSE + " SELECT query_id % 5 AS query_id, key, min(rank) AS rank FROM t GROUP BY ALL")
def dense_best_rank(spark, sf_dir):
    return _dense(spark, sf_dir).groupBy((F.col("query_id") % 5).alias("query_id"), "key").agg(F.min("rank").alias("rank"))


@register(_DENSE + " SELECT query_id, key, CASE WHEN rank <= 10 THEN 0.72 WHEN rank <= 25 THEN 0.66 WHEN rank <= 50 THEN 0.58 WHEN rank <= 100 THEN 0.50 ELSE 0.44 END::DOUBLE AS value FROM t")
def rank_step_score(spark, sf_dir):
    return _dense(spark, sf_dir).select("query_id", "key", retrieval.rank_step(F.col("rank"), [(10, 0.72), (25, 0.66), (50, 0.58), (100, 0.50)], 0.44).alias("value"))


@register("SELECT vec_id, round(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x)), 4) AS norm, len(embedding) AS dims FROM embeddings")
def vector_normalize(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").withColumn("v", retrieval.normalized(F.col("embedding")))
    return rows.select("vec_id", F.round(retrieval.dot(F.col("v"), F.col("v")), 4).alias("norm"), F.size("v").alias("dims"))


@register(WITH_CITED + _PASSAGES + r""" SELECT doc_id, len(list_distinct(regexp_extract_all(c, 'Art\.\s+\d+[a-z]?(?:\s+Abs\.\s+\d+(?:\s+lit\.\s+[a-z])?)?\s+[A-ZÄÖÜ][A-Za-zÄÖÜäöü]+'))) AS explicit,
 array_to_string(list_sort(list_distinct(regexp_extract_all(c, 'BGE\s+\d+\s+[IVX]+\s+\d+'))), ';') AS cases FROM passages""")
def explicit_citations(spark, sf_dir):
    text = F.col("text")
    return passages(spark, sf_dir).select("doc_id", F.size(fn.explicit_citations(text)).alias("explicit"), fn.join_citations(fn.explicit_cases(text)).alias("cases"))


@register(WITH_CITED + r""" SELECT DISTINCT citation, trim(regexp_replace(citation, '\s+E\.\s+.*$', '')) AS court_base, regexp_extract(citation, '\s+([A-ZÄÖÜ]{2,}[A-Za-zÄÖÜäöü]*)$', 1) AS code,
 CASE WHEN citation NOT LIKE 'Art. %' THEN citation WHEN regexp_extract(citation, '\s+([A-ZÄÖÜ]{2,}[A-Za-zÄÖÜäöü]*)$', 1) <> '' THEN concat(regexp_extract(citation, '^(Art\.\s+\d+[a-z]?)', 1), ' ', regexp_extract(citation, '\s+([A-ZÄÖÜ]{2,}[A-Za-zÄÖÜäöü]*)$', 1)) ELSE regexp_extract(citation, '^(Art\.\s+\d+[a-z]?)', 1) END AS law_base,
 CASE WHEN citation LIKE 'Art.%' THEN 'law' ELSE 'court' END AS kind, CASE WHEN citation LIKE 'Art.%' THEN concat(split_part(citation, ' ', 1), ' ', split_part(citation, ' ', 2), ' ', split_part(citation, ' ', -1)) ELSE citation END AS token_base FROM cited""")
def citation_parts(spark, sf_dir):
    c = F.col("citation")
    return cited(spark, sf_dir).select("citation").distinct().select(c, fn.court_base(c).alias("court_base"), fn.statute_code(c).alias("code"), fn.law_base(c).alias("law_base"), fn.kind_of(c).alias("kind"), F.when(fn.is_law(c), fn.law_base_by_tokens(c)).otherwise(c).alias("token_base"))


@register(WITH_CITED + " SELECT split_part(citation, ' ', -1) AS statute, split_part(citation, ' ', 2) AS article, count(*) AS n, count(DISTINCT citation) AS citations FROM cited WHERE citation LIKE 'Art.%' GROUP BY ROLLUP (statute, article)")
def law_base_rollup(spark, sf_dir):
    rows = cited(spark, sf_dir).where(fn.is_law(F.col("citation"))).select("citation", fn.law_key(F.col("citation")).alias("k"))
    return rows.select("citation", "k.statute", "k.article").rollup("statute", "article").agg(F.count("*").alias("n"), F.count_distinct("citation").alias("citations"))


_SIBLINGS = r", sib AS (SELECT base, citation, row_number() OVER (PARTITION BY base ORDER BY citation) AS n FROM (SELECT DISTINCT trim(regexp_replace(citation, '\s+E\.\s+.*$', '')) AS base, citation FROM cited WHERE citation LIKE 'BGE%') QUALIFY n <= {n})"


@register(WITH_CITED + _SIBLINGS.format(n=8) + " SELECT base, citation, n FROM sib")
def court_siblings(spark, sf_dir):
    return fusion.siblings(cited(spark, sf_dir).where("citation LIKE 'BGE%'"), 8).select("base", "citation", "n")


#: A corpus that lacks some paragraphs, letters and whole articles of what is asked for.
_WANTED = """, wanted AS (SELECT DISTINCT citation FROM cited WHERE citation LIKE 'Art.%'), known AS (SELECT DISTINCT CASE WHEN l_partkey % 7 < 2 THEN regexp_replace(citation, ' Abs. ([0-9]+)', ' Abs. \\1 lit. a') WHEN l_partkey % 7 < 4 THEN regexp_replace(citation, ' Abs. [0-9]+', '') ELSE citation END AS citation
 FROM (SELECT *, (pos % 100000000) // 1000 AS l_partkey FROM cited) WHERE citation LIKE 'Art.%' AND l_partkey % 7 < 5 AND l_quantity < 40)"""


def _wanted(spark, sf_dir):
    laws = cited(spark, sf_dir).where("citation LIKE 'Art.%'").withColumn("l_partkey", F.expr("(pos % 100000000) DIV 1000"))
    longer, shorter = F.regexp_replace("citation", r" Abs. ([0-9]+)", " Abs. $1 lit. a"), F.regexp_replace("citation", r" Abs. [0-9]+", "")
    known = laws.where("l_partkey % 7 < 5 AND l_quantity < 40").select(F.when(F.col("l_partkey") % 7 < 2, longer).when(F.col("l_partkey") % 7 < 4, shorter).otherwise(F.col("citation")).alias("citation"))
    return laws.select("citation").distinct(), known.distinct()


@register(WITH_CITED + _WANTED + """, k AS (SELECT citation AS match, split_part(citation, ' ', -1) AS s, split_part(citation, ' ', 2) AS a FROM known), m AS (SELECT citation, split_part(citation, ' ', -1) AS s, split_part(citation, ' ', 2) AS a FROM wanted ANTI JOIN known USING (citation))
SELECT citation, match, count(*) OVER (PARTITION BY citation) AS n FROM m JOIN k USING (s, a)""")
def fuzzy_key_candidates(spark, sf_dir):
    return resolve.law_candidates(*_wanted(spark, sf_dir))


#: The similarity in closed form for these shapes: all of one side but a paragraph's number, or all of it.
_RATIO = "2.0 * CASE WHEN NOT contains(match, ' Abs. ') THEN length(match) WHEN split_part(match, ' ', 4) = split_part(citation, ' ', 4) THEN length(citation) ELSE length(citation) - 1 END / (length(citation) + length(match))"


@register(WITH_CITED + _WANTED + f""", k AS (SELECT citation AS match, split_part(citation, ' ', -1) AS s, split_part(citation, ' ', 2) AS a FROM known), m AS (SELECT citation, split_part(citation, ' ', -1) AS s, split_part(citation, ' ', 2) AS a FROM wanted ANTI JOIN known USING (citation)),
p AS (SELECT citation, match, count(*) OVER (PARTITION BY citation) AS n FROM m JOIN k USING (s, a)), r AS (SELECT citation, match, {_RATIO} AS ratio FROM p WHERE n > 1)
SELECT citation, citation AS match FROM wanted SEMI JOIN known USING (citation) UNION ALL SELECT citation, match FROM p WHERE n = 1 UNION ALL
SELECT citation, match FROM (FROM r WHERE ratio >= 0.75 QUALIFY row_number() OVER (PARTITION BY citation ORDER BY ratio DESC, match) = 1)""")
def fuzzy_ratio(spark, sf_dir):
    return resolve.resolve_laws(*_wanted(spark, sf_dir))


@register(WITH_CITED + r""", known AS (SELECT DISTINCT citation FROM cited WHERE citation LIKE 'BGE%' AND l_quantity < 45), wanted AS (SELECT DISTINCT citation FROM cited WHERE citation LIKE 'BGE%' AND l_quantity >= 40),
b AS (SELECT trim(regexp_replace(citation, '\s+E\.\s+.*$', '')) AS base, citation AS match, row_number() OVER (PARTITION BY base ORDER BY citation) AS n FROM known QUALIFY n <= 8)
SELECT citation, citation AS match FROM wanted SEMI JOIN known USING (citation) UNION ALL
SELECT w.citation, b.match FROM (SELECT citation, trim(regexp_replace(citation, '\s+E\.\s+.*$', '')) AS base FROM wanted ANTI JOIN known USING (citation)) w JOIN b USING (base)""")
def court_resolution(spark, sf_dir):
    courts = cited(spark, sf_dir).where("citation LIKE 'BGE%'")
    return resolve.resolve_courts(courts.where("l_quantity >= 40"), courts.where("l_quantity < 45").select("citation").distinct())


_TERMS = [("the", "der"), ("of the", "von der"), ("and", "und"), ("with", "mit"), ("that", "dass"), ("for", "für")]


@register("""WITH g AS (SELECT * FROM (VALUES ('the','der'),('of the','von der'),('and','und'),('with','mit'),('that','dass'),('for','für')) t(en, de)), j AS (SELECT item_id AS query_id, text AS query, en, de FROM benchmark LEFT JOIN g ON contains(lower(text), lower(en)))
SELECT query_id, coalesce(string_agg(de, ' ' ORDER BY -length(en), en, de), any_value(query)) AS terms FROM j GROUP BY query_id""")
def glossary_translate(spark, sf_dir):
    return resolve.translate(asked(spark, sf_dir), spark.createDataFrame(_TERMS, "en string, de string"))


@register("""WITH b AS (SELECT conv_id, turn, text FROM conversations)
SELECT conv_id, turn, CASE WHEN length(trim(regexp_replace(text, '\\s+', ' ', 'g'))) > 40 THEN concat(rtrim(substr(trim(regexp_replace(text, '\\s+', ' ', 'g')), 1, 37)), '...') ELSE trim(regexp_replace(text, '\\s+', ' ', 'g')) END AS short,
 sha1(to_json({'conv_id': conv_id, 'turn': turn})::VARCHAR) AS key FROM b""".replace("\\\\s", "\\s"))
def compact_and_key(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations")
    return rows.select("conv_id", "turn", fn.compact(F.col("text"), 40).alias("short"), fn.payload_key(F.col("conv_id"), F.col("turn")).alias("key"))


@register(WITH_CITED + " SELECT l_orderkey, max_by(substr(citation, 1, 500), (length(substr(citation, 1, 500)), -pos)) AS citation FROM cited GROUP BY ALL")
def dedupe_longest(spark, sf_dir):
    return resolve.keep_longest(cited(spark, sf_dir), "l_orderkey", "citation", "pos").select("l_orderkey", "citation")


@register(WITH_CITED + " SELECT citation, min(pos) AS pos FROM cited GROUP BY ALL")
def dedupe_first(spark, sf_dir):
    return resolve.keep_first(cited(spark, sf_dir).select("citation", "pos"), "citation", "pos")


@register(WITH_CITED + " SELECT query_id, max_by(citation, pos) AS citation FROM cited GROUP BY ALL")
def dedupe_last(spark, sf_dir):
    return resolve.keep_last(cited(spark, sf_dir), "query_id", "citation", "pos")


@register(WITH_CITED + ", j AS (SELECT query_id, string_agg(citation, ' ' ORDER BY pos) AS t FROM cited GROUP BY ALL) SELECT query_id, CASE WHEN length(t) > 1500 THEN concat(substr(t, 1, 1500), '…') ELSE t END AS citation FROM j")
def dedupe_concat(spark, sf_dir):
    return resolve.concat_parts(cited(spark, sf_dir), "query_id", "citation", "pos")


@register("WITH t AS (SELECT conv_id, turn, role, min(turn) OVER (PARTITION BY conv_id, role) AS first FROM conversations) SELECT conv_id, role, first AS pos FROM t GROUP BY ALL")
def ordered_distinct(spark, sf_dir):
    return table(spark, sf_dir, "conversations").groupBy("conv_id", "role").agg(F.min("turn").alias("pos"))


@register("SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events")
def json_props(spark, sf_dir):
    fenced = F.concat(F.lit("```json\n"), F.col("props"), F.lit("\n```"))
    answer = F.when(F.col("event_id") % 3 == 0, fenced).when(F.col("event_id") % 3 == 1, F.concat(F.lit("Answer: "), F.col("props"), F.lit("."))).otherwise(F.col("props"))
    return table(spark, sf_dir, "events").select("event_id", fn.lenient_json(answer, "k int")["k"].alias("k"))


@register("SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN ['BGE ' || p_partkey] ELSE list_transform(range(1, p_partkey % 3 + 1), lambda e: 'BGE ' || p_partkey || ' E. ' || e) END AS c FROM part".replace("SELECT p_partkey, CASE", "SELECT p_partkey, unnest(CASE").replace("END AS c", "END) AS citation"))
def case_expansion(spark, sf_dir):
    n = (F.col("p_partkey") % 3).cast("int")
    notes = F.when(n > 0, F.transform(F.sequence(F.lit(1), n), lambda e: e.cast("string")))
    return table(spark, sf_dir, "part").select("p_partkey", F.explode(fn.expand_case(F.concat(F.lit("BGE "), F.col("p_partkey").cast("string")), notes)).alias("citation"))


@register("WITH d AS (SELECT DISTINCT conv_id FROM conversations WHERE role = 'assistant' AND turn > 2) SELECT conv_id, count(*) AS turns FROM conversations ANTI JOIN d USING (conv_id) GROUP BY ALL")
def pending_rows(spark, sf_dir):
    from lexquarry.sources.io import pending

    rows = table(spark, sf_dir, "conversations")
    return pending(rows, rows.where("role = 'assistant' AND turn > 2"), "conv_id").groupBy("conv_id").agg(F.count("*").alias("turns"))


@register("WITH r AS (SELECT *, row_number() OVER (ORDER BY conv_id, turn) AS pos FROM conversations) SELECT conv_id, turn FROM r WHERE role = 'user' ORDER BY pos LIMIT 50 OFFSET 10")
def query_slice(spark, sf_dir):
    from lexquarry.sources.io import slice_queries

    rows = table(spark, sf_dir, "conversations").withColumn("pos", F.col("conv_id") * 1000 + F.col("turn")).withColumnRenamed("role", "query_id")
    return slice_queries(rows, "pos", spark.createDataFrame([("user",)], "query_id string"), 10, 50).select("conv_id", "turn")


@register(_bm25() + """, a AS (""" + _TOP.format(k=20) + """), gold AS (SELECT item_id AS query_id, doc_id FROM documents d, benchmark b WHERE contains(d.text, b.text)), ids AS (SELECT item_id AS query_id FROM benchmark),
c AS (SELECT query_id, count(p.doc_id) AS n_pred, count(g.doc_id) AS n_gold, count(*) FILTER (p.doc_id IS NOT NULL AND g.doc_id IS NOT NULL) AS tp FROM (SELECT query_id, doc_id FROM a WHERE rank <= 5) p FULL JOIN gold g USING (query_id, doc_id) GROUP BY ALL)
SELECT query_id, coalesce(tp, 0) AS tp, coalesce(n_pred, 0) AS n_pred, coalesce(n_gold, 0) AS n_gold, CASE WHEN coalesce(n_pred, 0) + coalesce(n_gold, 0) = 0 THEN 1.0 ELSE round(2 * coalesce(tp, 0) / (coalesce(n_pred, 0) + coalesce(n_gold, 0)), 6) END AS f1 FROM ids LEFT JOIN c USING (query_id)""")
def retrieval_f1(spark, sf_dir):
    """The whole path: BM25, the five best documents, and F1 against the documents that hold the item."""
    from lexquarry.operators import metrics

    items, docs = asked(spark, sf_dir), corpus(spark, sf_dir)
    top = retrieval.top_k(retrieval.bm25(docs, items, k=20), 20).where("rank <= 5").select("query_id", F.col("doc_id").alias("citation"))
    held = substrings.holding(docs.select("doc_id", "text"), "text", items, "query").select("query", F.col("doc_id").alias("citation"))
    gold = held.join(items, "query").select("query_id", "citation")
    return metrics.per_query(top, gold, items).select("query_id", "tp", "n_pred", "n_gold", "f1")


