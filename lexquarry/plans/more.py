"""Queries over sources, saved indexes, lookups, generations, feature sets and searches of configurations."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from lexquarry.functions import text as fn
from lexquarry.operators import config_grid, ensemble, extra, features, generations, learn, lookup, metrics, resolve, retrieval, select
from lexquarry.operators.retrieval import Bm25
from lexquarry.plans import base
from lexquarry.plans.base import CANDIDATES, GOLD, IDS, RUNS, WITH_CITED, WITH_HITS, asked, cited, corpus, register, table
from lexquarry.plans.retrieval import _DENSE, _PASSAGES, _TOP, _WANTED, _bm25, _wanted, passages
from lexquarry.plans.selection import _BUCKETS, _JUDGED, judged
from lexquarry.sources import io
from lexquarry.sources.scratch import scratch

_R = f"{WITH_HITS}, {RUNS}, {IDS}, {GOLD}"
_C = f"{WITH_HITS}, {CANDIDATES}, {IDS}, {GOLD}"
_J = f"{_C}, {RUNS}, {_BUCKETS}, {_JUDGED}"


def _folder(spark, name: str) -> str:
    import uuid

    return f"{scratch(spark).root}/{name}-{uuid.uuid4().hex}"


# Sources and sinks: each query writes and reads again.


@register("SELECT p_partkey::VARCHAR AS p_partkey, p_name, p_brand FROM part")
def corpus_csv(spark, sf_dir):
    path = _folder(spark, "corpus") + ".csv"
    table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand").write.csv(path, header=True, escape='"')
    return io.read_corpus(spark, path)


_LISTS = ", lists AS (SELECT doc_id AS query_id, string_agg(citation, ' ; ' ORDER BY pos) || ';' AS c FROM (SELECT l_orderkey AS doc_id, pos, citation FROM cited) GROUP BY ALL)"


def _lists(spark, sf_dir, name):
    parts = F.array_sort(F.collect_list(F.struct("pos", "citation")))
    return cited(spark, sf_dir).groupBy(F.col("l_orderkey").alias("query_id")).agg(F.concat(F.array_join(F.transform(parts, lambda x: x["citation"]), " ; "), F.lit(";")).alias(name))


@register(WITH_CITED + " SELECT DISTINCT l_orderkey AS query_id, citation FROM cited")
def gold_loader(spark, sf_dir):
    return io.explode_gold(_lists(spark, sf_dir, "gold_citations"))


@register(WITH_CITED + " SELECT DISTINCT l_orderkey AS query_id, citation FROM cited")
def prediction_loader(spark, sf_dir):
    return io.explode_predictions(_lists(spark, sf_dir, "citations"))


@register("SELECT n_nationkey::VARCHAR AS query_id, n_name AS name, n_regionkey AS region FROM nation")
def json_map(spark, sf_dir):
    path = _folder(spark, "map")
    rows = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("k"), F.struct(F.col("n_name").alias("name"), F.col("n_regionkey").cast("long").alias("region")).alias("v"))
    rows.agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("k", "v")))).alias("value")).coalesce(1).write.text(path)  # a map of nations
    return io.read_json_map(spark, path, "struct<name: string, region: bigint>").select("query_id", "value.name", "value.region")


@register(f"{_R} SELECT query_id, citation, count(*) AS freq, min('run' || variant) AS first FROM runs WHERE variant <> 2 GROUP BY ALL")
def run_union(spark, sf_dir):
    rows = io.union_runs({f"run{v}": base.run(spark, sf_dir, v) for v in (0, 1, 3, 4)})
    return io.run_frequency(rows)


@register(f"{WITH_HITS} SELECT query_id::VARCHAR AS key, max(event_id) AS created_at, arg_max(source, event_id) AS label FROM hits GROUP BY ALL")
def cache_jsonl(spark, sf_dir):
    path = _folder(spark, "cache")
    base.hits(spark, sf_dir).select(F.to_json(F.struct(F.col("query_id").cast("string").alias("key"), F.col("event_id").alias("created_at"), F.col("source").alias("label"))).alias("value")).unionByName(spark.createDataFrame([('{"key": "1", "created_at"',)], "value string")).write.text(path)
    return io.read_cache(spark, path, "key string, created_at long, label string")


@register(f"{_R} SELECT query_id, citation, min(variant) AS variant FROM runs SEMI JOIN (SELECT query_id, min(variant) AS variant FROM runs GROUP BY ALL) USING (query_id, variant) GROUP BY ALL")
def first_shard(spark, sf_dir):
    path = _folder(spark, "shards")
    for v in range(5):
        base.run(spark, sf_dir, v).withColumn("variant", F.lit(v)).coalesce(1).write.parquet(f"{path}/shard-{v}")
    return io.read_shards(spark, f"{path}/shard-*")


@register("SELECT 'regions' AS stage, count(*) AS rows FROM region")
def stage_manifest(spark, sf_dir):
    path = _folder(spark, "stage")
    io.write_stage(table(spark, sf_dir, "region"), path, "regions", {"a": 1})
    return spark.read.text(f"{path}/regions.manifest").select(F.from_json("value", "stage string, rows long").alias("m")).select("m.stage", "m.rows")


@register("SELECT conv_id, count(*) AS turns FROM conversations WHERE conv_id IS NOT NULL GROUP BY ALL")
def appended_rows(spark, sf_dir):
    """What an interrupted run has written and a second one adds; each conversation comes once."""
    path, rows = _folder(spark, "appended"), table(spark, sf_dir, "conversations").where("conv_id IS NOT NULL")
    io.append_pending(rows.where("conv_id < 20"), path, "conv_id")
    io.append_pending(rows, path, "conv_id")
    return spark.read.parquet(path).groupBy("conv_id").agg(F.count("*").alias("turns"))


@register("""SELECT regexp_replace(r_name, '[^A-Za-z0-9_.-]+', '_', 'g') || '.csv' AS name, (SELECT count(*) FROM nation WHERE n_regionkey = r_regionkey) AS tests, (SELECT count(*) FROM nation WHERE n_regionkey = r_regionkey AND n_name < 'J') AS vals
FROM region WHERE EXISTS (SELECT 1 FROM nation WHERE n_regionkey = r_regionkey AND n_name < 'J') AND EXISTS (SELECT 1 FROM nation WHERE n_regionkey = r_regionkey)""")
def file_pairs(spark, sf_dir):
    """A file of nations for each region, and one of its first nations where it has some; the pairs are found by name and read."""
    path, name = _folder(spark, "pairs"), F.concat(fn.safe_name(F.col("r_name")), F.lit(".csv"))
    rows = table(spark, sf_dir, "region").join(table(spark, sf_dir, "nation"), F.col("r_regionkey") == F.col("n_regionkey")).select(name.alias("name"), "n_name")
    for prefix, part in (("test_submission_", rows), ("val_pred_", rows.where("n_name < 'J'"))):
        for r in part.select("name").distinct().collect():  # regions
            part.where(F.col("name") == r["name"]).select("n_name").write.csv(f"{path}/{prefix}{r['name']}", header=True)
    out = None
    for p in io.pair_files(spark, path).collect():
        sides = [spark.read.csv(p[side], header=True).agg(F.count("n_name").alias(n)) for side, n in (("left", "tests"), ("right", "vals"))]
        one = sides[0].crossJoin(sides[1]).select(F.lit(p["name"]).alias("name"), "tests", "vals")  # a row each
        out = one if out is None else out.unionByName(one)
    return out if out is not None else spark.createDataFrame([], "name string, tests long, vals long")


_CONFIG = "cfg AS (SELECT round(avg(raw_score), 3) AS thresh, count(DISTINCT kind) * 5 AS target FROM candidates)"


@register(f"{WITH_HITS}, {CANDIDATES}, {_CONFIG} SELECT query_id, citation, row_number() OVER (PARTITION BY query_id ORDER BY raw_score DESC, citation) AS position FROM candidates, cfg WHERE raw_score >= thresh QUALIFY position <= min(target) OVER ()")
def saved_config(spark, sf_dir):
    """A configuration that is taken from the candidates, saved, loaded and applied to them."""
    path, rows = _folder(spark, "config"), base.candidates(spark, sf_dir)
    found = rows.agg(F.round(F.avg("raw_score"), 3), F.count_distinct("kind") * 5).first()
    extra.save_config({"thresh": found[0], "target": found[1]}, path, spark)
    c = extra.load_config(path, spark)
    chosen = select.greedy(rows, F.lit(c["target"]), F.lit(1 << 30), F.lit(c["thresh"]), F.lit(0), score="raw_score")
    return chosen.select("query_id", "citation", "position")


# Saved indexes.


@register(_bm25() + " " + _TOP.format(k=20))
def saved_index(spark, sf_dir):
    """The index of all terms, kept at a path, read and searched."""
    path = _folder(spark, "saved-index")
    retrieval.index(corpus(spark, sf_dir), path=path)
    return retrieval.top_k(retrieval.search(retrieval.read_index(spark, path), asked(spark, sf_dir), k=20), 20)


_OKAPI = (
    _bm25()
    .replace(" WHERE term IN (SELECT term FROM qt)", "")
    .replace("bm AS (", "f AS (SELECT term, ln(s.n - df.df + 0.5) - ln(df.df + 0.5) AS idf FROM df, stats s), g AS (SELECT term, CASE WHEN idf < 0 THEN 0.25 * (SELECT avg(idf) FROM f) ELSE idf END AS idf FROM f),\nbm AS (")
    .replace("ln((s.n - df.df + 0.5) / (df.df + 0.5) + 1)", "df.idf")
    .replace("stats s, df, qt q", "stats s, g df, qt q")
)


@register(_OKAPI + " " + _TOP.format(k=20))
def bm25_okapi(spark, sf_dir):
    return retrieval.top_k(retrieval.bm25(corpus(spark, sf_dir), asked(spark, sf_dir), Bm25(idf="okapi"), k=20), 20)


@register(_DENSE + " SELECT query_id, key, rank FROM t")
def vectors_added(spark, sf_dir):
    """Blocks of vectors that were added in two parts, the second of which has the first again."""
    path = _folder(spark, "vectors")
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("key"), "embedding")
    retrieval.add_vectors(rows.where("key % 3 = 0"), path)
    retrieval.add_vectors(rows, path)
    queries = retrieval.packed(rows.where("key % 50 = 0").withColumnRenamed("key", "query_id"), "query_id", retrieval.QUERIES)
    return retrieval.dense_blocks(queries, retrieval.read_index(spark, path), 50).select("query_id", "key", "rank")


# Lookups and agents.

_CORPUS = WITH_CITED + ", named AS (SELECT citation, min(pos) AS pos FROM cited GROUP BY ALL)"


def _named(spark, sf_dir):
    return cited(spark, sf_dir).groupBy("citation").agg(F.min("pos").alias("pos"))


@register(_CORPUS + ", a AS (SELECT unnest(['StGB', 'ZGB', 'Abs. 3']) AS asked) SELECT asked, citation, row_number() OVER (PARTITION BY asked ORDER BY pos, citation) AS n FROM named, a WHERE contains(citation, asked) QUALIFY n <= 100")
def substring_search(spark, sf_dir):
    return lookup.containing(_named(spark, sf_dir), spark.createDataFrame([("StGB",), ("ZGB",), ("Abs. 3",)], "asked string"))


@register(_CORPUS + ", a AS (SELECT unnest(['BGE 101 II 3 E. 2', 'BGE 10']) AS asked) SELECT asked, citation, row_number() OVER (PARTITION BY asked ORDER BY pos, citation) AS n FROM named, a WHERE starts_with(citation, trim(regexp_replace(asked, '\\s+E\\.\\s+.*$', '')))")
def prefix_search(spark, sf_dir):
    return lookup.starting(_named(spark, sf_dir), spark.createDataFrame([("BGE 101 II 3 E. 2",), ("BGE 10",)], "asked string"))


@register(_CORPUS + " SELECT split_part(citation, ' ', -1) AS code, citation, substr('text of ' || citation, 1, 150) AS text, row_number() OVER (PARTITION BY code ORDER BY pos, citation) AS n FROM named WHERE citation LIKE 'Art.%' AND code IN ('OR', 'BGG', 'XYZ') QUALIFY n <= 30")
def statute_listing(spark, sf_dir):
    texts = _named(spark, sf_dir).withColumn("text", F.concat(F.lit("text of "), "citation"))
    return lookup.of_statute(texts, spark.createDataFrame([("OR",), ("BGG",), ("XYZ",)], "code string"))


@register(_bm25() + ", a AS (" + _TOP.format(k=15) + ") SELECT query_id, rank, doc_id, substr(text, 1, 300) AS text FROM a JOIN documents USING (doc_id) WHERE score > 0")
def search_tool(spark, sf_dir):
    docs = corpus(spark, sf_dir)
    return lookup.searched(retrieval.top_k(retrieval.bm25(docs, asked(spark, sf_dir), k=15), 15), docs)


@register(f"{_C}, texts AS (SELECT DISTINCT citation, CASE WHEN length(citation) % 2 = 0 THEN 'text of ' || citation ELSE '' END AS text FROM hits WHERE score < 0.5) SELECT query_id, citation, coalesce(nullif(text, ''), 'NOT FOUND') AS text, coalesce(nullif(text, ''), citation) AS snippet FROM (SELECT query_id, citation FROM candidates WHERE baseline_rank <= 40) LEFT JOIN texts USING (citation)")
def text_lookup(spark, sf_dir):
    texts = base.hits(spark, sf_dir).where("score < 0.5").select("citation").distinct().withColumn("text", F.when(F.length("citation") % 2 == 0, F.concat(F.lit("text of "), "citation")).otherwise(""))
    rows = base.candidates(spark, sf_dir).where("baseline_rank <= 40").select("query_id", "citation")
    return resolve.snippets(resolve.lookup(rows, texts).select("query_id", "citation", F.col("text").alias("found")), texts).select("query_id", "citation", F.col("found").alias("text"), "snippet")


@register(f"{_C}, members AS (SELECT DISTINCT citation FROM hits WHERE kind = 'law') SELECT DISTINCT citation, CASE WHEN citation IN (FROM members) THEN 'law' ELSE 'court' END AS kind FROM candidates")
def kind_by_membership(spark, sf_dir):
    laws = base.hits(spark, sf_dir).where("kind = 'law'").select("citation")
    return fn.kind_by_membership(base.candidates(spark, sf_dir).select("citation").distinct(), laws).select("citation", "kind")


_EXPLICIT = WITH_CITED + _WANTED + r""", asked AS (SELECT l_orderkey AS query_id, string_agg('What of ' || citation || '?', ' ' ORDER BY pos) AS q FROM cited WHERE l_orderkey % 5 = 0 GROUP BY ALL),
e AS (SELECT DISTINCT query_id, unnest(regexp_extract_all(q, 'Art\.\s+\d+[a-z]?(?:\s+Abs\.\s+\d+(?:\s+lit\.\s+[a-z])?)?\s+[A-ZÄÖÜ][A-Za-zÄÖÜäöü]+')) AS named FROM asked),
m AS (SELECT w.citation, min(k.citation) AS match FROM wanted w JOIN known k ON split_part(k.citation, ' ', 2) = split_part(w.citation, ' ', 2) AND split_part(k.citation, ' ', -1) = split_part(w.citation, ' ', -1) GROUP BY ALL),
r AS (SELECT query_id, CASE WHEN k.citation IS NULL AND match IS NOT NULL THEN match ELSE named END AS citation, CASE WHEN k.citation IS NULL AND match IS NOT NULL THEN 0.93 ELSE 0.95 END::DOUBLE AS score FROM e LEFT JOIN known k ON k.citation = named LEFT JOIN m ON m.citation = named)"""


@register(_EXPLICIT + " SELECT query_id, citation, max(score) AS score, CASE WHEN max(score) = 0.95 THEN 'explicit' ELSE 'explicit_fuzzy' END AS source FROM r GROUP BY ALL")
def explicit_references(spark, sf_dir):
    parts = F.array_sort(F.collect_list(F.struct("pos", "citation")))
    text = F.array_join(F.transform(parts, lambda x: F.concat(F.lit("What of "), x["citation"], F.lit("?"))), " ")
    questions = cited(spark, sf_dir).where("l_orderkey % 5 = 0").groupBy(F.col("l_orderkey").alias("query_id")).agg(text.alias("query"))
    wanted, known = _wanted(spark, sf_dir)
    key = lambda c: F.concat_ws(" ", F.element_at(F.split(c, " "), 2), fn.statute_token(c))
    match = wanted.withColumn("key", key(F.col("citation"))).join(known.select(F.col("citation").alias("m"), key(F.col("citation")).alias("key")), "key").groupBy("citation").agg(F.min("m").alias("match"))
    return lookup.explicit_references(questions, match, known)


_AGENTS = f"""{WITH_HITS}, f AS (SELECT query_id, CASE WHEN is_explicit THEN 'explicit' WHEN kind = 'law' THEN 'statute' ELSE 'caselaw' END AS agent, citation, max(score * 30) AS score FROM hits GROUP BY ALL),
l0 AS (SELECT query_id, 'statute' AS agent, citation, 0.5 AS score FROM (SELECT DISTINCT query_id FROM hits), (SELECT DISTINCT citation FROM hits WHERE citation LIKE '%BGG')), l AS (FROM l0 ANTI JOIN f USING (query_id, citation, agent)),
p AS (SELECT query_id, trim(regexp_replace(citation, '\\s+E\\.\\s+.*$', '')) AS base, max(score) AS score FROM (FROM f WHERE agent = 'caselaw' QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, citation) <= 20) GROUP BY ALL),
s AS (SELECT trim(regexp_replace(citation, '\\s+E\\.\\s+.*$', '')) AS base, citation FROM (SELECT DISTINCT citation FROM hits WHERE kind = 'court') QUALIFY row_number() OVER (PARTITION BY base ORDER BY citation) <= 10),
k AS (SELECT query_id, 'caselaw' AS agent, citation, score * 0.5 AS score FROM p JOIN s USING (base)), found AS (SELECT query_id, agent, citation, score FROM f UNION ALL SELECT query_id, agent, citation, score FROM l UNION ALL SELECT query_id, agent, citation, score FROM k ANTI JOIN f USING (query_id, agent, citation)),
o AS (SELECT query_id, citation, max(CASE WHEN agent = 'explicit' THEN 1.0 ELSE least(score / 20.0, 1.0) END::DOUBLE) AS score, count(DISTINCT agent) AS agents FROM found GROUP BY ALL)"""


@register(_AGENTS.replace("\\\\", "\\") + " SELECT query_id, citation, round(score * CASE WHEN agents >= 2 THEN 1.5 ELSE 1 END * CASE WHEN agents >= 3 THEN 1.3 ELSE 1 END, 6)::DOUBLE AS score, agents FROM o")
def agent_gather(spark, sf_dir):
    rows = base.hits(spark, sf_dir)
    found = rows.select("query_id", F.when(F.col("is_explicit"), "explicit").when(F.col("kind") == "law", "statute").otherwise("caselaw").alias("agent"), "citation", (F.col("score") * 30).alias("score"))
    listed = rows.select("query_id").distinct().crossJoin(F.broadcast(rows.where("citation LIKE '%BGG'").select("citation").distinct()))  # a statute's articles
    return lookup.consolidated(lookup.gathered(found, listed, rows.where("kind = 'court'").select("citation")))


@register(f"{WITH_HITS}, p AS (SELECT DISTINCT query_id::VARCHAR AS key FROM hits), c AS (SELECT query_id::VARCHAR AS key, max(source) AS label, max(score) AS confidence FROM hits WHERE query_id % 3 > 0 GROUP BY ALL) SELECT key, coalesce(label, 'reject') AS label, coalesce(confidence, 0)::DOUBLE AS confidence, label IS NULL AS fallback FROM p LEFT JOIN c USING (key)")
def judge_fallback(spark, sf_dir):
    rows = base.hits(spark, sf_dir).withColumn("key", F.col("query_id").cast("string"))
    cache = rows.where("query_id % 3 > 0").groupBy("key").agg(F.max("source").alias("label"), F.max("score").alias("confidence"))
    return lookup.answered(rows.select("key").distinct(), cache).select("key", "label", "confidence", "fallback")


@register(WITH_CITED + _LISTS + """ SELECT query_id, array_to_string(list_transform(list_filter(string_split(c, ' ; '), lambda x: true), lambda x: replace(x, ';', '')), '|') AS laws FROM lists""")
def json_salvage(spark, sf_dir):
    """Arrays that are cut off behind their last string."""
    names = F.transform(F.split("c", " ; "), lambda x: F.concat(F.lit('"'), F.regexp_replace(x, ";", ""), F.lit('"')))
    cut = F.concat(F.lit('{"reasoning": "x", "law_citations": ['), F.array_join(names, ", "), F.when(F.col("query_id") % 2 == 0, "]").otherwise(", "))
    return _lists(spark, sf_dir, "c").select("query_id", F.array_join(lookup.salvaged(cut, "law_citations"), "|").alias("laws"))


# Generations.

_KEY_STATUTES = "CASE query_id % 3 WHEN 0 THEN ['StPO', 'ZGB', 'OR'] WHEN 1 THEN ['OR', 'Art. 1'] ELSE ['BGG'] END"
_STATE = "CASE WHEN citation IN (FROM known) THEN 'known' WHEN kind = 'court' AND query_id % 2 = 0 THEN 'sibling' WHEN length(citation) % 2 = 0 THEN 'fuzzy' ELSE 'unknown' END"


def _gen_sql() -> str:
    def value(x):
        return "NULL" if x is None else f"'{x}'" if isinstance(x, str) else str(x).lower() if isinstance(x, bool) else f"{x!r}::VARCHAR[]" if isinstance(x, list) else repr(x)

    columns = [x.split()[0] for x in re.sub("<[^>]*>", "", generations.SCHEMA).split(",")]
    rows = ", ".join("(" + ", ".join(value(x) for x, n in zip(r, columns) if n not in ("boost", "ranks", "rank_else")) + ")" for r in generations.ROWS)
    named = [n for n in columns if n not in ("boost", "ranks", "rank_else")]
    return f"""{WITH_HITS}, g AS (SELECT * FROM (VALUES {rows}) t({', '.join(named)})), known AS (SELECT DISTINCT citation FROM hits WHERE score < 0.5),
h AS (SELECT query_id, citation, kind, CASE WHEN is_explicit THEN 'explicit' ELSE source END AS source, CASE WHEN NOT is_explicit AND source = 'bm25' THEN score * 30 ELSE score END AS score, event_id % 150 + 1 AS rank, freq, {_STATE} AS state FROM hits),
x AS (SELECT *, max(CASE WHEN source = 'bm25' THEN score END) OVER (PARTITION BY generation, query_id) AS best FROM h, g),
w AS (SELECT *, round(CASE source WHEN 'dense' THEN score * dense * CASE WHEN rank <= dense_top THEN dense_lift ELSE 1 END WHEN 'bm25' THEN CASE WHEN rank <= bm25_top THEN score / coalesce(bm25_div, best) * bm25 END
 WHEN 'gpt_full' THEN CASE WHEN by_freq THEN CASE WHEN state <> 'unknown' THEN CASE WHEN kind = 'law' THEN least(0.80::DOUBLE + freq * 0.05::DOUBLE, 0.95) - CASE WHEN state = 'fuzzy' THEN 0.05::DOUBLE ELSE 0 END WHEN state = 'sibling' THEN 0.70 WHEN state = 'fuzzy' THEN 0.85 ELSE least(0.78::DOUBLE + freq * 0.05::DOUBLE, 0.93) END END
   WHEN kind = 'law' THEN CASE WHEN state = 'known' THEN law ELSE law_else END ELSE CASE WHEN state = 'known' THEN court ELSE court_else END END
 WHEN 'explicit' THEN CASE WHEN state = 'known' THEN explicit WHEN state <> 'unknown' THEN coalesce(explicit_fuzzy, explicit_else) ELSE explicit_else END
 WHEN 'court_dense' THEN CASE WHEN generation = 'v8' THEN CASE WHEN rank - 1 < 20 THEN 0.68 WHEN rank - 1 < 50 THEN 0.60 WHEN rank - 1 < 100 THEN 0.52 ELSE 0.42 END WHEN generation = 'v11' THEN CASE WHEN rank <= 10 THEN 0.72 WHEN rank <= 25 THEN 0.66 WHEN rank <= 50 THEN 0.58 WHEN rank <= 100 THEN 0.50 ELSE 0.44 END WHEN generation = 'v1' THEN score END
 WHEN 'gpt_specific' THEN CASE WHEN state = 'known' THEN 0.92 WHEN state <> 'unknown' THEN 0.88 END WHEN 'gpt_case' THEN CASE WHEN state = 'known' THEN 0.85 END END::DOUBLE, 9) AS worth FROM x),
o AS (SELECT generation, query_id, citation, max(worth) AS raw_score, max(CASE WHEN NOT (generation IN ('v3', 'v4') AND source = 'gpt_case') THEN worth END) AS early, max(CASE WHEN generation IN ('v3', 'v4') AND source = 'gpt_case' THEN worth END) AS late, list_sort(list(DISTINCT source)) AS sources FROM w WHERE worth IS NOT NULL GROUP BY ALL),
k AS (SELECT o.*, CASE WHEN (generation = 'v3' AND list_contains(sources, 'bm25')) OR generation = 'v4' THEN len(list_filter({_KEY_STATUTES}, lambda s: contains(citation, s))) ELSE 0 END AS times FROM o),
l AS (SELECT *, CASE times WHEN 0 THEN early WHEN 1 THEN least(early * 1.3, 0.92) ELSE least(least(early * 1.3, 0.92) * 1.3, 0.92) END AS lifted FROM k),
c AS (SELECT l.*, two, two_cap, three, three_cap, CASE WHEN list_contains(counted, '*') THEN len(sources) ELSE len(list_intersect(sources, counted)) END AS n FROM l JOIN g USING (generation)),
b AS (SELECT *, CASE WHEN n >= 2 THEN least(lifted * two, two_cap) ELSE lifted END AS t2 FROM c), d AS (SELECT *, CASE WHEN n >= 3 THEN least(t2 * three, three_cap) ELSE t2 END AS t3 FROM b),
s AS (SELECT generation, query_id, citation, raw_score, round(greatest(t3, late), 6) AS score, sources FROM d)"""


def _key_statutes(spark, sf_dir):
    """The key statutes of each query."""
    return base.queries(spark, sf_dir).select("query_id", F.expr(_KEY_STATUTES.replace("[", "array(").replace("]", ")")).alias("statutes"))


def _generation_hits(spark, sf_dir):
    rows = base.hits(spark, sf_dir)
    known = rows.where("score < 0.5").select("citation").distinct().withColumn("known", F.lit(True))
    state = F.when(F.col("known"), "known").when((F.col("kind") == "court") & (F.col("query_id") % 2 == 0), "sibling").when(F.length("citation") % 2 == 0, "fuzzy").otherwise("unknown")
    rows = rows.join(known, "citation", "left")
    return rows.select("query_id", "citation", "kind", F.when(F.col("is_explicit"), "explicit").otherwise(F.col("source")).alias("source"), F.when(~F.col("is_explicit") & (F.col("source") == "bm25"), F.col("score") * 30).otherwise(F.col("score")).alias("score"), (F.col("event_id") % 150 + 1).alias("rank"), "freq", state.alias("state"))


@register(_gen_sql() + " SELECT generation, query_id, citation, raw_score, score, array_to_string(sources, ';') AS sources FROM s")
def generation_scores(spark, sf_dir):
    rows = generations.scored(_generation_hits(spark, sf_dir), generations.table(spark), _key_statutes(spark, sf_dir))
    return rows.select("generation", "query_id", "citation", "raw_score", "score", F.array_join("sources", ";").alias("sources"))


@register()
def generation_lists(spark, sf_dir):
    """Every generation's final list: scored, with siblings, verified, cut; tests hold each cut against its own operator."""
    configs = generations.table(spark)
    known = base.hits(spark, sf_dir).where("score < 0.5").select("citation")
    rows = generations.scored(_generation_hits(spark, sf_dir), configs, _key_statutes(spark, sf_dir))
    rows = generations.with_siblings(rows, known.where("citation LIKE 'BGE%'"), configs)
    estimates = base.queries(spark, sf_dir).withColumn("estimate", F.col("query_id") % 30 + 3)
    before = configs.withColumn("verify", F.when(F.col("verify") == "after", "none").otherwise(F.col("verify")))
    out = generations.cut(generations.verified(rows, known, before), estimates).withColumn("is_explicit", F.lit(False))
    return generations.verified(out, known, configs.where("verify = 'after'").unionByName(configs.where("verify <> 'after'").withColumn("verify", F.lit("none")))).drop("is_explicit")


# Feature sets.

_SRC = ["dense", "bm25", "gpt_full", "gpt_specific", "gpt_case", "court_dense", "cocitation"]


def _inv(name: str) -> str:
    return f"CASE WHEN {name} > 0 THEN round(1.0::DOUBLE / (1 + {name}), 6) ELSE 0 END::DOUBLE AS inv_{name}"


def _one(expr: str, name: str) -> str:
    return f"coalesce({expr}, false)::INT AS {name}"


_KINDS = [_one("kind = 'law'", "is_law"), _one("kind = 'court'", "is_court")]
_LABELS = [_one(f"judge_label = '{x}'", f"label_{x}") for x in features.LABELS]
_BUCKET = [_one("auto_bucket = 'auto_drop'", "bucket_auto_drop"), _one("auto_bucket = 'auto_keep'", "bucket_auto_keep"), _one("auto_bucket NOT IN ('auto_drop', 'auto_keep')", "bucket_other")]
_SOURCES = [_one(f"list_contains(sources, '{s}')", f"src_{s}") for s in _SRC]
_FLAGS = [_one("is_explicit", "explicit"), _one("is_query_case", "query_case"), "freq AS gpt_freq"]
_META = [*_KINDS, *_LABELS, *_BUCKET, "judge_confidence AS confidence", "final_score AS final", "raw_score AS raw", *_FLAGS, *map(_inv, ("dense_rank", "bm25_rank", "court_dense_rank")), *_SOURCES, "len(sources)::INT AS n_sources", "estimate AS estimated"]


@register(f"{_J} SELECT query_id, citation, {', '.join(_META)} FROM judged")
def features_full_meta(spark, sf_dir):
    return features.meta(judged(spark, sf_dir), _SRC)


@register(f"{_J}, f AS (SELECT query_id, citation, {', '.join(_META)} FROM judged) SELECT * REPLACE (0 AS label_reject, 0 AS label_plausible, 0 AS label_must_include, 0::DOUBLE AS confidence) FROM f")
def features_masked(spark, sf_dir):
    return features.masked(features.meta(judged(spark, sf_dir), _SRC))


_CODE = "regexp_extract(citation, '\\s+([A-ZÄÖÜ]{2,}[A-Za-zÄÖÜäöü]*)$', 1)"
_BASE = "CASE WHEN citation LIKE 'Art.%' THEN concat(split_part(citation, ' ', 1), ' ', split_part(citation, ' ', 2), ' ', split_part(citation, ' ', -1)) ELSE split_part(citation, ' E. ', 1) END"
_LEVELS = f"levels AS (SELECT level, key, count(*) AS n FROM (SELECT unnest(['exact', 'base', 'code']) AS level, unnest([citation, {_BASE}, {_CODE}]) AS key FROM gold) WHERE key <> '' GROUP BY ALL)"
_POOL = ["count(*) OVER (PARTITION BY query_id) AS pool", "count(*) FILTER (kind = 'law') OVER (PARTITION BY query_id) AS laws", "count(*) FILTER (kind <> 'law') OVER (PARTITION BY query_id) AS courts"]
_CODES = ["OR", "ZGB", "BGG"]
_TRAIN = [
    *_KINDS, *_BUCKET, "raw_score AS raw", "final_score AS final", "round(final_score - raw_score, 6) AS lift", *_FLAGS, *[_one(f"freq >= {k}", f"freq_{k}") for k in (1, 2, 3)],
    _one("starts_with(citation, 'Art. ')", "form_art"), _one("starts_with(citation, 'BGE ')", "form_bge"), _one("starts_with(citation, 'BGer ')", "form_bger"), _one("contains(citation, ' E. ')", "form_e"),
    *map(_inv, ("baseline_rank", "dense_rank", "bm25_rank", "court_dense_rank")), "len(sources)::INT AS n_sources", "estimate AS estimated", *_POOL,
    *[f"coalesce((SELECT n FROM levels WHERE level = '{x}' AND key = {e}), 0) AS prior_{x}" for x, e in (("exact", "citation"), ("base", _BASE), ("code", _CODE))], *_SOURCES, *[_one(f"{_CODE} = '{c}'", f"code_{c}") for c in _CODES],
]


@register(f"{_J}, {_LEVELS} SELECT query_id, citation, {', '.join(_TRAIN)} FROM judged")
def features_train(spark, sf_dir):
    return features.train(judged(spark, sf_dir), _SRC, learn.priors(base.gold(spark, sf_dir)), _CODES)


_PLACE = "(row_number() OVER (PARTITION BY query_id ORDER BY final_score DESC, citation) - 1)"
_SURE = "(row_number() OVER (PARTITION BY query_id ORDER BY judge_confidence DESC, citation) - 1)"
_SHARE = "round({} / greatest(count(*) OVER (PARTITION BY query_id) - 1, 1), 6)"
_STAT = "CASE WHEN citation LIKE 'Art.%' THEN split_part(citation, ' ', -1) ELSE '' END"
_BOOSTED = [
    *_KINDS, "raw_score AS raw", "final_score AS final", "round(final_score - raw_score, 6) AS lift", *_FLAGS, _one("freq >= 1", "freq_1"), _one("freq >= 2", "freq_2"), *map(_inv, ("dense_rank", "bm25_rank", "court_dense_rank", "baseline_rank")), *_LABELS,
    "judge_confidence AS confidence", "round(CASE judge_label WHEN 'must_include' THEN 2.0 WHEN 'plausible' THEN 1.0 ELSE 0.0 END::DOUBLE * judge_confidence, 6) AS bonus", *_BUCKET, *_SOURCES, "len(sources)::INT AS n_sources", _one("len(sources) >= 2", "agree"),
    _one("citation LIKE 'Art.%'", "form_art"), _one("citation LIKE 'BGE%'", "form_bge"), *[_one(f"{_STAT} = '{s}'", f"code_{s}") for s in features.STATUTES], "estimate AS estimated", "round(ln(1 + estimate), 6) AS log_estimated", *_POOL, f"{_SHARE.format(_PLACE)} AS rank_pct",
    _one("kind = 'law' AND judge_label = 'must_include'", "law_must"), "(kind = 'law')::INT * freq AS law_freq", f"(kind = 'court')::INT * {_inv('court_dense_rank').replace(' AS inv_court_dense_rank', '')} AS court_inv", _one("judge_label = 'must_include' AND auto_bucket = 'auto_keep'", "must_kept"),
    "round(final_score * judge_confidence, 6) AS final_conf", _one("dense_rank < 50 AND bm25_rank < 50", "both_near"), f"{_SHARE.format(_PLACE)} AS score_pct", f"{_SHARE.format(_SURE)} AS conf_pct", f"({_SHARE.format(_PLACE)} <= 0.05)::INT AS top_5pct", f"({_SURE} < 10)::INT AS conf_top10",
]


@register(f"{_J} SELECT query_id, citation, {', '.join(_BOOSTED)} FROM judged")
def features_boosted(spark, sf_dir):
    return features.boosted(judged(spark, sf_dir), _SRC)


# Priors by channel and the hybrid score.

_CHANNELS = f"""sized AS (SELECT query_id, count(*) AS golds FROM gold GROUP BY ALL), chan AS (SELECT query_id, CASE WHEN query_id % 3 = 0 THEN 'dense100' WHEN golds >= 10 THEN 'dense12' WHEN golds BETWEEN 7 AND 9 THEN 'sparse79' END AS channel FROM queries LEFT JOIN sized USING (query_id) WHERE query_id % 3 < 2),
counted AS (SELECT citation, 'all' AS channel FROM gold UNION ALL SELECT citation, 'dense' FROM gold JOIN sized USING (query_id) WHERE golds >= 10 UNION ALL SELECT citation, channel FROM runs JOIN chan USING (query_id) WHERE variant = 1 AND channel IS NOT NULL),
channels AS (SELECT channel, level, key, count(*) AS n FROM (SELECT channel, unnest(['exact', 'law_base']) AS level, unnest([citation, CASE WHEN citation LIKE 'Art.%' THEN {_BASE} END]) AS key FROM counted) WHERE key <> '' GROUP BY ALL)"""


def _channels(spark, sf_dir):
    ids = base.queries(spark, sf_dir)
    return learn.prior_channels(base.gold(spark, sf_dir), ids.where("query_id % 3 = 0"), ids.where("query_id % 3 = 1"), base.run(spark, sf_dir, 1))


@register(f"{_R}, {_CHANNELS} FROM channels")
def prior_channels(spark, sf_dir):
    return _channels(spark, sf_dir)


#: Invented weights, one for each name.
WEIGHTS = {n: round(((i * 37) % 19 - 6) / 10, 1) for i, n in enumerate([*ensemble.PLAIN, *ensemble.SOURCES, *ensemble.PRIORS, *ensemble.PENALTIES])}


def _hybrid_sql(weights: dict | None = None) -> str:
    def count(channel, level):
        key = "citation" if level == "exact" else f"CASE WHEN citation LIKE 'Art.%' THEN {_BASE} END"
        n = f"round(ln(1 + coalesce((SELECT n FROM channels WHERE channel = '{channel}' AND level = '{level}' AND key = {key}), 0)), 9)"
        return n if channel in ("dense100", "dense12", "sparse79") else f"CASE WHEN found OR law THEN {n} ELSE 0 END"

    plain = ["in_left", "in_right", "in_left AND in_right", "auto_bucket = 'auto_keep'", "is_explicit", "judge_label = 'must_include'", "judge_label = 'plausible'", "judge_label = 'reject'", "judge_confidence", "final_score", "raw_score", "freq", "len(sources)", "law", "NOT law"]
    terms = [f"coalesce(({e})::DOUBLE, 0)" for e in plain] + [f"coalesce(list_contains(sources, '{s}')::DOUBLE, 0)" for s in ensemble.SOURCES.values()] + [count(*x) for x in ensemble.PRIORS.values()]
    terms += ["coalesce((sources = ['court_dense'])::DOUBLE, 0)", "coalesce((len(sources) <= 1)::DOUBLE, 0)"]
    weights = WEIGHTS if weights is None else weights
    return " + ".join(f"{weights[n]} * {t}" for n, t in zip(WEIGHTS, terms) if weights[n])


def _pooled(spark, sf_dir):
    """Two prediction sets and the best candidates as one pool, these candidates, and the priors."""
    found = judged(spark, sf_dir).where("baseline_rank <= 60")
    marks = lambda df, l, r: df.select("query_id", "citation", F.lit(l).alias("in_left"), F.lit(r).alias("in_right"))
    pool = marks(base.run(spark, sf_dir, 1), True, False).unionByName(marks(base.run(spark, sf_dir, 2), False, True)).unionByName(marks(found, False, False))
    pool = pool.groupBy("query_id", "citation").agg(F.bool_or("in_left").alias("in_left"), F.bool_or("in_right").alias("in_right"))
    return pool, found, _channels(spark, sf_dir)


_POOLED = """pool AS (SELECT query_id, citation, bool_or(v = 1) AS in_left, bool_or(v = 2) AS in_right FROM (SELECT query_id, citation, variant AS v FROM runs WHERE variant IN (1, 2) UNION ALL SELECT query_id, citation, 0 FROM judged WHERE baseline_rank <= 60) GROUP BY ALL),
z AS (SELECT p.query_id, p.citation, in_left, in_right, j.* EXCLUDE (query_id, citation), j.citation IS NOT NULL AS found, coalesce(j.kind = 'law', p.citation LIKE 'Art.%') AS law FROM pool p LEFT JOIN (FROM judged WHERE baseline_rank <= 60) j ON j.query_id = p.query_id AND j.citation = p.citation)"""


@register(f"{_J}, {_CHANNELS}, {_POOLED} SELECT query_id, citation, round({_hybrid_sql()}, 4) AS score FROM z")
def hybrid_score(spark, sf_dir):
    """All 32 weights over the candidates and two prediction sets."""
    terms = ensemble.hybrid_terms(*_pooled(spark, sf_dir))
    return terms.select("query_id", "citation", F.round(ensemble.linear_score(terms, WEIGHTS), 4).alias("score"))


#: The whole grid around one configuration: fixed values.
GRID = config_grid.Grid.of(
    {**dict.fromkeys(WEIGHTS, 0.0), "v7_bonus": 0.5, "v11_bonus": 2.0, "auto_keep_bonus": 0.5, "must_bonus": 1.0, "plausible_bonus": 0.5, "conf_weight": 1.5, "final_weight": 2.0, "raw_weight": 0.3, "gpt_freq_weight": 0.8, "single_source_penalty": -0.5},
    {"both_bonus": [0.0, 0.5, 1.0], "court_bonus": [-1.0, -0.8, -0.5, -0.2, 0.0], "court_dense_bonus": [-0.8, -0.5, -0.2, 0.0], "exact_train_weight": [0.0, 0.1, 0.3], "law_base_train_weight": [0.0, 0.1, 0.3, 0.5], "dense_law_base_train_weight": [0.0, 0.2, 0.5, 0.8]},
    law_per_base=[0, 1, 2, 3], court_per_base=[0, 1, 2], court_fraction=[0.15, 0.2, 0.25],
)
DRAWN = [(i * 7919 + 13) % 103_680 for i in range(16)]


def _grid_rows(spark, sf_dir):
    return config_grid.terms(*_pooled(spark, sf_dir), base.gold(spark, sf_dir))


@register()
def hybrid_grid(spark, sf_dir):
    """The 100 best of all 103,680 configurations by objective; tests hold the grid against a loop, hybrid_grid_drawn against SQL."""
    scores = config_grid.grid_scores(config_grid.selected_counts(_grid_rows(spark, sf_dir), GRID), base.gold(spark, sf_dir), base.queries(spark, sf_dir))
    return scores.orderBy(F.desc("objective"), "config_id").limit(100)


def _grid_sql() -> str:
    """The loop of the selection for the drawn configurations, a candidate a step."""
    varied = ["both_bonus", "court_bonus", "court_dense_bonus", "exact_train_weight", "law_base_train_weight", "dense_law_base_train_weight"]
    rows = [(i, *[GRID.config(i)[x] for x in (*varied, "law_per_base", "court_per_base", "court_fraction")]) for i in DRAWN]
    fixed = {n: (n if n in varied else w) for n, w in zip(GRID.names, GRID.weights[0].tolist())}
    return f"""{_J}, {_CHANNELS}, {_POOLED}, cfg(config_id, {', '.join(varied)}, law_per_base, court_per_base, court_fraction) AS (VALUES {', '.join(map(str, rows))}),
    est AS (SELECT query_id, max(estimate) AS est FROM z WHERE found GROUP BY ALL),
    zl AS (SELECT z.*, coalesce(g.x, 0) AS label FROM z LEFT JOIN (SELECT *, 1 AS x FROM gold) g USING (query_id, citation)),
    sc AS (SELECT config_id, query_id, citation, NOT law AS court, CASE WHEN law THEN {_BASE} ELSE trim(regexp_replace(citation, '\\s+E\\.\\s+.*$', '')) END AS base, label, law_per_base, court_per_base,
      least(32, greatest(8, round_even(est * 1.0, 0) + 2))::INT AS target, court_fraction, row_number() OVER (PARTITION BY config_id, query_id ORDER BY round({_hybrid_sql(fixed)}, 6) DESC, coalesce(in_left, false) DESC, coalesce(in_right, false) DESC, citation) AS step FROM zl JOIN est USING (query_id) CROSS JOIN cfg),
    scan AS (SELECT config_id, query_id, 0::BIGINT AS step, 0 AS n, 0 AS tp, 0 AS courts, []::VARCHAR[] AS bases FROM sc GROUP BY ALL UNION ALL
      SELECT config_id, query_id, step, n + take::INT, tp + CASE WHEN take THEN label ELSE 0 END, courts + (take AND court)::INT, CASE WHEN take THEN list_append(bases, key) ELSE bases END FROM (
        SELECT *, n < target AND NOT (court AND courts >= round_even(target * court_fraction::DOUBLE, 0)) AND NOT (NOT court AND law_per_base > 0 AND has >= law_per_base) AND NOT (court AND court_per_base > 0 AND has >= court_per_base) AS take FROM (
          SELECT s.*, concat(s.court, s.base) AS key, c.n, c.tp, c.courts, c.bases, len(list_filter(c.bases, lambda b: b = concat(s.court, s.base))) AS has FROM scan c JOIN sc s ON s.config_id = c.config_id AND s.query_id = c.query_id AND s.step = c.step + 1))),
    ends AS (SELECT config_id, query_id, arg_max(n, step) AS n, arg_max(tp, step) AS tp, arg_max(courts, step) AS courts FROM scan GROUP BY ALL),
    per AS (SELECT config_id, CASE WHEN coalesce(n, 0) + coalesce(m, 0) = 0 THEN 1.0 ELSE 2 * coalesce(tp, 0) / (coalesce(n, 0) + coalesce(m, 0)) END::DOUBLE AS f1, coalesce(n, 0) AS n, CASE WHEN coalesce(n, 0) = 0 THEN 0 ELSE courts / n END::DOUBLE AS share
      FROM queries CROSS JOIN (SELECT config_id FROM cfg) LEFT JOIN ends USING (config_id, query_id) LEFT JOIN (SELECT query_id, count(*) AS m FROM gold GROUP BY ALL) USING (query_id)),
    means AS (SELECT config_id, avg(f1) AS f, avg(n) AS k, avg(share) AS c FROM per GROUP BY ALL)
    SELECT config_id::INT AS config_id, round(f, 6) AS macro_f1, round(k, 6) AS avg_n, round(c, 6) AS court_fraction, round(f - greatest(0, 0.28 - c) * 0.9 - greatest(0, 24 - k) * 0.01, 6) AS objective FROM means""".replace("WITH ", "WITH RECURSIVE ", 1)


@register(_grid_sql())
def hybrid_grid_drawn(spark, sf_dir):
    """Sixteen configurations of the grid by the same operator."""
    counts = config_grid.selected_counts(_grid_rows(spark, sf_dir), GRID, DRAWN)
    return config_grid.grid_scores(counts, base.gold(spark, sf_dir), base.queries(spark, sf_dir))


# Searches of configurations, folds and selections.

_OPTIONS = dict(target_mult=[0.2, 0.25, 0.3, 0.35, 0.4, 0.45, 0.5, 0.6, 0.7], bias=[-8, -6, -4, -2, 0, 2], min_out=[2, 4, 6, 8], max_out=[8, 10, 12, 14, 16, 18, 20], thresh=[0.05, 0.1, 0.2, 0.3, 0.4, 0.6, 0.8, 0.9], court_cap_frac=[0.0, 0.05, 0.1, 0.15, 0.2, 0.25])
_DRAWN = "drawn AS (SELECT range::INT AS config_id, " + ", ".join(f"{v!r}[(((range * 7919 + {i} * 104729 + 7) * 1103515245 + 12345) % 2147483648) // 65536 % {len(v)} + 1] AS {n}" for i, (n, v) in enumerate(_OPTIONS.items())) + " FROM range(30))"
_META_SWEEP = f"""{_DRAWN}, t AS (SELECT query_id, config_id, thresh, min_out, least(max_out, greatest(min_out, round_even((query_id % 30 + 3) * target_mult::DOUBLE + bias, 0))) AS target, court_cap_frac::DOUBLE AS frac FROM (SELECT DISTINCT query_id FROM candidates), drawn WHERE max_out >= min_out),
m AS (SELECT c.query_id, c.citation, kind, raw_score AS prob, (g.x IS NOT NULL)::INT AS label, row_number() OVER (PARTITION BY c.query_id, kind ORDER BY raw_score DESC, c.citation) AS kr FROM candidates c LEFT JOIN (SELECT *, 1 AS x FROM gold) g ON g.query_id = c.query_id AND g.citation = c.citation),
pl AS (SELECT *, row_number() OVER (PARTITION BY config_id, query_id ORDER BY prob DESC, citation) AS position FROM m JOIN t USING (query_id) WHERE kind <> 'court' OR kr <= greatest(0, round_even(target * frac, 0))),
got AS (SELECT config_id, query_id, count(*) AS n_pred, sum(label) AS tp FROM pl WHERE position <= target AND (prob >= thresh OR position <= min_out) GROUP BY ALL),
per AS (SELECT config_id, query_id, CASE WHEN coalesce(n_pred, 0) + coalesce(n_gold, 0) = 0 THEN 1 ELSE round(2 * coalesce(tp, 0) / (coalesce(n_pred, 0) + coalesce(n_gold, 0)), 6) END::DOUBLE AS f1 FROM queries CROSS JOIN (SELECT config_id FROM drawn WHERE max_out >= min_out) LEFT JOIN got USING (config_id, query_id) LEFT JOIN (SELECT query_id, count(*) AS n_gold FROM gold GROUP BY ALL) USING (query_id))"""


def _meta_sweep(spark, sf_dir):
    rows = base.candidates(spark, sf_dir).withColumn("prob", F.col("raw_score"))
    return learn.meta_sweep(rows, base.gold(spark, sf_dir), base.queries(spark, sf_dir), learn.random_configs(spark, 30, 7, **_OPTIONS))


@register(f"{_C}, {_META_SWEEP} SELECT config_id, round(avg(f1), 8) AS mean_f1 FROM per GROUP BY ALL ORDER BY mean_f1 DESC, config_id LIMIT 1")
def random_search(spark, sf_dir):
    return learn.best_config(_meta_sweep(spark, sf_dir))


@register(f"{_C}, {_META_SWEEP}, st AS (SELECT query_id, CASE WHEN coalesce(n, 0) <= 3 THEN 'few' WHEN n <= 10 THEN 'some' ELSE 'many' END AS stratum FROM queries LEFT JOIN (SELECT query_id, count(*) AS n FROM gold GROUP BY ALL) USING (query_id)), a AS (SELECT stratum, config_id, round(avg(f1), 8) AS mean_f1 FROM per JOIN st USING (query_id) GROUP BY ALL) FROM a QUALIFY row_number() OVER (PARTITION BY stratum ORDER BY mean_f1 DESC, config_id) = 1")
def stratified_search(spark, sf_dir):
    n = F.coalesce("n", F.lit(0))
    strata = base.queries(spark, sf_dir).join(base.gold(spark, sf_dir).groupBy("query_id").agg(F.count("*").alias("n")), "query_id", "left").select("query_id", F.when(n <= 3, "few").when(n <= 10, "some").otherwise("many").alias("stratum"))
    return learn.stratified_best(_meta_sweep(spark, sf_dir), strata)


def _meta_select(least_first: str) -> str:
    return f"""{_C}, t AS (SELECT *, {least_first} AS target FROM (SELECT *, round_even(estimate * 0.7::DOUBLE - 4, 0) AS raw FROM candidates)), x AS (SELECT *, row_number() OVER (PARTITION BY query_id, kind ORDER BY raw_score DESC, citation) AS kr FROM t),
y AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY raw_score DESC, citation) AS position FROM x WHERE kind <> 'court' OR kr <= greatest(0, round_even(target * 0.25::DOUBLE, 0))) SELECT query_id, citation, position FROM y WHERE position <= target AND (raw_score >= 0.9 OR position <= 6)"""


def _select(spark, sf_dir, least: int, most: int, least_first: bool):
    rows = base.candidates(spark, sf_dir)
    target = select.meta_target(F.col("estimate"), F.lit(0.7), F.lit(-4), F.lit(least), F.lit(most), least_first)
    return select.greedy(rows, target, F.greatest(F.lit(0), F.bround(target * 0.25)), F.lit(0.9), F.lit(6), score="raw_score").select("query_id", "citation", "position")


@register(_meta_select("least(14, greatest(6, raw))"))
def select_meta(spark, sf_dir):
    return _select(spark, sf_dir, 6, 14, True)


@register(_meta_select("greatest(16, least(12, raw))"))
def select_boosted(spark, sf_dir):
    """The other order of the bounds: a smallest output above the largest one wins."""
    return _select(spark, sf_dir, 16, 12, False)


@register(f"{_C}, x AS (SELECT *, row_number() OVER (PARTITION BY query_id, kind ORDER BY raw_score DESC, citation) AS kr FROM candidates) SELECT query_id, citation, row_number() OVER (PARTITION BY query_id ORDER BY raw_score DESC, citation) AS position FROM x WHERE kind <> 'court' OR kr <= 4 QUALIFY position <= estimate")
def select_capped(spark, sf_dir):
    rows = base.candidates(spark, sf_dir)
    return select.greedy(rows, F.col("estimate"), F.lit(4), F.lit(float("-inf")), F.lit(0), score="raw_score").select("query_id", "citation", "position")


@register(f"{_R}, r AS (SELECT query_id, row_number() OVER (ORDER BY md5(concat_ws(':', 7, query_id)), query_id) - 1 AS i FROM queries) SELECT query_id, least(i // (42 // 5), 4)::INT AS fold FROM r")
def shuffled_kfold(spark, sf_dir):
    return learn.shuffled_folds(base.queries(spark, sf_dir), 5)


@register(f"{_R} SELECT query_id, (row_number() OVER (ORDER BY query_id) - 1)::INT AS fold FROM queries")
def leave_one_out(spark, sf_dir):
    return learn.leave_one_out(base.queries(spark, sf_dir))


# Ensembles.


@register(f"{_R}, v AS (SELECT query_id, citation, count(*) AS votes FROM runs GROUP BY ALL), ks AS (SELECT unnest([1, 2, 3, 4]) AS k), c AS (SELECT query_id, k, count(v.citation) AS n, count(g.x) AS tp FROM v JOIN ks ON votes >= k LEFT JOIN (SELECT *, 1 AS x FROM gold) g USING (query_id, citation) GROUP BY ALL), z AS (SELECT query_id, count(*) AS n_gold FROM gold GROUP BY ALL), "
          "per AS (SELECT k, CASE WHEN coalesce(n, 0) + coalesce(n_gold, 0) = 0 THEN 1 ELSE round(2 * coalesce(tp, 0) / (coalesce(n, 0) + coalesce(n_gold, 0)), 6) END::DOUBLE AS f1 FROM queries CROSS JOIN ks LEFT JOIN c USING (query_id, k) LEFT JOIN z USING (query_id)) SELECT k, round(avg(f1), 8) AS f1 FROM per GROUP BY k ORDER BY round(avg(f1), 8) DESC, k LIMIT 1")  # fmt: skip
def vote_best_threshold(spark, sf_dir):
    return ensemble.best_threshold(base.runs(spark, sf_dir), base.gold(spark, sf_dir), base.queries(spark, sf_dir), [1, 2, 3, 4])


@register(f"""{_R}, v AS (SELECT query_id, citation, count(*) AS votes FROM runs GROUP BY ALL), z AS (SELECT query_id, variant, count(*) AS n FROM runs GROUP BY ALL), p AS (SELECT query_id, greatest(1, round_even(avg(n), 0) + 1) AS target, ceil(round(count(*) * 0.8, 9)) AS least FROM z GROUP BY ALL),
h AS (SELECT v.*, EXISTS (FROM runs r WHERE r.variant = 3 AND r.query_id = v.query_id AND r.citation = v.citation) AS a, EXISTS (FROM runs r WHERE r.variant = 4 AND r.query_id = v.query_id AND r.citation = v.citation) AS b FROM v)
SELECT query_id, citation, votes, row_number() OVER (PARTITION BY query_id ORDER BY votes DESC, a DESC, b DESC, citation) AS rank FROM h JOIN p USING (query_id) QUALIFY votes >= least OR rank <= target""")
def consensus_anchored(spark, sf_dir):
    firsts = base.run(spark, sf_dir, 3), base.run(spark, sf_dir, 4)
    return ensemble.consensus_target(base.runs(spark, sf_dir), 0.8, 1, "mean", firsts)


def _run(i: int) -> str:
    return f"(SELECT query_id, citation FROM runs WHERE variant = {i})"


@register(f"""{_R}, a AS {_run(0)}, x AS (SELECT *, 1 AS x FROM {_run(3)}), y AS (SELECT *, 1 AS y FROM {_run(4)}), v AS (SELECT query_id, citation, count(*) AS votes, citation LIKE 'Art.%' AS law, coalesce(any_value(x), 0) AS x, coalesce(any_value(y), 0) AS y FROM (FROM runs WHERE variant IN (1, 2)) LEFT JOIN x USING (query_id, citation) LEFT JOIN y USING (query_id, citation) GROUP BY query_id, citation),
ad AS (SELECT * FROM v ANTI JOIN a USING (query_id, citation) WHERE votes >= 1 QUALIFY row_number() OVER (PARTITION BY query_id, law ORDER BY votes DESC, x DESC, y DESC, law DESC, citation) <= CASE WHEN law THEN 2 ELSE 1 END),
added AS (SELECT query_id, citation FROM ad QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY votes DESC, x DESC, y DESC, law DESC, citation) <= 2),
g AS (SELECT a.query_id, a.citation, a.citation LIKE 'Art.%' AS law, coalesce(x, 0) AS x, coalesce(y, 0) AS y FROM (FROM a ANTI JOIN v USING (query_id, citation)) a LEFT JOIN x USING (query_id, citation) LEFT JOIN y USING (query_id, citation)),
g2 AS (FROM g QUALIFY law OR row_number() OVER (PARTITION BY query_id, law ORDER BY x, y, law, citation) <= 1), gone AS (SELECT query_id, citation FROM g2 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY x, y, law, citation) <= 3)
SELECT *, 'kept' AS change FROM a ANTI JOIN gone USING (query_id, citation) UNION ALL SELECT *, 'added' FROM added UNION ALL SELECT *, 'removed' FROM gone""")
def perturb_anchored(spark, sf_dir):
    firsts = base.run(spark, sf_dir, 3), base.run(spark, sf_dir, 4)
    return ensemble.perturbed(base.run(spark, sf_dir, 0), base.runs(spark, sf_dir).where("variant IN (1, 2)"), 1, 2, 1, 2, 3, firsts, 1)


@register(f"""{_R}, t AS (SELECT i.range AS i, j.range AS j, k.range AS k FROM range(1, 5) i, range(1, 5) j, range(1, 5) k WHERE i.range < j.range AND j.range < k.range), p AS (SELECT * FROM (VALUES (1, 2), (1, 3), (1, 5), (2, 3), (2, 5), (2, 8), (3, 3), (3, 5)) x(min_votes, max_add)),
v AS (SELECT i, j, k, query_id, citation, count(*) AS votes FROM runs JOIN t ON variant IN (i, j, k) GROUP BY ALL), a AS {_run(0)}, n AS (SELECT i, j, k, min_votes, max_add, query_id, citation FROM v ANTI JOIN a USING (query_id, citation) JOIN p ON votes >= min_votes QUALIFY row_number() OVER (PARTITION BY i, j, k, min_votes, max_add, query_id ORDER BY citation) <= max_add),
s AS (SELECT i, j, k, min_votes, max_add, query_id, citation FROM a, t, p UNION ALL FROM n), c AS (SELECT i, j, k, min_votes, max_add, query_id, count(*) AS n, count(g.x) AS tp FROM s LEFT JOIN (SELECT *, 1 AS x FROM gold) g USING (query_id, citation) GROUP BY ALL),
per AS (SELECT i, j, k, min_votes, max_add, CASE WHEN coalesce(n, 0) + coalesce(n_gold, 0) = 0 THEN 1 ELSE round(2 * coalesce(tp, 0) / (coalesce(n, 0) + coalesce(n_gold, 0)), 6) END::DOUBLE AS f1 FROM queries CROSS JOIN t CROSS JOIN p LEFT JOIN c USING (i, j, k, min_votes, max_add, query_id) LEFT JOIN (SELECT query_id, count(*) AS n_gold FROM gold GROUP BY ALL) USING (query_id))
SELECT i::INT AS i, j::INT AS j, k::INT AS k, min_votes, max_add, round(avg(f1), 8) AS f1 FROM per GROUP BY ALL""")
def perturb_triple_scores(spark, sf_dir):
    return extra.triple_scores(base.runs(spark, sf_dir).where("variant > 0"), base.run(spark, sf_dir, 0), base.gold(spark, sf_dir), base.queries(spark, sf_dir), [1, 2, 3, 4], extra.PERTURB)


@register(f"{_J}, b AS {_run(2)}, n AS (SELECT query_id, citation FROM (FROM judged ANTI JOIN b USING (query_id, citation)) WHERE kind = 'court' AND court_dense_rank <= 60 AND judge_label <> 'reject' QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY court_dense_rank, citation) <= 2) FROM b UNION ALL FROM n")
def dense_injection(spark, sf_dir):
    ok = (F.col("kind") == "court") & (F.col("court_dense_rank") <= 60) & (F.col("judge_label") != "reject")
    return ensemble.add_only(base.run(spark, sf_dir, 2), judged(spark, sf_dir), ok, 2, [F.asc("court_dense_rank"), F.asc("citation")])


@register(f"{_C}, {RUNS}, b AS {_run(2)}, n AS (SELECT query_id, citation FROM (FROM candidates ANTI JOIN b USING (query_id, citation)) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY final_score DESC, raw_score DESC, citation) <= 4) FROM b UNION ALL FROM n")
def additive_blend(spark, sf_dir):
    return ensemble.add_only(base.run(spark, sf_dir, 2), base.candidates(spark, sf_dir), F.lit(True), 4, [F.desc("final_score"), F.desc("raw_score"), F.asc("citation")])


_OFFERED = "offered AS (SELECT query_id, CASE WHEN event_id % 2 = 0 THEN regexp_replace(citation, ' Abs. [0-9]+', '') ELSE citation END AS citation, score AS confidence FROM hits), known AS (SELECT DISTINCT citation FROM hits WHERE event_id % 5 > 0)"


def _offered(spark, sf_dir):
    short = F.when(F.col("event_id") % 2 == 0, F.regexp_replace("citation", " Abs. [0-9]+", "")).otherwise(F.col("citation"))
    return base.hits(spark, sf_dir).select("query_id", short.alias("citation"), F.col("score").alias("confidence"))


@register(f"{_R}, {_OFFERED} SELECT query_id, citation FROM runs WHERE variant = 3 UNION SELECT query_id, citation FROM offered WHERE citation LIKE 'Art.%'")
def topic_injection(spark, sf_dir):
    return extra.inject_topics(base.run(spark, sf_dir, 3), _offered(spark, sf_dir))


@register(f"""{_R}, {_OFFERED}, good AS (SELECT DISTINCT query_id, citation FROM offered WHERE confidence >= 0.7 AND NOT contains(citation, 'BGG')), k AS (SELECT concat(split_part(citation, ' ', 1), ' ', split_part(citation, ' ', 2), ' ', split_part(citation, ' ', -1)) AS base, count(*) AS n, min(citation) AS one, min(citation) FILTER (contains(citation, 'Abs. 1')) AS first FROM known WHERE citation LIKE 'Art.%' GROUP BY ALL)
SELECT query_id, citation FROM runs WHERE variant = 3 UNION SELECT query_id, citation FROM good SEMI JOIN known USING (citation) UNION
SELECT query_id, CASE WHEN n = 1 THEN one ELSE first END FROM (FROM good ANTI JOIN known USING (citation)) g JOIN k ON k.base = g.citation WHERE n = 1 OR first IS NOT NULL""")
def verified_injection(spark, sf_dir):
    known = base.hits(spark, sf_dir).where("event_id % 5 > 0").select("citation")
    return extra.inject_verified(base.run(spark, sf_dir, 3), _offered(spark, sf_dir), known)


# Rollups.


@register(f"""{_R}, m AS (SELECT v.range AS variant, query_id, 100 * v.range + query_id AS tokens_in, 10 + query_id AS tokens_out, query_id / 8 AS seconds, 1 + v.range AS price_in, 2.5::DOUBLE AS price_out FROM range(5) v, queries), k AS (SELECT DISTINCT citation, 1 AS k FROM hits WHERE score < 0.5), s AS (SELECT query_id, count(*) AS n_gold FROM gold GROUP BY ALL),
a AS (SELECT variant, query_id, count(*) AS n, count(g.x) AS tp, count(k.k) AS h FROM runs LEFT JOIN (SELECT *, 1 AS x FROM gold) g USING (query_id, citation) LEFT JOIN k USING (citation) GROUP BY ALL), r AS (SELECT m.*, coalesce(n, 0) AS n, coalesce(tp, 0) AS tp, coalesce(h, 0) AS h, coalesce(n_gold, 0) AS ng FROM m LEFT JOIN a USING (variant, query_id) LEFT JOIN s USING (query_id))
SELECT variant, round(avg(CASE WHEN n = 0 AND ng = 0 THEN 1 WHEN n = 0 OR ng = 0 THEN 0 ELSE round(2 * tp / (n + ng), 6) END), 4) AS f1, round(avg(CASE WHEN n = 0 AND ng = 0 THEN 1 WHEN n = 0 OR ng = 0 THEN 0 ELSE round(tp / n, 6) END), 4) AS precision, round(avg(CASE WHEN n = 0 AND ng = 0 THEN 1 WHEN n = 0 OR ng = 0 THEN 0 ELSE round(tp / ng, 6) END), 4) AS recall,
 round(avg(n), 4) AS avg_n, round(sum(h) / greatest(sum(n), 1), 4) AS hit_rate, sum(tokens_in)::BIGINT AS tokens_in, sum(tokens_out)::BIGINT AS tokens_out, round(sum(tokens_in * price_in + tokens_out * price_out) / 1e6, 6) AS cost, round(sum(seconds), 4) AS seconds FROM r GROUP BY ALL""")
def model_summary(spark, sf_dir):
    runs = base.queries(spark, sf_dir).crossJoin(F.broadcast(spark.range(5).withColumnRenamed("id", "variant")))  # five models
    runs = runs.selectExpr("variant", "query_id", "100 * variant + query_id AS tokens_in", "10 + query_id AS tokens_out", "query_id / 8 AS seconds", "1 + variant AS price_in", "2.5D AS price_out")
    known = base.hits(spark, sf_dir).where("score < 0.5")
    return extra.model_summary(base.runs(spark, sf_dir), base.gold(spark, sf_dir), known, runs, "variant")


_PROC = " OR ".join(f"contains(citation, '{m}')" for m in metrics.PROCEDURE)


@register(f"{_R} SELECT CASE WHEN citation LIKE 'Art.%' THEN split_part(citation, ' ', -1) ELSE '' END AS code, CASE WHEN citation NOT LIKE 'Art.%' THEN 'court' WHEN {_PROC} THEN 'procedural' ELSE 'substantive' END AS kind, count(*) AS n FROM gold GROUP BY ALL")
def statute_histogram(spark, sf_dir):
    return metrics.statute_histogram(base.gold(spark, sf_dir))


@register(f"{_J}, s AS (SELECT query_id, citation, 1 AS s FROM runs WHERE variant = 1), g AS (SELECT *, 1 AS g FROM gold) SELECT judge_label, count(*) AS n, count(s.s) AS chosen, count(*) FILTER (s.s = 1 AND g.g = 1) AS \"right\" FROM judged LEFT JOIN s USING (query_id, citation) LEFT JOIN g USING (query_id, citation) GROUP BY ALL")
def label_distribution(spark, sf_dir):
    return extra.label_distribution(judged(spark, sf_dir), base.run(spark, sf_dir, 1), base.gold(spark, sf_dir))


@register(f"{_J}, s AS (SELECT query_id, citation, judge_label, round(greatest(raw_score, final_score, coalesce(1.0::DOUBLE / (1 + bm25_rank), 0), coalesce(1.0::DOUBLE / (1 + dense_rank), 0)), 6) AS signal FROM judged) SELECT query_id, citation, signal, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN judge_label = 'must_include' THEN 0 ELSE 1 END, signal DESC, citation) AS rank FROM s QUALIFY judge_label = 'must_include' OR rank <= 30")
def must_and_signal_pool(spark, sf_dir):
    return extra.signal_pool(judged(spark, sf_dir), 30).select("query_id", "citation", "signal", "rank")
