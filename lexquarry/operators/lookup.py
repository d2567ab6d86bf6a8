"""Lookups by citation, tools over an index, and the gathering of several retrieval agents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexquarry.functions import text as fn
from lexquarry.operators import substrings


def containing(corpus: DataFrame, asked: DataFrame, most: int = 100) -> DataFrame:
    """(asked, citation, n): the first citations, in corpus order, that hold each text asked for.

    corpus has (citation, pos).
    """
    return _first(substrings.holding(corpus.select("citation", "pos"), "citation", asked, "asked"), most)


def starting(corpus: DataFrame, asked: DataFrame, most: int | None = None) -> DataFrame:
    """(asked, citation, n): the citations that begin with each decision asked for; a shorter number matches longer ones too."""
    base = asked.select("asked", fn.court_base(F.col("asked")).alias("base")).distinct()
    return _first(substrings.beginning(corpus.select("citation", "pos"), "citation", base, "base"), most)


def _first(hit: DataFrame, most: int | None) -> DataFrame:
    rows = hit.withColumn("n", F.row_number().over(Window.partitionBy("asked").orderBy("pos", "citation")))
    return (rows if most is None else rows.where(F.col("n") <= most)).select("asked", "citation", "n")


def of_statute(corpus: DataFrame, asked: DataFrame, most: int = 30, width: int = 150) -> DataFrame:
    """(code, citation, text, n): the first articles of each statute, in corpus order, with the beginning of their text."""
    rows = corpus.withColumn("code", fn.statute_token(F.col("citation"))).where(fn.is_law(F.col("citation"))).join(asked.select("code").distinct(), "code", "left_semi")
    rows = rows.withColumn("n", F.row_number().over(Window.partitionBy("code").orderBy("pos", "citation"))).where(F.col("n") <= most)
    return rows.select("code", "citation", F.substring("text", 1, width).alias("text"), "n")


def searched(ranked: DataFrame, texts: DataFrame, most: int = 15, width: int = 300) -> DataFrame:
    """The tool's answer: the best hits that score at all, with the beginning of their text."""
    return ranked.where((F.col("rank") <= most) & (F.col("score") > 0)).join(texts.select("doc_id", F.substring("text", 1, width).alias("text")), "doc_id").select("query_id", "rank", "doc_id", "text")


def gathered(hits: DataFrame, listed: DataFrame, corpus: DataFrame, prefix_score: float = 0.5, parents: int = 20, siblings: int = 10, share: float = 0.5) -> DataFrame:
    """(query_id, agent, citation, score): what all agents found.

    hits has (query_id, agent, citation, score) of the agents statute, caselaw and
    explicit; listed has (query_id, citation) of a statute's articles.  They and
    the siblings of the best decisions come in where their agent hasn't found them.
    """
    best = hits.groupBy("query_id", "agent", "citation").agg(F.max("score").alias("score"))
    has = best.select("query_id", "agent", "citation")
    more = listed.select("query_id", F.lit("statute").alias("agent"), "citation", F.lit(prefix_score).alias("score")).distinct()
    more = more.join(has, ["query_id", "agent", "citation"], "left_anti")
    top = best.where("agent = 'caselaw'").withColumn("n", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "citation"))).where(F.col("n") <= parents)
    case = top.withColumn("base", fn.court_base(F.col("citation"))).groupBy("query_id", "base").agg(F.max("score").alias("score"))
    named = corpus.select("citation").distinct().withColumn("base", fn.court_base(F.col("citation")))
    named = named.withColumn("n", F.row_number().over(Window.partitionBy("base").orderBy("citation"))).where(F.col("n") <= siblings)
    kin = case.join(named, "base").select("query_id", F.lit("caselaw").alias("agent"), "citation", (F.col("score") * share).alias("score"))
    return best.unionByName(more).unionByName(kin.join(has, ["query_id", "agent", "citation"], "left_anti"))


def consolidated(found: DataFrame, scale: float = 20.0, two: float = 1.5, three: float = 1.3) -> DataFrame:
    """(query_id, citation, score, agents): explicit ones count 1, others a share of `scale`; agreement lifts without a cap."""
    norm = F.when(F.col("agent") == "explicit", 1.0).otherwise(F.least(F.col("score") / scale, F.lit(1.0)))
    one = found.groupBy("query_id", "citation").agg(F.max(norm).alias("score"), F.count_distinct("agent").alias("agents"))
    lifted = F.col("score") * F.when(F.col("agents") >= 2, two).otherwise(1.0) * F.when(F.col("agents") >= 3, three).otherwise(1.0)
    return one.select("query_id", "citation", F.round(lifted, 6).alias("score"), "agents")


def explicit_references(queries: DataFrame, resolved: DataFrame, corpus: DataFrame, keep_unknown: bool = True) -> DataFrame:
    """(query_id, citation, score, source) of the statutes that a query names.

    resolved has (citation, match) for what the corpus lacks; what has no match stays as it is, or goes.
    """
    named = queries.select("query_id", F.explode(fn.explicit_citations(F.col("query"))).alias("named")).distinct()
    known = corpus.select(F.col("citation").alias("named")).distinct().withColumn("known", F.lit(True))
    rows = named.join(known, "named", "left").join(resolved.select(F.col("citation").alias("named"), "match"), "named", "left")
    fuzzy = F.col("known").isNull() & F.col("match").isNotNull()
    rows = rows.withColumns({"source": F.when(fuzzy, "explicit_fuzzy").otherwise("explicit"), "worth": F.when(fuzzy, 0.93).otherwise(0.95), "citation": F.when(fuzzy, F.col("match")).otherwise(F.col("named"))})
    rows = rows if keep_unknown else rows.where(F.col("known").isNotNull() | F.col("match").isNotNull())
    return rows.groupBy("query_id", "citation").agg(F.max("worth").alias("score"), F.max_by("source", "worth").alias("source"))


def answered(pending: DataFrame, cache: DataFrame) -> DataFrame:
    """pending(key, ...) with label and confidence of the cache; what it lacks is rejected and marked as a fallback.

    A fallback is no answer: `cacheable` leaves it out, so that it is asked again.
    """
    rows = pending.join(cache.select("key", "label", "confidence"), "key", "left")
    return rows.withColumns({"fallback": F.col("label").isNull(), "label": F.coalesce("label", F.lit("reject")), "confidence": F.coalesce("confidence", F.lit(0.0))})


def cacheable(answers: DataFrame) -> DataFrame:
    return answers.where(~F.col("fallback")).drop("fallback")


def salvaged(text: Column, field: str) -> Column:
    """The strings of a JSON array that may be cut off, or an empty array."""
    inside = F.regexp_extract(text, rf'"{field}"\s*:\s*\[([^\]]*)', 1)
    return F.regexp_extract_all(inside, F.lit('"([^"]+)"'), F.lit(1))
