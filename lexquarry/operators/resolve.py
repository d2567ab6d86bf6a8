"""Resolution of citations that a corpus doesn't hold as written, deduplication and lookups."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexquarry.functions import text as fn
from lexquarry.operators import substrings
from lexquarry.operators.fusion import siblings


@F.pandas_udf(T.DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Similarity of two strings by longest matching blocks; no built-in function has these values."""
    return pd.Series([None if x is None or y is None else difflib.SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b)], dtype="float64")


def ratio_bound(a: Column, b: Column) -> Column:
    """What sequence_ratio cannot exceed: the letters that both have, as often as both have them, are all that blocks can match."""
    letters = F.array_distinct(F.filter(F.split(a, ""), lambda c: c != ""))
    times = lambda x, c: F.length(x) - F.length(F.replace(x, c, F.lit("")))
    common = F.aggregate(letters, F.lit(0), lambda s, c: s + F.least(times(a, c), times(b, c)))
    total = F.length(a) + F.length(b)
    return F.when(total == 0, 1.0).otherwise(2.0 * common / F.greatest(F.lit(1), total))


def likely_matches(pairs: DataFrame, least: float) -> DataFrame:
    """The pairs (citation, match) whose ratio may be `least` or more; the others are never compared block by block."""
    return pairs.where(ratio_bound(F.col("citation"), F.col("match")) >= least - 1e-9)


def law_candidates(wanted: DataFrame, corpus: DataFrame) -> DataFrame:
    """(citation, match, n): for what the corpus lacks, its citations of the same statute and article, and how many."""
    key = lambda df, name: df.select("citation", fn.law_key(F.col("citation")).alias("key")).where("key IS NOT NULL").select(F.col("citation").alias(name), "key.statute", "key.article").distinct()
    missing = wanted.select("citation").distinct().join(corpus.select("citation"), "citation", "left_anti")
    pairs = key(missing, "citation").join(key(corpus, "match"), ["statute", "article"])
    return pairs.withColumn("n", F.count("*").over(Window.partitionBy("citation"))).select("citation", "match", "n")


def resolve_laws(wanted: DataFrame, corpus: DataFrame, least: float = 0.75) -> DataFrame:
    """(citation, match): itself if the corpus has it, an only candidate as it is, or the most similar from `least` on."""
    own = wanted.select("citation").distinct().join(corpus.select("citation"), "citation", "left_semi").withColumn("match", F.col("citation"))
    pairs = law_candidates(wanted, corpus)
    single = pairs.where("n = 1").select("citation", "match")
    rated = likely_matches(pairs.where("n > 1"), least).withColumn("ratio", sequence_ratio("citation", "match"))
    w = Window.partitionBy("citation").orderBy(F.desc("ratio"), F.asc("match"))
    several = rated.where(F.col("ratio") >= least).withColumn("r", F.row_number().over(w)).where("r = 1").select("citation", "match")
    return own.unionByName(single).unionByName(several)


def resolve_courts(wanted: DataFrame, corpus: DataFrame, most: int = 8) -> DataFrame:
    """(citation, match): itself if the corpus has it, or else the first considerations of its decision."""
    asked = wanted.select("citation").distinct()
    own = asked.join(corpus.select("citation"), "citation", "left_semi").withColumn("match", F.col("citation"))
    missing = asked.join(corpus.select("citation"), "citation", "left_anti").withColumn("base", fn.court_base(F.col("citation")))
    near = missing.join(siblings(corpus, most).withColumnRenamed("citation", "match"), "base").select("citation", "match")
    return own.unionByName(near)


def keep_longest(rows: DataFrame, key: str, text: str, pos: str, limit: int = 500) -> DataFrame:
    """The longest text of each key, cut first; the earliest of equally long ones."""
    w = Window.partitionBy(key).orderBy(F.desc(F.length(F.substring(text, 1, limit))), F.asc(pos))
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").select(key, F.substring(text, 1, limit).alias(text), pos)


def keep_first(rows: DataFrame, key: str, pos: str) -> DataFrame:
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(pos))).where("_n = 1").drop("_n")


def keep_last(rows: DataFrame, key: str, value: str, pos: str) -> DataFrame:
    return rows.groupBy(key).agg(F.max_by(value, pos).alias(value))


def concat_parts(rows: DataFrame, key: str, text: str, pos: str, cap: int = 1500) -> DataFrame:
    """All texts of a key in order, joined by spaces, cut at `cap` with an ellipsis.

    Of each key only the parts that can reach into the cap are gathered: the first
    cap + 1, since each but the first takes a character at least, and of these
    those that begin within it.
    """
    w = Window.partitionBy(key).orderBy(pos).rowsBetween(Window.unboundedPreceding, -1)
    first = rows.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(pos))).where(F.col("_n") <= cap + 2).drop("_n")
    reach = first.withColumn("_before", F.coalesce(F.sum(F.length(text) + 1).over(w), F.lit(0))).where(F.col("_before") <= cap + 1)
    joined = reach.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(pos).alias("p"), F.col(text).alias("t")))), lambda x: x["t"]), " ").alias(text))
    return joined.withColumn(text, fn.truncate(F.col(text), cap))


def translate(queries: DataFrame, glossary: DataFrame) -> DataFrame:
    """(query_id, terms): the German terms whose English form a query holds, longest first, or the query itself."""
    own = queries.select("query_id", "query").withColumn("_text", F.lower("query"))
    known = glossary.select("en", "de", F.lower("en").alias("_en"))
    held = substrings.holding(own.select("_text").distinct(), "_text", known, "_en").join(known, "_en").select("_text", "en", "de")
    hit = own.join(held, "_text", "left")
    terms = F.transform(F.array_sort(F.collect_list(F.when(F.col("de").isNotNull(), F.struct((-F.length("en")).alias("n"), "en", "de")))), lambda x: x["de"])
    return hit.groupBy("query_id", "query").agg(terms.alias("t")).select("query_id", F.when(F.size("t") > 0, F.array_join("t", " ")).otherwise(F.col("query")).alias("terms"))


def lookup(asked: DataFrame, texts: DataFrame) -> DataFrame:
    """Texts of the citations asked for, NOT FOUND where there is none."""
    return asked.join(texts, "citation", "left").withColumn("text", F.coalesce(F.when(F.col("text") != "", F.col("text")), F.lit("NOT FOUND")))


def snippets(candidates: DataFrame, texts: DataFrame) -> DataFrame:
    """candidates with `snippet`: the text, or the citation where there is none."""
    return candidates.join(texts.select("citation", "text"), "citation", "left").withColumn("snippet", F.coalesce(F.when(F.col("text") != "", F.col("text")), F.col("citation"))).drop("text")
