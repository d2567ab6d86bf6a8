"""Keyword and vector retrieval.

BM25 is a relational plan over a written table of documents with the counts of their
terms, restricted to those of the queries where there are any; they are joined with
what each query term weighs and summed by (query, document).  Vectors meet queries in blocks,
by matrix products.  Scores are rounded before they are ranked and ties end in
the key, so that results don't hang on the order of summation.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexquarry.functions import text as fn
from lexquarry.sources.io import existing
from lexquarry.sources.scratch import scratch


@dataclass(frozen=True)
class Bm25:
    """idf: "smooth", the logarithm of one more than the odds, or "okapi", where a negative one is epsilon times their mean."""

    k1: float = 1.5
    b: float = 0.75
    longer_than: int = 1
    idf: str = "smooth"
    epsilon: float = 0.25


#: Distinct query terms, and (query, term) rows, up to which both are sent to every task.
LISTED, ASKED = 20_000, 200_000
#: Vectors, and query vectors, that are multiplied at once.
VECTORS, QUERIES = 2048, 512
#: Queries of a block of weights, which has a row for each of their terms.
ASKS = 128
#: Numbers of a matrix of documents or of queries that is in memory at once.
CELLS = 1 << 22
#: Bytes of an Arrow batch, by Spark's setting, and its default.
BATCH, DEFAULT = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"


def query_terms(queries: DataFrame, cfg: Bm25 = Bm25()) -> DataFrame:
    """(query_id, term, qtf); a term that a query repeats counts so many times."""
    return queries.select("query_id", F.explode(fn.tokenize(F.col("query"), cfg.longer_than)).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qtf"))


def counted(corpus: DataFrame, terms: DataFrame | None = None, cfg: Bm25 = Bm25(), scope: list[str] | None = None) -> DataFrame:
    """(doc_id, ...scope, dl, terms): a row for each document, with the counts of its terms, or of those that some query has.

    Everything is counted within the row, so nothing is shuffled.  Query terms are
    sent to the tasks if there are at most LISTED; beyond that all terms are counted,
    and the search leaves out the others.
    """
    listed = terms.select("term").distinct().limit(LISTED + 1).collect() if terms is not None else []
    tokens = corpus.select("doc_id", *(scope or []), fn.tokenize(F.col("text"), cfg.longer_than).alias("tokens"))
    own = F.col("tokens")
    if terms is not None and len(listed) <= LISTED:
        own = F.filter(own, lambda t: t.isin([r["term"] for r in listed]))
    own = F.array_sort(F.coalesce(own, F.array().cast("array<string>")))
    starts = lambda t: F.filter(F.transform(t, lambda x, i: F.when((i == 0) | (x != F.get(t, i - 1)), i)), lambda i: i.isNotNull())
    count = lambda t, at: F.transform(at, lambda p, j: F.struct(F.get(t, p).alias("term"), (F.coalesce(F.get(at, j + 1), F.size(t)) - p).cast("long").alias("tf")))
    terms = fn.let(own, lambda t: fn.let(starts(t), lambda at: count(t, at)))
    return tokens.select("doc_id", *(scope or []), F.size("tokens").alias("dl"), terms.alias("terms"))


def postings(counts: DataFrame) -> DataFrame:
    """(doc_id, ...scope, dl, term, tf) of counted()."""
    return counts.select(*[c for c in counts.columns if c != "terms"], F.inline("terms"))


def index(corpus: DataFrame, terms: DataFrame | None = None, cfg: Bm25 = Bm25(), scope: list[str] | None = None, path: str | None = None) -> DataFrame:
    """counted() as a written table, so that texts are read and cut into tokens once.  With a path it is kept there, for read_index."""
    return scratch(corpus.sparkSession).keep(counted(corpus, terms, cfg, scope), "index", to=path)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def weights(df: DataFrame, stats: DataFrame, terms: DataFrame, cfg: Bm25 = Bm25(), scope: list[str] | None = None) -> DataFrame:
    """(query_id, term, ...scope, avgdl, w): idf times the query's count, from df(term, ...scope, df) and stats(...scope, n, avgdl)."""
    scope = scope or []
    known = df.join(F.broadcast(stats), scope) if scope else df.crossJoin(F.broadcast(stats))  # a row for each part
    rest = F.col("n") - F.col("df") + 0.5
    if cfg.idf == "okapi":
        known = known.withColumn("idf", F.log(rest) - F.log(F.col("df") + 0.5))
        mean = known.groupBy(*scope).agg(F.avg("idf").alias("mean"))
        known = known.join(F.broadcast(mean), scope) if scope else known.crossJoin(F.broadcast(mean))
        known = known.withColumn("idf", F.when(F.col("idf") < 0, cfg.epsilon * F.col("mean")).otherwise(F.col("idf")))
    else:
        known = known.withColumn("idf", F.log(rest / (F.col("df") + 0.5) + 1))
    return terms.join(known, "term").select("query_id", "term", *scope, "avgdl", (F.col("idf") * F.col("qtf")).alias("w"))


def tf_norm(tf: Column, dl: Column, cfg: Bm25) -> Column:
    return tf * (cfg.k1 + 1) / (tf + cfg.k1 * (1 - cfg.b + cfg.b * dl / F.col("avgdl")))


def asked_weights(index: DataFrame, queries: DataFrame, cfg: Bm25 = Bm25(), scope: list[str] | None = None) -> DataFrame:
    """weights() of the queries' terms by what an index counts, written."""
    scope, terms = scope or [], query_terms(queries, cfg)
    stats = index.groupBy(*scope).agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))
    post = postings(index)
    own = post if cfg.idf == "okapi" else post.join(terms.select("term").distinct(), "term", "left_semi")
    df = own.groupBy("term", *scope).agg(F.count("*").alias("df"))
    return scratch(index.sparkSession).keep(weights(df, stats, terms, cfg, scope), "weights")


def search(index: DataFrame, queries: DataFrame, cfg: Bm25 = Bm25(), scope: list[str] | None = None, k: int | None = None) -> DataFrame:
    """(query_id, doc_id, score) of every pair with a term in common, from an index.

    With `scope`, document frequency, count and mean length are those of each part
    of the corpus, as separately built indexes would have them.  What the queries'
    terms weigh goes to every task, if it has at most ASKED rows.

    With k, of the pairs of each query only those that may be among its k best: a task
    multiplies its documents' terms by the weights and leaves out what k documents
    surpass, so that what is shuffled doesn't grow with documents times queries.  If
    some rows share a doc_id, whose scores add up, all pairs are returned.
    """
    scope = scope or []
    asked, post = asked_weights(index, queries, cfg, scope), postings(index)
    few = asked.count() <= ASKED
    if k is not None and few and index.groupBy("doc_id").count().where("count > 1").isEmpty():
        return _best(index, asked, cfg, scope, k)
    if few:
        asked = F.broadcast(asked)
    return post.join(asked, ["term", *scope]).groupBy("query_id", "doc_id").agg(F.round(F.sum(F.col("w") * tf_norm(F.col("tf"), F.col("dl"), cfg)), 6).alias("score"))


def _best(index: DataFrame, asked: DataFrame, cfg: Bm25, scope: list[str], k: int) -> DataFrame:
    rows = asked.select("query_id", "term", F.struct(F.lit(0), *scope).alias("scope"), "avgdl", "w").toArrow()
    types = {t.name: t.dataType.simpleString() for t in (asked.schema["query_id"], index.schema["doc_id"])}
    sent = index.sparkSession.sparkContext.broadcast(rows)

    def run(batches):
        parts, least = None, {}
        for batch in batches:
            parts = parts or _weight_blocks(sent.value, cfg.idf == "okapi")
            lists = batch.column(1)
            size = np.nan_to_num(lists.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
            flat = lists.flatten()
            term, tf = flat.field("term"), flat.field("tf").to_numpy(zero_copy_only=False).astype(np.float64)
            words = term.dictionary_encode()
            codes, words = words.indices.to_numpy(), words.dictionary.to_pylist()
            row, length = np.repeat(np.arange(len(batch)), size), np.repeat(batch.column(2).to_numpy(zero_copy_only=False).astype(np.float64), size)
            part = batch.column(3).to_pylist() if scope else []
            for at, (key, avgdl, asks, place, w, has) in enumerate(parts):
                mine = np.fromiter((tuple(x.values()) == key for x in part), bool, len(part)) if scope else np.ones(len(batch), bool)
                column = np.array([place.get(x, -1) for x in words] or [-1], np.int64)[codes] if len(codes) else np.zeros(0, np.int64)
                own = np.flatnonzero(mine[row] & (column >= 0))
                value = tf[own] * (cfg.k1 + 1) / (tf[own] + cfg.k1 * (1 - cfg.b + cfg.b * length[own] / avgdl))
                docs, local = np.unique(row[own], return_inverse=True)
                step = max(1, CELLS // max(w.shape))
                for first in range(0, len(docs), step):
                    some = (local >= first) & (local < first + step)
                    found = np.zeros((min(step, len(docs) - first), len(place)))
                    found[local[some] - first, column[own[some]]] = value[some]
                    met = found @ w
                    common = (found != 0) @ has > 0 if cfg.idf == "okapi" else met > 0  # smooth weights are above zero
                    score = np.where(common, np.round(met, 6), -np.inf)
                    bound = least.get(at, -np.inf)
                    if len(score) >= k:
                        bound = least[at] = np.maximum(bound, np.partition(score, -k, axis=0)[-k])
                    i, j = np.nonzero(common & (score >= bound))
                    yield pa.RecordBatch.from_arrays([asks.take(pa.array(j)), batch.column(0).take(pa.array(docs[first + i])), pa.array(score[i, j])], names=["query_id", "doc_id", "score"])

    one_by_one(index.sparkSession)
    own = index.select("doc_id", "terms", "dl", F.struct(F.lit(0), *scope).alias("scope")).where(F.size("terms") > 0)
    return own.mapInArrow(run, f"query_id {types['query_id']}, doc_id {types['doc_id']}, score double")


def _weight_blocks(rows: pa.Table, signed: bool) -> list[tuple]:
    """(scope, avgdl, query ids, column of each term, weights, and with signs which are given) of blocks of at most ASKS queries of one part of the corpus."""
    out, keys = [], [tuple(x.values()) for x in rows.column("scope").to_pylist()]
    ids = rows.column("query_id").combine_chunks().dictionary_encode()
    query, w = ids.indices.to_numpy(), rows.column("w").to_numpy()
    for key in dict.fromkeys(keys):
        here = np.array([x == key for x in keys])
        for at in range(0, len(ids.dictionary), ASKS):
            own = np.flatnonzero(here & (query >= at) & (query < at + ASKS))
            if len(own):
                term = rows.column("term").take(pa.array(own)).combine_chunks().dictionary_encode()
                block = np.full((len(term.dictionary), min(ASKS, len(ids.dictionary) - at)), np.nan)
                block[term.indices.to_numpy(), query[own] - at] = w[own]
                out.append((key, rows.column("avgdl")[int(own[0])].as_py(), ids.dictionary.slice(at, block.shape[1]), {x: i for i, x in enumerate(term.dictionary.to_pylist())}, np.nan_to_num(block), ~np.isnan(block) if signed else None))
    return out


def bm25(corpus: DataFrame, queries: DataFrame, cfg: Bm25 = Bm25(), scope: list[str] | None = None, k: int | None = None) -> DataFrame:
    """(query_id, doc_id, score) of every pair with a term in common, or of those that may be among each query's k best, from an index of the queries' terms.

    The library formula needs the mean idf of all terms, so its index has them all.
    """
    terms = None if cfg.idf == "okapi" else query_terms(queries, cfg)
    return search(index(corpus, terms, cfg, scope), queries, cfg, scope, k)


def top_k(scored: DataFrame, k: int, by: str = "score", key: str = "doc_id", group: str = "query_id") -> DataFrame:
    """The k best of each group with `rank`; a window limit is pushed below the shuffle by the optimizer."""
    w = Window.partitionBy(group).orderBy(F.desc(by), F.asc(key))
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def merge_queries(ranked: DataFrame, group: str = "query_id", key: str = "doc_id") -> DataFrame:
    """Of several sub-queries: the largest score and the best rank of each key."""
    return ranked.where("score > 0").groupBy(group, key).agg(F.max("score").alias("score"), F.min("rank").alias("rank"))


def max_normalized(scored: DataFrame, weight: float = 1.0, group: str = "query_id") -> DataFrame:
    return scored.withColumn("norm", F.col("score") / F.max("score").over(Window.partitionBy(group)) * weight)


def neighbour_votes(ranked: DataFrame, corpus: DataFrame, mined: Column, k: int = 100) -> DataFrame:
    """One vote of each retrieved document for each citation it holds; the k best of each query."""
    cites = corpus.join(ranked.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", F.explode(mined).alias("citation")).distinct()
    votes = ranked.join(cites, "doc_id").groupBy("query_id", "citation").agg(F.count("*").alias("votes"))
    return top_k(votes, k, "votes", "citation")


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def normalized(v: Column) -> Column:
    """A vector of length one; a zero vector stays."""
    norm = F.sqrt(dot(v, v))
    return F.transform(v, lambda x: x.cast("double") / F.when(norm == 0, 1.0).otherwise(norm))


def packed(vectors: DataFrame, key: str, rows: int) -> DataFrame:
    """(ids, dims, data): blocks of (key, embedding) as matrices in double precision; rows without a vector are left out.

    A task's vectors of one length go into blocks of at most so many.
    """

    def run(batches):
        for batch in batches:
            size = batch.column(1).value_lengths().to_numpy()
            for dims in np.unique(size):
                part = batch.filter(pa.array(size == dims))
                for at in range(0, len(part), rows):
                    block = part.slice(at, rows)
                    data = block.column(1).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
                    yield pa.RecordBatch.from_pydict({"ids": pa.array([block.column(0).to_numpy()], pa.list_(pa.int64())), "dims": pa.array([dims], pa.int32()), "data": pa.array([data.tobytes()], pa.binary())})

    known = vectors.select(F.col(key).cast("long"), "embedding").where(f"{key} IS NOT NULL AND embedding IS NOT NULL AND NOT exists(embedding, x -> x IS NULL)")
    return known.mapInArrow(run, "ids array<long>, dims int, data binary")


def one_by_one(spark: SparkSession) -> None:
    """Bounds the bytes of an Arrow batch, so that a task holds a few blocks at once, not as many as a batch has rows; a session's own setting stays."""
    if spark.conf.get(BATCH, DEFAULT) == DEFAULT:
        spark.conf.set(BATCH, "4m")


def dense_top_k(queries: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """(query_id, key, score, rank) by inner product: every query against every vector."""
    return dense_blocks(packed(queries, "query_id", QUERIES), packed(vectors, "key", VECTORS), k)


def dense_blocks(queries: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """dense_top_k of packed blocks: each block of queries meets each block of vectors in one matrix product.

    A product leaves the k best of each query and their ties; these are ranked by
    score and key.  Vectors meet queries of their own length only.
    """
    one_by_one(queries.sparkSession)
    own = queries.select(F.col("ids").alias("asked"), F.col("dims").alias("wide"), F.col("data").alias("q"))
    pairs = vectors.select("ids", "dims", "data").crossJoin(own)  # blocks of a stated query set against blocks of all rows

    def run(batches):
        for batch in batches:
            for ids, dims, data, asked, wide, q in zip(*batch.columns):
                ids, asked, dims = ids.values.to_numpy(), asked.values.to_numpy(), dims.as_py()
                if dims != wide.as_py():
                    continue
                score = np.frombuffer(q.as_buffer(), np.float64).reshape(-1, dims) @ np.frombuffer(data.as_buffer(), np.float64).reshape(-1, dims).T
                score = np.round(score, 6)
                least = np.partition(score, -k, axis=1)[:, -k] if score.shape[1] > k else np.full(len(score), -np.inf)
                i, j = np.nonzero(score >= least[:, None])
                yield pa.RecordBatch.from_pydict({"query_id": asked[i], "key": ids[j], "score": score[i, j]})

    return top_k(pairs.mapInArrow(run, "query_id long, key long, score double"), k, "score", "key")


def add_vectors(vectors: DataFrame, path: str) -> int:
    """Adds (key, embedding) whose keys the blocks at `path` lack; returns how many.  Each added key counts once."""
    spark = vectors.sparkSession
    rows = vectors.where("key IS NOT NULL AND embedding IS NOT NULL").dropDuplicates(["key"])
    if existing(spark, [path]):
        rows = rows.join(read_index(spark, path).select(F.explode("ids").alias("key")), "key", "left_anti")
    rows = scratch(spark).keep(rows, "vectors")
    n = rows.count()
    if n:
        packed(rows, "key", VECTORS).write.mode("append").parquet(path)
    scratch(spark).drop(rows)
    return n


def rank_step(rank: Column, steps: list[tuple[int, float]], otherwise: float) -> Column:
    """The value of the first step whose bound the rank doesn't exceed."""
    out = F.lit(otherwise)
    for bound, value in reversed(steps):
        out = F.when(rank <= bound, value).otherwise(out)
    return out


def sub_queries(queries: DataFrame, named: str, terms: str, first: int = 8, words: int = 20) -> DataFrame:
    """(query_id, sub_id, query): the first named sub-queries that aren't blank, or else the first terms joined."""
    listed = F.filter(F.slice(F.coalesce(F.col(named), F.array().cast("array<string>")), 1, first), lambda q: F.trim(q) != "")
    joined = F.array_join(F.slice(F.coalesce(F.col(terms), F.array().cast("array<string>")), 1, words), " ")
    return queries.select("query_id", F.posexplode(F.when(F.size(listed) > 0, listed).when(joined != "", F.array(joined)).otherwise(F.array().cast("array<string>"))).alias("sub_id", "query"))
