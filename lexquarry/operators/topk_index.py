"""A BM25 index that grows by segments and answers top-k searches without reading all postings.

A segment's documents are cut into ranges of at most RANGE; a row of the index is a
block: the postings of one term in one range, with their number and their peak, the
largest part that term frequency and length take in a score there.  Rows lie in the order
of (term, range), so that a search for some terms opens few row groups, and what bounds a
block's scores is read without its postings.  The term DOCUMENT has a block for each range
with all of its documents.  Segments are batches of a committed table: a search sees whole
segments, an addition that was cut off adds nothing, and a merge takes the place of its
sources in one step, from their blocks alone.

A peak holds for the mean length that its segment was built with.  A greater mean length m'
instead of m raises no part by more than m' / m, a smaller one raises none; so peaks stay
bounds while the index grows.

A search gathers what bounds the scores of a range, the peaks of its blocks, as one row.  Tasks
multiply these rows by what the queries' terms weigh, so that nothing is shuffled for each
query, term and range:
1. Each query's k ranges with the greatest bounds (the sum of peak times weight) are found.
2. These ranges are scored.  The k-th of a query's scores is its threshold.
3. Ranges are listed with the queries whose threshold their bound reaches; others are skipped.
4. The blocks of listed ranges are gathered by range and scored for the listed queries; what is
   below the threshold stays in its task.
Queries go to the tasks in groups of about retrieval.ASKED weights.
Scores are rounded to six places before they are ranked, as the exhaustive search has it.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexquarry.operators import retrieval
from lexquarry.operators.retrieval import Bm25
from lexquarry.sources.committed import Committed
from lexquarry.sources.scratch import scratch

#: Stands for the documents themselves among the terms.
DOCUMENT = ""
#: Documents of a range; how much rounding may add to a score.
RANGE, SLACK = 32, 1e-6


@dataclass(frozen=True)
class Found:
    """ranking: (query_id, doc_id, score, rank); blocks: (query_id, blocks, read), the blocks of a query's terms and those that were read."""

    ranking: DataFrame
    blocks: DataFrame


class TopkIndex:
    def __init__(self, spark: SparkSession, path: str, cfg: Bm25 = Bm25()):
        if cfg.idf != "smooth":
            raise ValueError("bounds need weights that are not negative")
        self.spark, self.cfg, self.table = spark, cfg, Committed(spark, path)

    def add(self, corpus: DataFrame, name: str) -> int:
        """Adds the documents of corpus(doc_id, text) that the index lacks as a segment; returns how many.

        A document without an id is left out; of rows with one id, one is taken.
        """
        files, known = scratch(self.spark), self.table.read()
        rows = corpus.select("doc_id", "text").where("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
        if known is not None:
            rows = rows.join(known.where(F.col("term") == DOCUMENT).select(F.explode("posts.doc_id").alias("doc_id")), "doc_id", "left_anti")
        place = F.monotonically_increasing_id()
        in_partition = F.pmod(place, F.lit(1 << 33))
        counted = retrieval.counted(rows, cfg=self.cfg).withColumn("range", F.shiftright(place, 33) * (1 << 26) + (in_partition / RANGE).cast("long"))
        counted, (n, with_length, total) = files.counted(counted, "segment", F.count(F.lit(1)), F.count("dl"), F.sum("dl"))
        if n:
            own = counted.select("range", "doc_id", "dl", F.lit(DOCUMENT).alias("term"), F.lit(0).cast("long").alias("tf"))
            each = own.unionByName(retrieval.postings(counted)).repartitionByRange("term", "range")  # groups lie together then, and in the order of the segment
            posts = each.groupBy("term", "range").agg(F.array_sort(F.collect_list(F.struct("doc_id", F.col("tf"), F.col("dl")))).alias("posts"))
            self.table.append(self._blocks(posts, total, with_length), name, docs=n, lengths=with_length, total=total)
        files.drop(counted)
        return n

    def merge(self, names: list[str], name: str) -> None:
        """Makes one segment of several, from their blocks; ranges that are not half full are put together."""
        parts = [b for b in self.table.batches() if b["name"] in names]
        if len(parts) != len(set(names)):
            raise ValueError("no such segments")
        rows = self.table.read(only=lambda b: b["name"] in names)
        small = rows.where((F.col("term") == DOCUMENT) & (F.col("n") * 2 < RANGE)).agg(F.sum("n")).first()[0] or 0
        sparse = rows.where((F.col("term") == DOCUMENT) & (F.col("n") * 2 < RANGE)).select("batch", "range", F.lit(True).alias("sparse"))  # the last ranges of partitions
        groups = -(-small // RANGE)
        at = F.when(F.col("sparse"), -1 - F.pmod(F.xxhash64("batch", "range"), F.lit(max(1, groups)))).otherwise(F.col("range") * len(names) + F.array_position(F.array(*[F.lit(n) for n in names]), F.col("batch")) - 1)
        moved = rows.join(F.broadcast(sparse), ["batch", "range"], "left").withColumn("range", at)
        moved = moved.repartitionByRange("term", "range")
        posts = moved.groupBy("term", "range").agg(F.array_sort(F.flatten(F.collect_list("posts"))).alias("posts"))
        facts = {k: sum(b[k] for b in parts) for k in ("docs", "lengths", "total")}
        self.table.append(self._blocks(posts, facts["total"], facts["lengths"]), name, instead_of=names, **facts)

    def search(self, queries: DataFrame, k: int) -> Found:
        """The k best documents of each query, as retrieval.search and top_k have them."""
        files, cfg = scratch(self.spark), self.cfg
        rows, segments = self.table.read(), self.table.batches()
        terms = retrieval.query_terms(queries, cfg)
        if rows is None:
            none = terms.limit(0)
            return Found(none.selectExpr("query_id", "0L AS doc_id", "0D AS score", "0 AS rank"), none.selectExpr("query_id", "0L AS blocks", "0L AS read"))
        listed = [r["term"] for r in terms.select("term").distinct().limit(retrieval.LISTED + 1).collect()]
        asked = terms.select("term").distinct()
        mine = rows.where(F.col("term").isin(listed)) if len(listed) <= retrieval.LISTED else rows.join(asked, "term", "left_semi")
        n, lengths, total = (sum(b[x] or 0 for b in segments) for x in ("docs", "lengths", "total"))
        mean = total / lengths if lengths else None
        raised = F.create_map(*[x for b in segments for x in (F.lit(b["name"]), F.lit(max(1.0, mean * b["lengths"] / b["total"]) if b["total"] else 1.0))])
        bounds = files.keep(mine.select("term", "batch", "range", "n", (F.col("peak") * raised[F.col("batch")]).alias("peak")), "bounds")
        stats = self.spark.createDataFrame([(n, mean)], "n long, avgdl double")
        df = bounds.groupBy("term").agg(F.sum("n").alias("df"))
        weighed = files.keep(retrieval.weights(df, stats, terms, cfg), "weights")
        peaks = files.keep(bounds.groupBy("batch", "range").agg(F.collect_list(F.struct("term", "peak")).alias("peaks")), "peaks")
        groups = max(1, -(-weighed.count() // retrieval.ASKED))
        found = [self._found(files, mine, peaks, weighed.where(F.pmod(F.xxhash64("query_id"), F.lit(groups)) == i), k) for i in range(groups)]
        ranking, blocks = found[0]
        for r, b in found[1:]:
            ranking, blocks = ranking.unionByName(r), blocks.unionByName(b)
        return Found(ranking, blocks)

    def _found(self, files, mine: DataFrame, peaks: DataFrame, weighed: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
        """Ranking and blocks of some queries."""
        asked = weighed.select("query_id", "term", F.struct(F.lit(0)).alias("scope"), "avgdl", "w")
        sent, id = self.spark.sparkContext.broadcast(asked.toArrow()), asked.schema["query_id"].dataType.simpleString()
        retrieval.one_by_one(self.spark)
        where = ["batch", "range"]

        # 1. and 2.: what sets the thresholds
        best = peaks.mapInArrow(_highest(sent, k), f"query_id {id}, batch string, range long, bound double, size long")
        best = files.keep(retrieval.top_k(best, k, "bound", "range"), "best")
        some = best.groupBy(*where).agg(F.collect_list("query_id").alias("asks"))
        kth = retrieval.top_k(self._scored(mine, some, sent, id), k).where(F.col("rank") == k).select("query_id", F.col("score").alias("least"))
        kth = files.keep(kth, "least")  # a row for each query
        least = kth.toArrow().to_pydict()
        least = self.spark.sparkContext.broadcast(dict(zip(least["query_id"], least["least"])))

        # 3. and 4.: ranges that may hold what reaches them
        listed = files.keep(peaks.mapInArrow(_reaching(sent, least), f"batch string, range long, asks array<{id}>, sizes array<long>"), "listed")
        ranking = retrieval.top_k(self._scored(mine, listed, sent, id, least), k)
        ids = weighed.select("query_id", "term").join(peaks.select(F.explode("peaks.term").alias("term")).groupBy("term").count(), "term")
        blocks = ids.groupBy("query_id").agg(F.sum("count").alias("blocks"))
        once = best.join(kth, "query_id", "left").where(F.col("bound") + SLACK < F.col("least")).select("query_id", "size")
        read = listed.select(F.inline(F.arrays_zip("asks", "sizes"))).toDF("query_id", "size").unionByName(once)
        return ranking, blocks.join(read.groupBy("query_id").agg(F.sum("size").alias("read")), "query_id")

    def _scored(self, rows: DataFrame, listed: DataFrame, sent, id: str, least=None) -> DataFrame:
        """(query_id, doc_id, score) of the documents of listed(batch, range, asks), at least as good as `least`."""
        own = rows.select("batch", "range", "term", "posts").join(listed.select("batch", "range"), ["batch", "range"], "left_semi")
        own = own.groupBy("batch", "range").agg(F.collect_list(F.struct("term", "posts")).alias("blocks")).join(listed.select("batch", "range", "asks"), ["batch", "range"])
        doc = own.schema["blocks"].dataType.elementType["posts"].dataType.elementType["doc_id"].dataType.simpleString()
        return own.select("blocks", "asks").mapInArrow(_scorer(sent, least, self.cfg), f"query_id {id}, doc_id {doc}, score double")

    def _blocks(self, posts: DataFrame, total: int | None, lengths: int) -> DataFrame:
        """The rows of a segment of so many words in so many texts, in the order of their terms."""
        part = lambda p: retrieval.tf_norm(p["tf"], p["dl"], self.cfg)
        mean = posts.withColumn("avgdl", F.lit(total / lengths if lengths and total else None).cast("double"))
        rows = mean.select("term", "range", F.size("posts").cast("long").alias("n"), F.coalesce(F.array_max(F.transform("posts", part)), F.lit(0.0)).alias("peak"), "posts")
        return rows.sortWithinPartitions("term", "range")


def _bounds(batches, parts: list[tuple]):
    """(rows, place of each range in its batch, ids, bounds, blocks): ranges by queries, a bounded number at once."""
    for batch in batches:
        lists = batch.column("peaks")
        size, flat = lists.value_lengths().to_numpy(), lists.flatten()
        row, peak = np.repeat(np.arange(len(batch)), size), flat.field("peak").to_numpy(zero_copy_only=False)
        words = flat.field("term").dictionary_encode()
        for _, _, ids, place, w, _ in parts:
            column = np.array([place.get(x, -1) for x in words.dictionary.to_pylist()] or [-1], np.int64)[words.indices.to_numpy()]
            step = max(1, retrieval.CELLS // max(w.shape))
            for first in range(0, len(batch), step):
                own = (row >= first) & (row < first + step) & (column >= 0)
                held = np.zeros((min(step, len(batch) - first), len(place)))
                held[row[own] - first, column[own]] = 1
                sizes = held @ (w > 0)
                held[row[own] - first, column[own]] = peak[own]
                yield batch, first, ids, held @ w, sizes.astype(np.int64)


def _highest(sent, k: int):
    def run(batches):
        least = {}
        for batch, first, ids, bound, size in _bounds(batches, retrieval._weight_blocks(sent.value, False)):
            at, known = ids[0].as_py(), np.where(size > 0, bound, -np.inf)
            if len(known) >= k:
                least[at] = np.maximum(least.get(at, -np.inf), np.partition(known, -k, axis=0)[-k])
            i, j = np.nonzero((size > 0) & (known >= least.get(at, -np.inf)))
            rows = pa.array(first + i)
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(j)), batch.column("batch").take(rows), batch.column("range").take(rows), pa.array(bound[i, j]), pa.array(size[i, j])], names=["query_id", "batch", "range", "bound", "size"])

    return run


def _reaching(sent, least):
    def run(batches):
        for batch, first, ids, bound, size in _bounds(batches, retrieval._weight_blocks(sent.value, False)):
            must = np.array([least.value.get(x, -np.inf) for x in ids.to_pylist()])
            i, j = np.nonzero((size > 0) & (bound + SLACK >= must))
            rows, count = np.unique(i, return_counts=True)
            ends, at = pa.array(np.append(0, np.cumsum(count)), pa.int32()), pa.array(first + rows)
            yield pa.RecordBatch.from_arrays([batch.column("batch").take(at), batch.column("range").take(at), pa.ListArray.from_arrays(ends, ids.take(pa.array(j))), pa.ListArray.from_arrays(ends, pa.array(size[i, j]))], names=["batch", "range", "asks", "sizes"])

    return run


def _scorer(sent, least, cfg: Bm25):
    def run(batches):
        parts = [(avgdl, ids, {x: n for n, x in enumerate(ids.to_pylist())}, place, w) for _, avgdl, ids, place, w, _ in retrieval._weight_blocks(sent.value, False)]
        for batch in batches:
            for blocks, asks in zip(batch.column("blocks"), batch.column("asks")):
                posts, asks = blocks.values.field("posts"), asks.as_py()
                term, flat = np.repeat(np.arange(len(posts)), posts.value_lengths().to_numpy()), posts.flatten()
                words, docs = blocks.values.field("term").to_pylist(), flat.field("doc_id").dictionary_encode()
                codes, docs = docs.indices.to_numpy(), docs.dictionary
                tf, dl = (flat.field(x).to_numpy(zero_copy_only=False).astype(np.float64) for x in ("tf", "dl"))
                for avgdl, ids, number, place, w in parts:
                    mine = np.array([number[x] for x in asks if x in number], np.int64)
                    if not len(mine):
                        continue
                    column = np.array([place.get(x, -1) for x in words], np.int64)[term]
                    own = column >= 0
                    held = np.zeros((len(docs), len(place)))
                    held[codes[own], column[own]] = (tf * (cfg.k1 + 1) / (tf + cfg.k1 * (1 - cfg.b + cfg.b * dl / avgdl)))[own]
                    score = held @ w[:, mine]
                    kept = np.round(score, 6)
                    must = np.array([least.value.get(ids[int(x)].as_py(), -np.inf) for x in mine]) if least else -np.inf
                    i, j = np.nonzero((score > 0) & (kept >= must))
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(mine[j])), docs.take(pa.array(i)), pa.array(kept[i, j])], names=["query_id", "doc_id", "score"])

    return run
