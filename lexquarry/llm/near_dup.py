"""Near-duplicate components by bottom-k sketches of one hash function.

1. A text's set is its distinct five-word shingles, as 64-bit hashes; a text of
   fewer words has its whole sequence as the one shingle, a text without words
   the empty set.  The sketch is the K smallest hashes.
2. Texts with equal sets are one node, named by its smallest doc_id.
3. Inverted lists of the retained values generate candidate pairs.
   * A list of at most LIST nodes gives all pairs of nodes for which its value is one
     that an alike sketch must meet (half of a sketch, rarest values first) and whose
     sets have sizes that can be alike.
   * A pair that meets in longer lists only has many of them in common.  The nodes
     that have enough of them are few, and get inverted lists of their full sets:
     of each set only the part that an alike set must meet (a quarter, rarest
     values first).  Short ones of these lists give all pairs.  In a long one each
     node is compared with one pivot first; what then lies in another component
     than most of its list is compared with the whole list, block by block, and
     only links that join components are kept.
4. The union sketch of a pair (the K smallest of both) estimates its similarity.
   A pair stays if at least LOW of the union sketch is in both.  For a pair at
   the threshold 0.75 the share has a standard deviation of 0.054, so that about
   two of a million such pairs are lost; sets of up to K shingles lose none.  With
   low=0 no pair is lost: every node gets the lists of its full set, and no
   estimate drops a pair.
5. The full sets of the pairs that stay decide, by exact intersection: first each
   node's best pair, then the pairs that would join different components.

Copies of a text, nodes of many pairs and values of many nodes are dealt to several
tasks (`components.spread`), and a long list is compared block by block, a pair of
blocks in a task.  Texts without words take part in no join.

Ties and repeated rows share a component.  A null or empty text is linked with
nothing and is its own component; a null doc_id takes the component of the rows
with an equal set, which is null if none of them has a doc_id.  A set that only
rows without a doc_id have can't be named and links nothing.  A very long text is one
set, in memory in proportion to its words.  An empty table gives an empty result.
Only the two named columns are read; any others have no effect.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexquarry.llm.arrow import chunks, gather, release, released, small_batches
from lexquarry.llm.components import components, spread, with_count
from lexquarry.sources.scratch import Scratch, scratch

#: Values in a sketch; share of a union sketch that a candidate must have in common.
K, LOW = 64, 0.5
#: Nodes of an inverted list whose pairs are all generated; values of the sets, and nodes, of a block of a longer list.
LIST, BLOCK, NODES = 48, 40_000, 1000
#: Bytes of text that are cut into shingles at once.
SLICE = 3 << 20
#: Bits of the map of wanted ids.
BITS = 1 << 25
#: Words of a shingle, and the similarity in hundredths that links two texts.
WORDS, ALIKE = 5, 75


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sets(column: pa.Array, words: int = WORDS) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    c = chunks(column, lower="all", blank=True)
    parts = [w.split() for w in c.words]
    count = np.fromiter(map(len, parts), np.int64, len(parts))
    known: dict[bytes, int] = {}
    flat = np.array([known[w] if w in known else known.setdefault(w, xxhash.xxh3_64_intdigest(w)) for p in parts for w in p], np.uint64)
    h = flat[gather(np.cumsum(count) - count, count, c.codes)]
    ends = np.concatenate([[0], np.cumsum(c.per_text(count))])
    step = np.uint64(0x9E3779B97F4A7C15)
    rolled = h[: max(0, len(h) - words + 1)].copy()
    for i in range(1, words):
        rolled = rolled * step + h[i : len(h) - words + 1 + i]
    rolled = _mix(rolled).view(np.int64)
    out = []
    for a, b in zip(ends[:-1].tolist(), ends[1:].tolist()):
        if b - a >= words:
            out.append(np.unique(rolled[a : b - words + 1]))
        elif b > a:
            x = np.uint64(b - a)
            for w in h[a:b]:
                x = x * step + w
            out.append(_mix(np.array([x ^ np.uint64(0x5851F42D4C957F2D)], np.uint64)).view(np.int64))
        else:
            out.append(np.zeros(0, np.int64))
    return out


def sketches(df: DataFrame, k: int = K) -> DataFrame:
    """(doc_id, n, d1, d2, sketch) of (doc_id, text): set size, digest of the set, bottom-k."""

    def run(batches):
        for part in released(batches, 1, SLICE):
            with np.errstate(over="ignore"):
                sets = shingle_sets(part.column(1))
            sums = [xxhash.xxh3_128_digest(s) for s in sets]
            d = np.frombuffer(b"".join(sums), np.int64).reshape(-1, 2)
            sizes = np.array([len(s) for s in sets], np.int64)
            ends = np.concatenate([[0], np.cumsum(np.minimum(sizes, k))]).astype(np.int32)
            values = pa.array(np.concatenate([s[:k] for s in sets]) if sets else np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes), pa.array(d[:, 0]), pa.array(d[:, 1]), pa.ListArray.from_arrays(pa.array(ends), values)], names=["doc_id", "n", "d1", "d2", "sketch"])

    small_batches(df.sparkSession)
    return df.mapInArrow(run, "doc_id long, n long, d1 long, d2 long, sketch array<long>")


def bitmap(ids: DataFrame) -> np.ndarray:
    """A bit for each hash of an id, BITS in all, however many ids there are."""
    bit = F.pmod(F.xxhash64("id"), F.lit(BITS))
    words = ids.select(bit.alias("bit")).groupBy(F.shiftright("bit", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(bit % 64 AS INT))")).alias("bits")).toArrow()
    out = np.zeros(BITS // 64, np.int64)
    out[words["word"].to_numpy()] = words["bits"].to_numpy()
    return np.unpackbits(out.view(np.uint8), bitorder="little").view(bool)


def full_sets(df: DataFrame, wanted: DataFrame) -> DataFrame:
    """(id, set) of (id, text), a set being an array in ascending order, for the wanted ids and a few others.

    A bitmap of fixed size tells the ids apart, so that no text is shuffled to
    find the wanted ones; the more ids, the more others pass, which costs time only.
    """
    bits = df.sparkSession.sparkContext.broadcast(np.packbits(bitmap(wanted)))

    def run(batches):
        mask = np.unpackbits(bits.value).view(bool)
        for part in released((b.filter(pa.array(mask[b.column(2).to_numpy()])) for b in batches), 1, SLICE):
            with np.errstate(over="ignore"):
                sets = shingle_sets(part.column(1))
            ends = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
            values = pa.array(np.concatenate(sets) if sets else np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(ends), values)], names=["id", "set"])

    hashed = df.where("id IS NOT NULL").select("id", "text", F.pmod(F.xxhash64("id"), F.lit(BITS)).alias("bit"))
    return hashed.mapInArrow(run, "id long, set array<long>")


def with_node(files: Scratch, pairs: DataFrame, total: int, nodes: DataFrame, side: str, columns: dict[str, str]) -> DataFrame:
    """`total` pairs(a, b, ...) with columns of the node on one side."""
    counts = pairs.groupBy(side).agg(F.count("*").alias("k"))
    one = nodes.select(F.col("id").alias(side), *[F.col(c).alias(n) for c, n in columns.items()])
    return spread(files, pairs, one, side, ["b" if side == "a" else "a"], counts, total)


def estimated(files: Scratch, pairs: DataFrame, nodes: DataFrame, low: float, hubs: bool) -> DataFrame:
    """(a, b, share) of the pairs (a, b) whose union sketch passes, written; without hubs no node has more than K * LIST pairs."""
    if hubs:
        pairs, (n,) = files.counted(pairs.select("a", "b"), "pairs", F.count(F.lit(1)))
        both = with_node(files, with_node(files, pairs, n, nodes, "a", {"n": "na", "sketch": "sa"}), n, nodes, "b", {"n": "nb", "sketch": "sb"})
    else:
        a, b = (nodes.select(F.col("id").alias(x), F.col("n").alias(f"n{x}"), F.col("sketch").alias(f"s{x}")) for x in ("a", "b"))
        both = pairs.join(a, "a").join(b, "b")
    both = both.where(f"100 * least(na, nb) >= {ALIKE} * greatest(na, nb)").withColumn("joint", F.expr(f"slice(array_sort(array_union(sa, sb)), 1, {K})"))
    share = F.expr("size(array_intersect(joint, array_intersect(sa, sb))) / size(joint)")
    out = files.keep(both.select("a", "b", share.alias("share")).where(F.col("share") >= low), "likely")
    if hubs:
        files.drop(pairs)
    return out


def confirmed(files: Scratch, pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose full sets are alike enough, written."""

    def run(batches):
        for batch in batches:
            a, b, keep = batch.column(2), batch.column(3), []
            for x, y in zip(a, b):
                x, y = x.values.to_numpy(), y.values.to_numpy()
                common = int(np.isin(x, y, assume_unique=True).sum()) if len(x) and len(y) else 0
                keep.append(100 * common >= ALIKE * (len(x) + len(y) - common) and common > 0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    pairs, (n,) = files.counted(pairs.select("a", "b"), "pairs", F.count(F.lit(1)))
    joined = with_node(files, with_node(files, pairs, n, sets, "a", {"set": "sa"}), n, sets, "b", {"set": "sb"})
    out = files.keep(joined.select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long"), "links")
    files.drop(pairs)
    return out


def all_pairs(lists: DataFrame) -> DataFrame:
    """(a, b) with a < b of each array `nodes` of (id, n), once for each array, if sets of their sizes can be alike enough."""
    fit = f"b.id > a.id AND 100 * least(a.n, b.n) >= {ALIKE} * greatest(a.n, b.n)"
    pairs = F.expr(f"flatten(transform(nodes, a -> transform(filter(nodes, b -> {fit}), b -> struct(a.id AS a, b.id AS b))))")
    return lists.select(F.explode(pairs).alias("p")).select("p.a", "p.b")


def met(values: DataFrame, low: float) -> DataFrame:
    """(id, n, h, meet): how many of a node's values are in long lists, and of the others those that an alike sketch must meet.

    Alike sketches have `low * least(K, n)` values in common at least.  With all values
    in one order, rarest first, the first one in common is followed by the rest of them in
    both sketches; behind it stand as many less one.  Values that no other node has come first.
    """
    ranked = values.groupBy("id", "n").agg(F.count_if(F.col("df") > LIST).alias("h"), F.sort_array(F.collect_list(F.struct("df", "value"))).alias("v"))
    first = F.expr(f"slice(v, 1, greatest(0, size(v) - greatest(1, CAST(ceil({low} * least({K}, n)) AS INT)) + 1))")
    return ranked.select("id", "n", "h", F.transform(F.filter(first, lambda x: x["df"] <= LIST), lambda x: x["value"]).alias("meet"))


def likely_pairs(info: DataFrame) -> DataFrame:
    """Pairs that meet in a short list of values that alike sketches must meet; if they are alike and don't, all they share is in long lists."""
    short = info.select(F.explode("meet").alias("value"), F.struct("id", "n").alias("node")).groupBy("value").agg(F.collect_list("node").alias("nodes"))
    return all_pairs(short.where(F.size("nodes") > 1)).distinct()


def listed(files: Scratch, own: DataFrame, total: int) -> DataFrame:
    """`total` rows own(value, id, ...) of values that several nodes have, with the number `df` of these nodes."""
    return with_count(files, own, "value", "df", total).where("df > 1")


def full_lists(files: Scratch, sets: DataFrame, hot: DataFrame) -> DataFrame:
    """(value, id, n, h): for the nodes in hot(id, h), the values that a set at the threshold must meet."""
    nodes, (total,) = files.counted(sets.join(hot, "id").select("id", F.size("set").alias("n"), "h", "set"), "hot-sets", F.sum("n"))
    often = listed(files, nodes.select("id", "n", "h", F.explode("set").alias("value")), total)
    ranked = often.groupBy("id", "n", "h").agg(F.sort_array(F.collect_list(F.struct("df", "value"))).alias("v"))
    meet = F.expr(f"n - CAST(ceil({ALIKE} * n / 100) AS INT) + 1 - (n - size(v))")  # values that no other node has come first
    out = files.keep(ranked.where(meet > 0).select("id", "n", "h", F.explode(F.slice("v", F.lit(1), meet)).alias("x")).select(F.col("x.value").alias("value"), "id", "n", "h"), "full-lists")
    files.drop(nodes)
    return out


def pivots(files: Scratch, lists: DataFrame, total: int) -> DataFrame:
    """Pairs of each node with the node of its list that has most long-list values; the lists have `total` rows."""
    rank = F.shiftleft(F.col("h").cast("long"), 40) + F.pmod(F.xxhash64("id"), F.lit(1 << 40))
    best = lists.groupBy("value").agg(F.max_by("id", rank).alias("pivot"), F.count("*").alias("k"))
    pairs = spread(files, lists, best.select("value", "pivot"), "value", ["id"], best, total)
    return pairs.where("id <> pivot").select(F.least("id", "pivot").alias("a"), F.greatest("id", "pivot").alias("b"))


def across(files: Scratch, lists: DataFrame, total: int, parts: DataFrame, sets: DataFrame) -> DataFrame:
    """Links between different components within a long list.

    Only nodes outside their list's largest component are compared, each block of
    them with each block of the list, a pair of blocks at a time; a list within one
    component costs a count.  Of a pair of blocks come links that join components,
    fewer than it has rows.
    """
    named = lists.join(parts, "id", "left").withColumn("component", F.coalesce("component", "id"))
    sizes = named.groupBy("value", "component").agg(F.count("*").alias("k"), F.sum("n").alias("size"))
    mass = sizes.groupBy("value").agg(F.max_by("component", F.shiftleft("k", 32) + F.pmod(F.xxhash64("component"), F.lit(1 << 31))).alias("most"), F.sum("size").alias("all"), F.count("*").alias("parts"), F.sum("k").alias("k")).where("parts > 1")
    count = F.greatest(F.ceil(F.col("all") / BLOCK), F.ceil(F.col("k") / NODES))
    mixed = spread(files, named, mass.select("value", "most", count.alias("count")), "value", ["id"], mass, total).join(sets, "id")

    def blocks(rows: DataFrame, name: str, *more: str) -> DataFrame:
        return rows.groupBy("value", F.pmod(F.xxhash64("id"), F.col("count")).alias(f"{name}_block"), *more).agg(F.collect_list(F.struct("id", "component", "set")).alias(name))

    mine = blocks(mixed.where("component <> most"), "mine", "count").withColumn("whole_block", F.explode(F.expr("sequence(0L, count - 1)")))
    return mine.join(blocks(mixed, "whole"), ["value", "whole_block"]).select("mine", "whole").mapInArrow(_compare, "a long, b long").distinct()


def _compare(batches):
    for batch in batches:
        for mine, whole in zip(batch.column(0), batch.column(1)):
            x, y = _block(mine.values), _block(whole.values)
            common = np.intersect1d(x[2], y[2])
            shared = np.zeros((len(x[0]), len(y[0])), np.float32)
            for at in range(0, len(common), 2048):
                part = common[at : at + 2048]
                shared += _incidence(x, part) @ _incidence(y, part).T
            alike = 100 * shared >= ALIKE * (x[3][:, None] + y[3][None, :] - shared)
            alike &= x[1][:, None] != y[1][None, :]
            i, j = np.nonzero(alike)
            (own, p), (other, q) = np.unique(x[1], return_inverse=True), np.unique(y[1], return_inverse=True)
            _, first = np.unique(p[i] * len(other) + q[j], return_index=True)  # one pair of two components
            links, root = [], {}

            def top(c):
                while root.get(c, c) != c:
                    c = root[c]
                return c

            for a, b, p, q in zip(x[0][i[first]].tolist(), y[0][j[first]].tolist(), x[1][i[first]].tolist(), y[1][j[first]].tolist()):
                if (p := top(p)) != (q := top(q)):
                    root[max(p, q)] = min(p, q)
                    links.append((min(a, b), max(a, b)))
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in links], pa.int64()), pa.array([k[1] for k in links], pa.int64())], names=["a", "b"])
            release()


def _block(rows: pa.StructArray):
    """Ids, components, all values, and set sizes of the rows of a block."""
    cols = dict(zip([f.name for f in rows.type], rows.flatten()))
    return [cols[c].to_numpy(zero_copy_only=False) for c in ("id", "component")] + [cols["set"].flatten().to_numpy(), np.diff(cols["set"].offsets.to_numpy())]


def _incidence(block, common: np.ndarray) -> np.ndarray:
    out = np.zeros((len(block[0]), len(common)), np.float32)
    row, at = np.repeat(np.arange(len(block[0])), block[3]), np.minimum(np.searchsorted(common, block[2]), len(common) - 1)
    hit = common[at] == block[2]
    out[row[hit], at[hit]] = 1
    return out


def find(spark: SparkSession, df: DataFrame, low: float = LOW) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of df(doc_id, text)."""
    files: Scratch = scratch(spark)
    docs = df.select(F.col("doc_id").cast("long"), "text")
    rows, (total,) = files.counted(sketches(docs).withColumn("row", F.monotonically_increasing_id()), "sketches", F.count(F.lit(1)))
    classes = files.keep(rows.where("n > 0").groupBy("d1", "d2").agg(F.min("doc_id").alias("id"), F.min("row").alias("row"), F.count("*").alias("k")), "classes")
    nodes, (size,) = files.counted(rows.select("row", "n", "sketch").join(classes.where("id IS NOT NULL").select("row", "id"), "row").select("id", "n", "sketch"), "nodes", F.sum(F.size("sketch")))
    whole, rows = rows, files.keep(rows.drop("sketch"), "rows")
    files.drop(whole)

    values = files.keep(listed(files, nodes.select("id", F.col("n").cast("int").alias("n"), F.explode("sketch").alias("value")), size), "values")
    info = files.keep(met(values, low), "info")
    files.drop(values)
    hot = info.where(F.col("h") >= F.expr(f"{low} * least({K}, n)")).select("id", "h") if low else nodes.select("id", F.lit(0).cast("long").alias("h"))
    likely = estimated(files, likely_pairs(info), nodes, low, False)

    wanted = likely.select(F.explode(F.array("a", "b")).alias("id")).unionByName(hot.select("id")).distinct()
    sets = files.keep(full_sets(docs.select(F.col("doc_id").alias("id"), "text"), wanted), "sets")
    lists = full_lists(files, sets, hot)
    sizes = lists.groupBy("value").agg(F.count("*").alias("df")).where("df > 1")
    short = lists.join(sizes.where(F.col("df") <= LIST), "value").groupBy("value").agg(F.collect_list(F.struct("id", "n")).alias("nodes"))
    long, (length,) = files.counted(lists.join(sizes.where(F.col("df") > LIST).select("value"), "value"), "long-lists", F.count(F.lit(1)))
    central = files.keep(pivots(files, long, length).distinct(), "pivots")
    more = estimated(files, all_pairs(short).unionByName(central).distinct(), nodes, low, True)
    files.drop(lists, info, nodes)
    both = likely.unionByName(more)

    ends = both.select(F.col("a").alias("id"), F.col("b").alias("other"), "share").unionByName(both.select(F.col("b").alias("id"), F.col("a").alias("other"), "share"))
    rank = F.floor(F.col("share") * 1024).cast("long") * F.lit(1 << 40) + F.pmod(F.xxhash64("other"), F.lit(1 << 40))
    best = ends.groupBy("id").agg(F.max_by("other", rank).alias("other")).select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b"))
    best = best.unionByName(central.join(more, ["a", "b"], "left_semi")).distinct()
    first = confirmed(files, best, sets)
    parts = components(files, first, rounds=2)

    a, b = parts.select(F.col("id").alias("a"), F.col("component").alias("ca")), parts.select(F.col("id").alias("b"), F.col("component").alias("cb"))
    apart = both.join(a, "a", "left").join(b, "b", "left").where("coalesce(ca, a) <> coalesce(cb, b)").select("a", "b").distinct()
    second = confirmed(files, apart, sets)
    found = components(files, first.unionByName(second).unionByName(across(files, long, length, parts, sets)))
    files.drop(likely, more, central, sets, long, first, second, parts)

    named = classes.join(found, "id", "left").withColumn("component_id", F.coalesce("component", "id"))
    named = files.keep(named.where("k > 1 OR component_id <> id").select(_digest().alias("digest"), "component_id", "k"), "named")
    files.drop(classes, found)
    some = rows.where("n > 0").select("doc_id", "n", "row", _digest().alias("digest"))
    out = spread(files, some, named.select("digest", "component_id"), "digest", ["row"], named, total, "left")
    out = out.select("doc_id", "n", F.coalesce("component_id", "doc_id").alias("component_id")).unionByName(rows.where("n = 0").select("doc_id", "n", F.col("doc_id").alias("component_id")))
    return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def _digest():
    return F.struct("d1", "d2")


def one_of_each(spark: SparkSession, df: DataFrame) -> DataFrame:
    """df with one document of each component; all columns stay.

    Rows that repeat a doc_id count as one document, of which one row stays.  A
    row without a doc_id can't be named by a component and stays.

    Bitmaps of the ids that stay and of those that go, or are repeated, decide for all
    rows but the few that both maps may mean, so that no other text is shuffled.
    """
    files = scratch(spark)
    found = find(spark, df).where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("kept").alias("kept"), F.count("*").alias("k"))
    found = files.keep(found, "found")
    stay, go = (spark.sparkContext.broadcast(np.packbits(bitmap(found.where(x).select(F.col("doc_id").alias("id"))))) for x in ("kept", "k > 1 OR NOT kept"))

    @F.pandas_udf("int")
    def marks(bit: pd.Series) -> pd.Series:
        at = bit.to_numpy()
        has = lambda bits: (bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1
        return pd.Series(has(stay.value) + 2 * has(go.value)).astype("int32")

    mark = marks(F.pmod(F.xxhash64(F.col("doc_id").cast("long")), F.lit(BITS)))
    sure = df.where((mark == 1) | F.col("doc_id").isNull())
    unsure = df.where((mark == 3) & F.col("doc_id").isNotNull()).join(found.where("kept").select("doc_id"), "doc_id", "left_semi")
    return sure.unionByName(unsure.select(df.columns).dropDuplicates(["doc_id"]))
