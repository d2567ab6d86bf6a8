"""Phrase collocations by the suffix method: one sort, one stack, joins of parts.

1. A text is lower-cased (A-Z), cut into pieces at `. , ; : ! ?` and line breaks, and
   pieces into words at spaces and tabs.  Every word of a piece starts a suffix of at
   most MAX_N words.  A task counts the equal suffixes of a slice of texts first.
2. The suffixes are dealt out by language and first word and sorted in reverse
   lexicographical order, language first, so that all suffixes with a common beginning
   lie together, longer ones first.
3. A task reads its sorted suffixes once.  The open prefixes of the last suffix are a
   stack; what a suffix has in common with the one before says how many of them it
   closes, and a closed prefix has its whole count.  The stack outlives a batch, so
   memory doesn't depend on how many suffixes a partition has.
4. A first word with more than 1/HEAVY of all words, and a pair of first words with as
   many, would be one task's work: its suffixes are dealt out by the next word as
   well.  There are fewer than 2 * HEAVY such beginnings of either kind; their counts come
   in parts, which are added up.
5. Phrases are joined with the counts of their two parts at each cut.

Keys are `language NUL word NUL word NUL ...`; a NUL within a word is escaped.

A null text is empty, a null language is `und`.  Repeated rows and doc_ids count as
often as they stand there.  An empty table gives an empty result.  Of equal phrases
none occurs twice; ties of score and count are in the byte order of the phrase.  A very
long text is a slice of its own, in memory in proportion to its words.  Only the two
named columns are read; any others have no effect.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexquarry.llm.arrow import distinct, hold, joined, plain, release, small_batches
from lexquarry.sources.scratch import scratch

#: Words of a phrase; its least count; phrases of each language that are returned.
MIN_N, MAX_N, LEAST, TOP = 2, 3, 10, 2000
#: A phrase goes if a longer one that holds it has at least so many hundredths of its count.
WITHIN = 50
#: A beginning with more than this share of all words is dealt out further; bytes of text counted at once; rows of a batch; words of a sorted partition.
HEAVY, SLICE, ROWS, PARTITION = 10_000, 12 << 20, 1 << 18, 4_000_000

_APART, _BREAKS = b" \t.,;:!?\n\x0b\x0c\r", b".,;:!?\n\x0b\x0c\r"
_LOWER = bytes(range(256)).lower()
_KIND = bytes((b in _APART) + (b in _BREAKS) for b in range(256))  # 0 in a word, 1 between words, 2 between pieces
_K = np.uint64(0x9E3779B97F4A7C15)


def _escape(word: bytes) -> bytes:
    return word.replace(b"\x01", b"\x01\x02").replace(b"\0", b"\x01\x01") if b"\x01" in word or b"\0" in word else word


def piece_words(column: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The distinct words; the number of each word of all texts from 1, 0 where a piece ends; the text of each (of an end, any)."""
    data, offsets = plain(column)
    if not len(data):
        return pa.array([], pa.large_binary()), np.zeros(0, np.int64), np.zeros(0, np.int64)
    raw = data.tobytes()
    kind = np.frombuffer(raw.translate(_KIND), np.uint8)
    inside, held = kind == 0, np.diff(offsets) > 0
    start, end = inside.copy(), inside.copy()
    np.greater(inside[1:], inside[:-1], out=start[1:])
    np.greater(inside[:-1], inside[1:], out=end[:-1])
    first, last = offsets[:-1][held], offsets[1:][held] - 1
    start[first], end[last] = inside[first], inside[last]
    starts = np.flatnonzero(start)
    bounds = np.append(0, np.cumsum(np.flatnonzero(end) + 1 - starts))
    words = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(raw.translate(_LOWER, _APART))]).dictionary_encode()
    codes, known = words.indices.to_numpy().astype(np.int64) + 1, words.dictionary
    if int(data.min()) < 2:
        known = pa.array([_escape(w) for w in known.to_pylist()], pa.large_binary())
    cut = np.zeros(len(starts) + 1, bool)  # the words before which a piece ends
    cut[np.searchsorted(starts, np.flatnonzero(kind == 2))] = True
    cut[np.searchsorted(starts, first)] = True
    new = np.flatnonzero(cut[1:-1]) + 1
    texts = np.repeat(np.arange(len(offsets) - 1), np.diff(np.searchsorted(starts, offsets)))
    return known, np.append(np.insert(codes, new, 0), 0), np.append(np.insert(texts, new, texts[new]), 0)


def distinct_rows(columns: list[np.ndarray], spans: list[int]) -> tuple[list[np.ndarray], np.ndarray]:
    """The distinct rows, in order, and how often each stands there; the numbers of a column are from 0 and below its span."""
    bits = [int(s).bit_length() for s in spans]
    if sum(bits) > 63:
        order, starts, _ = distinct(columns)
        return [c[order[starts]] for c in columns], np.diff(np.append(starts, len(order)))
    key = np.zeros(len(columns[0]), np.int64)  # one number tells the rows apart
    for c, n in zip(columns, bits):
        key <<= n
        key |= c
    key.sort()
    starts = _changes([key])
    n, key, rows = np.diff(np.append(starts, len(key))), key[starts], []
    for b in bits[:0:-1]:
        rows.append(key & ((1 << b) - 1))
        key = key >> b
    return [key, *rows[::-1]], n


def _changes(columns: list[np.ndarray]) -> np.ndarray:
    """Where a row differs from the one before; the first does."""
    new = np.zeros(len(columns[0]), bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def slice_suffixes(texts: pa.Array, langs: pa.Array, length: int) -> tuple[pa.Array, pa.Array, list[np.ndarray], np.ndarray]:
    """Languages and words with a NUL behind each, the distinct suffixes (language and `length` word numbers from 1, 0 beyond a piece's end, the empty word) and their counts, in order."""
    words, codes, text = piece_words(texts)
    coded = pc.cast(langs, pa.large_binary()).fill_null(b"und").dictionary_encode()
    columns = [coded.indices.to_numpy().astype(np.int64)[text], codes]
    for k in range(1, length):
        after = np.append(codes[k:], np.zeros(min(k, len(codes)), np.int64))
        columns.append(after if k == 1 else np.where(columns[-1] > 0, after, 0))
    keep = codes > 0
    rows, n = distinct_rows([c[keep] for c in columns], [len(coded.dictionary), *[len(words) + 1] * length])
    nul, none = pa.scalar(b"\0", pa.large_binary()), pa.scalar(b"", pa.large_binary())
    names = pa.array([_escape(x) + b"\0" for x in coded.dictionary.to_pylist()], pa.large_binary())
    return names, pa.concat_arrays([pa.array([b""], pa.large_binary()), pc.binary_join_element_wise(words, nul, none)]), rows, n


def heavy_beginnings(docs: DataFrame, share: int = HEAVY) -> tuple[int, list[tuple[str, int]]]:
    """The number of words, and the prefixes (key, words) of one and two words with more than a share-th of them.

    A task names what has more than half that share of a slice, so that nothing
    above one and a half times the share can be missed and a slice gives at most
    4 * share rows.
    """

    def run(batches):
        hold()
        for part in joined(batches, 0, SLICE):
            langs, words, rows, n = slice_suffixes(part.column(0), part.column(1), 2)
            total, keys, depth, counts = int(n.sum()), [None], [0], [int(n.sum())]
            for length in (1, 2) if total else ():
                at = _changes(rows[: length + 1])
                sums = np.add.reduceat(n, at)
                often = np.flatnonzero((sums * 2 * share > total) & (rows[length][at] > 0))
                keys += prefix_keys(langs, words, [r[at[often]] for r in rows[: length + 1]]).to_pylist()
                depth += [length] * len(often)
                counts += sums[often].tolist()
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(depth, pa.int32()), pa.array(counts, pa.int64())], names=["key", "depth", "n"])
        release()

    small_batches(docs.sparkSession)
    found = docs.mapInArrow(run, "key string, depth int, n long").groupBy("key", "depth").agg(F.sum("n").alias("n"))
    found = scratch(docs.sparkSession).keep(found, "beginnings")
    total = (found.where("depth = 0").agg(F.sum("n")).first()[0]) or 0
    return total, [(r["key"], r["depth"]) for r in found.where((F.col("depth") > 0) & (F.col("n") * share > total)).select("key", "depth").collect()]


def prefix_keys(langs: pa.Array, words: pa.Array, rows: list[np.ndarray]) -> pa.Array:
    """The key of each row (language, words ...)."""
    named = [known.take(pa.array(r)) for known, r in zip([langs] + [words] * len(rows), rows)]
    return pc.binary_join_element_wise(*named, pa.scalar(b"", pa.large_binary())).cast(pa.large_string()).cast(pa.string())


def _heavy(langs: pa.Array, words: pa.Array, heavy: list[list[bytes]]):
    """A function that says which rows (language, words ...) begin with one of these prefixes, all of as many words."""
    names = pa.array(sorted({w for _, *parts in heavy for w in parts}), pa.large_binary())
    place = pc.index_in(words, names).fill_null(-1).to_numpy() + 1  # 0: in no prefix
    numbers = {x: i for i, x in enumerate(langs.to_pylist())}, {x: i for i, x in enumerate(names.to_pylist(), 1)}
    n = len(names) + 1

    def number(parts):
        out = parts[0]
        for p in parts[1:]:
            out = out * n + p
        return out

    wanted = np.array(sorted(number([numbers[0][lang], *[numbers[1][w] for w in parts]]) for lang, *parts in heavy if lang in numbers[0]), np.int64)

    def among(rows: list[np.ndarray]) -> np.ndarray:
        mine = [rows[0], *[place[r] for r in rows[1:]]]
        out = mine[1] > 0
        for m in mine[2:]:
            out &= m > 0
        at = np.flatnonzero(out)
        mine = number([m[at] for m in mine])
        out[at] = wanted[np.minimum(np.searchsorted(wanted, mine), len(wanted) - 1)] == mine if len(wanted) else False
        return out

    return among


def suffixes(docs: DataFrame, length: int, heavy: list[tuple[str, int]]) -> DataFrame:
    """(key, n, part): the suffixes of at most `length` words, counted by slice, and where they go."""
    groups = [(depth, [[x + b"\0" for x in k.encode().split(b"\0")[:-1]] for k, d in heavy if d == depth]) for depth in (1, 2)]

    def run(batches):
        hold()
        for batch in joined(batches, 0, SLICE):
            langs, words, rows, n = slice_suffixes(batch.column(0), batch.column(1), length)
            hashes = [np.fromiter(map(xxhash.xxh3_64_intdigest, v), np.uint64, len(v)) for v in (x.to_numpy(zero_copy_only=False) for x in (langs, words))]
            heavies = [(depth, _heavy(langs, words, group)) for depth, group in groups if group and length > depth]
            for at in range(0, len(n), ROWS):
                some = [r[at : at + ROWS] for r in rows]
                with np.errstate(over="ignore"):
                    h = hashes[0][some[0]] * _K + hashes[1][some[1]]
                    for depth, among in heavies:
                        hot = among(some[: depth + 1])
                        h[hot] = h[hot] * _K + hashes[1][some[depth + 1][hot]]
                    h = (h ^ (h >> np.uint64(29))) * _K
                yield pa.RecordBatch.from_arrays([prefix_keys(langs, words, some), pa.array(n[at : at + ROWS]), pa.array((h >> np.uint64(33)).astype(np.int32))], names=["key", "n", "part"])
        release()

    small_batches(docs.sparkSession)
    return docs.mapInArrow(run, "key string, n long, part int")


class Stack:
    """The prefixes of the last suffix that may still grow, from the language down, and what is closed of them."""

    def __init__(self, depths: int, least: int, partial: frozenset[bytes]):
        self.last, self.open, self.depths, self.least, self.partial = b"", [0] * (depths + 1), depths, least, partial

    def read(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, n: np.ndarray) -> list[tuple[bytes, int, int]]:
        """Takes suffixes in reverse order; gives (key, words, count) of prefixes that closed and count."""
        last, self.last = self.last, data[starts[-1] : ends[-1]].tobytes()
        marks = np.flatnonzero(data == 0)
        first = np.searchsorted(marks, starts)
        count = np.searchsorted(marks, ends) - first
        # the parts of all keys, each with the NUL behind it, as numbers
        bounds = np.append(0, marks + 1).astype(np.int32)
        parts = pa.Array.from_buffers(pa.binary(), len(marks), [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(data))]).dictionary_encode().indices.to_numpy()
        shared = np.zeros(len(starts), np.int64)  # parts in common with the suffix before
        alike = np.ones(len(starts), bool)
        alike[0] = False
        for depth in range(self.depths):
            alike[1:] &= (count[1:] > depth) & (count[:-1] > depth)
            at = np.flatnonzero(alike)
            alike[at] = parts[first[at] + depth] == parts[first[at - 1] + depth]
            shared[alike] = depth + 1
        own, before = data[starts[0] : ends[0]].tobytes().split(b"\0")[:-1], last.split(b"\0")[:-1]
        shared[0] = next((i for i, (x, y) in enumerate(zip(own, before)) if x != y), min(len(own), len(before)))
        out = []
        for depth in range(1, self.depths + 1):
            rows = np.flatnonzero(count >= depth)
            if not len(rows):
                out += self.close(depth, last)
                continue
            size = marks[first[rows] + depth - 1] + 1 - starts[rows]
            new = shared[rows] < depth
            if rows[0] and not new[0]:
                raise ValueError("suffixes are not in order")
            if new[0]:
                out += self.close(depth, last)
            at = np.flatnonzero(new) if new[0] else np.append(0, np.flatnonzero(new))
            sums = np.add.reduceat(n[rows], at)
            sums[0] += self.open[depth]
            self.open[depth] = int(sums[-1])
            key = lambda i: data[starts[rows[i]] : starts[rows[i]] + size[i]].tobytes()
            closed = np.arange(len(at) - 1)
            wanted = closed if depth == 1 else closed[sums[:-1] >= self.least]
            out += [(key(at[i]), depth - 1, int(sums[i])) for i in wanted.tolist()]
            if self.partial and 1 < depth < self.depths:
                out += [(k, depth - 1, int(sums[i])) for i in closed[sums[:-1] < self.least].tolist() if (k := key(at[i])) in self.partial]
            if rows[-1] < len(starts) - 1:  # a shorter suffix came last: what was open here is closed
                out += self.close(depth, key(len(rows) - 1))
        return out

    def close(self, depth: int, suffix: bytes) -> list[tuple[bytes, int, int]]:
        count, self.open[depth] = self.open[depth], 0
        key = b"".join(p + b"\0" for p in suffix.split(b"\0")[:depth]) if count else b""
        return [(key, depth - 1, count)] if count and (depth == 1 or count >= self.least or key in self.partial) else []

    def end(self) -> list[tuple[bytes, int, int]]:
        return [g for depth in range(1, self.depths + 1) for g in self.close(depth, self.last)]


def grams(docs: DataFrame, length: int = MAX_N, least: int = LEAST, share: int = HEAVY) -> DataFrame:
    """(key, words, n) of all phrases of at most `length` words with at least so many occurrences, and of languages (no words) with their number of words."""
    spark = docs.sparkSession
    total, heavy = heavy_beginnings(docs, share)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // PARTITION))
    partial = frozenset(k.encode() for k, _ in heavy)

    def run(batches):
        stack = Stack(length + 1, least, partial)

        def batch(found):
            return pa.RecordBatch.from_arrays([pa.array([k for k, _, _ in found], pa.binary()).cast(pa.string()), pa.array([d for _, d, _ in found], pa.int32()), pa.array([n for _, _, n in found], pa.int64())], names=["key", "words", "n"])

        for b in batches:
            if b.num_rows:
                keys = b.column(0).cast(pa.large_string())
                at = np.frombuffer(keys.buffers()[1], np.int64)[keys.offset : keys.offset + len(keys) + 1]
                data = np.frombuffer(keys.buffers()[2], np.uint8)[at[0] : at[-1]]
                yield batch(stack.read(data, at[:-1] - at[0], at[1:] - at[0], b.column(1).to_numpy()))
        yield batch(stack.end())

    dealt = suffixes(docs, length, heavy).repartition(parts, "part").sortWithinPartitions(F.desc("key"))
    found = dealt.select("key", "n").mapInArrow(run, "key string, words int, n long")
    return found.groupBy("key", "words").agg(F.sum("n").alias("n")).where((F.col("words") == 0) | (F.col("n") >= least))


def collocations(spark: SparkSession, docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, top: int = TOP, share: int = HEAVY) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the first `top` phrases of each language by the score of their weakest cut."""
    source = docs.select(F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"), F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"))
    found = scratch(spark).keep(grams(source, MAX_N, least, share), "grams")
    part = F.split("key", "\0")
    known = found.select(part[0].alias("lang"), F.slice(part, 2, F.col("words")).alias("w"), "words", F.col("n").alias("a"))
    totals = known.where("words = 0").select("lang", F.col("a").alias("n"))
    phrases = known.where(F.col("words") >= MIN_N)
    longer = phrases.where(F.col("words") > MIN_N).select("lang", F.explode(F.array(F.slice("w", 1, MIN_N), F.slice("w", 2, MIN_N))).alias("w"), F.col("a").alias("b"))
    inside = longer.groupBy("lang", "w").agg(F.max("b").alias("b"))
    kept = phrases.join(inside, ["lang", "w"], "left").where(F.col("b").isNull() | (100 * F.col("b") < WITHIN * F.col("a"))).drop("b")
    cuts = kept.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
    cuts = cuts.select("lang", "w", "a", "k", F.slice("w", F.lit(1), F.col("k")).alias("first"), F.slice("w", F.col("k") + 1, F.col("words") - F.col("k")).alias("rest"))
    for side, count in (("first", "l"), ("rest", "r")):
        cuts = cuts.join(known.select("lang", F.col("w").alias(side), F.col("a").alias(count)), ["lang", side])
    score = F.expr("(1000000BD * CAST(a AS DECIMAL(19, 0)) * CAST(a AS DECIMAL(19, 0))) div (CAST(l AS DECIMAL(19, 0)) * CAST(r AS DECIMAL(19, 0)))")
    weakest = cuts.withColumn("score", score).groupBy("lang", "w", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("c"))
    plain = lambda c: F.replace(F.replace(c, F.lit("\x01\x01"), F.lit("\0")), F.lit("\x01\x02"), F.lit("\x01"))
    named = weakest.join(totals, "lang").select(plain(F.col("lang")).alias("lang"), plain(F.array_join("w", " ")).alias("phrase"), "a", "c.l", "c.r", "n", "c.score")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    return named.withColumn("rank", rank.cast("long")).where(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
