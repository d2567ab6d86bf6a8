"""Katz backoff: scores of texts under discounted n-gram counts with exactly normalised backoff weights.

Tokens are the words of a text (A-Z in lower case) and one end behind them.  A token's
contexts are the up to ORDER - 1 tokens before it, as far back as a start that stands
before the first word.

    p_1(w)     = (c(w) - loss_1) / N of a known word, what is left over of an unknown one
    p_m(w | h) = (c(h w) - loss_m) / c(h) if h w was seen, a(h) p_{m-1}(w | h') if only h
                 was, p_{m-1}(w | h') if not even h was; h' is h without its first token
    a(h)       = (the losses of all h w) / c(h) / (1 - the sum of p_{m-1}(w | h') of the seen h w)

A loss is r - (r + 1) n_{r+1} / n_r for a count r of at most K (Good-Turing; n_r: n-grams
of this length with count r), where that lies within (0, r), and n_1 / (n_1 + 2 n_2), or
0.5, where it doesn't.  Greater counts lose what K loses, so that every context leaves
something over and the probabilities of each context add up to one.

How it runs:
1. Texts are cut into blocks of about BLOCK bytes, joined from a task's batches, written once, with the distinct words
   of each and the tokens as numbers.
2. For m = 1 .. ORDER each block sends its distinct n-grams of length m, with their counts
   in training texts, to the part of the count table that they belong to, by the hash of
   the context.  A part adds the counts up, and answers each block with the totals, in the
   block's own order, and what a(h) needs of contexts whose continuations were not all seen.
   A block asks for no n-gram whose context was never seen.
3. Each block evaluates its tokens from length 1 up and adds them up by text.

Numbers travel as packed columns, a row for each block and part, packed and unpacked for all
that a block or a part sends at once, since these rows grow with the square of the input;
large blocks and parts keep them few.  The parts of the count
tables are written with block -1 (`tables`), if they are wanted; parts have about GROUP n-grams.  A context
with more than 1/HOT of all tokens is dealt out by the next word as well; there are fewer
than HOT of these for each length, and the sums of their parts are the only things, besides
the counts of counts, that the driver gathers.

A null text is empty: an end alone.  Repeated rows are scored, and learned from, as often
as they stand there.  A row that `train` calls null is not learned from.  Without training
texts nothing is known: score and base_score are 0.  An empty table gives an empty result.
A very long text is a block of its own, in memory in proportion to its tokens.  Only the
named columns are read, any others have no effect.
"""

from __future__ import annotations

import dataclasses
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexquarry.llm.arrow import _SPACE, distinct, hold, joined, plain, release, small_batches
from lexquarry.sources.scratch import Scratch, cleaned, scratch

#: Length of the longest n-grams; counts up to which losses are estimated one by one.
ORDER, K = 3, 5
#: Bytes of text of a block; n-grams of a part, and parts at least; a context with more than this share of all tokens is hot.
BLOCK, GROUP, PARTS, HOT = 10 << 20, 1_600_000, 64, 1000
#: Blocks of stored counts and of sums over parts.
STORED, SUMMED = -1, -2
#: Word numbers of a token that was never seen and of the start.
UNSEEN, START = -1, -2

ASKED = "block long, part int, words binary, data binary"
ANSWERED = f"{ASKED}, counts array<long>, hot array<long>, low double"
_MIX = np.uint64(0x9E3779B97F4A7C15)


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as bytes: all first bytes of the numbers, then all second ones, ..., compressed."""
    head = np.array([len(arrays), *chain.from_iterable((len(a), ord(a.dtype.char)) for a in arrays)], np.int64)
    planes = []
    for a in arrays:
        rows = np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.itemsize)
        planes += [rows[:, i].tobytes() for i in range(a.itemsize)]
    return zstandard.ZstdCompressor(level=3).compress(head.tobytes() + b"".join(planes))


def unpack(data: bytes) -> list[np.ndarray]:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    n = int(raw[:8].view(np.int64)[0])
    head, at, out = raw[8 : 8 + 16 * n].view(np.int64), 8 + 16 * n, []
    for size, kind in zip(head[::2].tolist(), head[1::2].tolist()):
        dtype = np.dtype(chr(kind))
        rows = np.empty((size, dtype.itemsize), np.uint8)
        for i in range(dtype.itemsize):
            rows[:, i] = raw[at + i * size : at + (i + 1) * size]
        out.append(rows.view(dtype).reshape(size))
        at += size * dtype.itemsize
    return out


def _starts(columns: list[np.ndarray]) -> np.ndarray:
    """Which rows differ from the row before in some column; the first does."""
    new = np.zeros(len(columns[0]), bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return new


def pack_each(*columns: tuple[np.ndarray, np.ndarray]):
    """The rows of all (column, bounds) from bounds[i] to bounds[i + 1], as bytes, for each i; whole numbers must not be negative.

    What belongs to one i is small, and there are as many as blocks times parts, so the planes are laid out for all of them at once.
    """
    planes, width = [], []
    for a, bounds in columns:
        a, cuts = a.view(np.uint64) if a.dtype.kind == "f" else a.astype(_least(a)), bounds.tolist()
        width.append(a.itemsize)
        planes += [(memoryview((a >> a.dtype.type(8 * i)).astype(np.uint8)), cuts) for i in range(a.itemsize)]
    sizes = np.ascontiguousarray(np.array([np.diff(bounds) for _, bounds in columns], np.int32).T)
    compress = zstandard.ZstdCompressor(level=3).compress
    for i, head in enumerate(sizes):
        yield compress(b"".join([head.tobytes(), bytes(width), *[p[cuts[i] : cuts[i + 1]] for p, cuts in planes]]))


def unpack_each(data: list[bytes], n: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """The n columns of all that pack_each() made, one after another, and the rows of each."""
    expand = zstandard.ZstdDecompressor().decompress
    raw = [expand(d) for d in data]
    head = np.frombuffer(b"".join([r[: 5 * n] for r in raw]), np.uint8).reshape(len(raw), 5 * n)
    sizes, widths, at, out = head[:, : 4 * n].copy().view(np.int32), head[:, 4 * n :], [5 * n] * len(raw), []
    for size, width in zip(sizes.T, widths.T):
        most, to = int(width.max(initial=1)), 0
        planes = np.zeros((most, int(size.sum())), np.uint8)
        for i, (r, k, w) in enumerate(zip(raw, size.tolist(), width.tolist())):
            planes[:w, to : to + k] = np.frombuffer(r, np.uint8, k * w, at[i]).reshape(w, k)
            at[i] += k * w
            to += k
        dtype = np.dtype(f"u{most}")
        column = planes[0].astype(dtype)
        for i in range(1, most):
            column |= planes[i].astype(dtype) << dtype.type(8 * i)
        out.append((column, size.astype(np.int64)))
    return out


def _heads(sizes: np.ndarray) -> np.ndarray:
    """Which rows are the first of each of some runs, given the rows of these."""
    new = np.zeros(int(sizes.sum()), bool)
    new[(np.cumsum(sizes) - sizes)[sizes > 0]] = True
    return new


def _bounds(sizes: np.ndarray) -> np.ndarray:
    return np.append(0, np.cumsum(sizes))


def _steps(new: np.ndarray, a: np.ndarray) -> np.ndarray:
    """Each number as its step from the row before, or itself in a new row."""
    return np.where(new, a, np.diff(a, prepend=0))


def _sums(new: np.ndarray, steps: np.ndarray) -> np.ndarray:
    steps, starts = steps.astype(np.int64), np.flatnonzero(new)
    total = np.cumsum(steps)
    return total - np.repeat((total - steps)[starts], np.diff(starts, append=len(total)))


def pack_grams(sizes: np.ndarray, keys: list[np.ndarray], n: np.ndarray, lower: np.ndarray, over: np.ndarray, hot: np.ndarray):
    """pack_each() of runs of `sizes` rows in the order of their keys: each key as its step from the row before, or itself where an earlier key is another one."""
    new, steps, bounds = _heads(sizes), [], _bounds(sizes)
    for k, key in enumerate(keys):
        if k == len(keys) - 2:
            over = np.where(new, over, 0)  # the same for all rows that share the keys before
        steps.append(_steps(new, key - START))
        new = new | (steps[-1] != 0)
    return pack_each(*[(x, bounds) for x in (*steps, n, lower, over, hot)])


def unpack_grams(data: list[bytes], m: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """(sizes, [*keys, n, lower, over, hot]) of runs that pack_grams() made."""
    found = unpack_each(data, m + 4)
    sizes, out = found[0][1], [c for c, _ in found]
    new = _heads(sizes)
    for k in range(m):
        if k == m - 2:
            starts = np.flatnonzero(new)
            out[m + 2] = np.repeat(out[m + 2][starts], np.diff(starts, append=len(new)))
        steps = out[k]
        out[k] = _short(_sums(new, steps) + START)
        new = new | (steps != 0)
    return sizes, out


def _least(a: np.ndarray) -> type:
    """The shortest type that holds the numbers, none of them negative."""
    most = int(a.max(initial=0))
    return next(t for t in (np.uint8, np.uint16, np.uint32, np.uint64) if most <= np.iinfo(t).max)


def _short(a: np.ndarray) -> np.ndarray:
    """Numbers in 4 bytes each, where they all fit, and their differences."""
    return a.astype(np.int32 if np.abs(a).max(initial=0) < 1 << 30 else np.int64)


def _binary(data: np.ndarray | bytes, sizes: np.ndarray) -> pa.LargeBinaryArray:
    """Words of these sizes, whose bytes follow one another."""
    return pa.Array.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(_bounds(sizes).astype(np.int64)), pa.py_buffer(data)])


def _flat(words: pa.LargeBinaryArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of words and their sizes."""
    offsets = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1]
    data = np.frombuffer(words.buffers()[2], np.uint8) if words.buffers()[2] is not None and len(words) else np.zeros(0, np.uint8)
    return (data[offsets[0] : offsets[-1]], np.diff(offsets)) if len(words) else (data, np.zeros(0, np.int64))


def losses(counts: list[int]) -> np.ndarray:
    """What a count of 0 .. K loses (0 loses nothing), from the numbers of n-grams with counts 1 .. K + 1."""
    once, twice = counts[0], counts[1]
    plain = once / (once + 2 * twice) if once and twice else 0.5
    out = [0.0]
    for r in range(1, K + 1):
        turing = r - (r + 1) * counts[r] / counts[r - 1] if counts[r - 1] else 0.0
        out.append(turing if 0 < turing < r else plain)
    return np.array(out)


@dataclasses.dataclass(frozen=True)
class Level:
    """What is known of n-grams of one length besides their table: losses, and (number by count, low) of the hot contexts."""

    loss: np.ndarray
    hot: dict[tuple[int, ...], tuple[np.ndarray, float]]

    def lost(self, c: np.ndarray) -> np.ndarray:
        return self.loss[np.minimum(c, K)]


@dataclasses.dataclass(frozen=True)
class Model:
    """Tokens, distinct tokens and texts learned from; a level and a table of counts for each length."""

    tokens: int
    distinct: int
    texts: int
    unknown: float  # the probability of a token that was never seen
    parts: int
    levels: tuple[Level, ...]
    tables: tuple[DataFrame, ...] = ()


def split_words(texts: pa.Array) -> tuple[pa.LargeBinaryArray, np.ndarray, np.ndarray]:
    """The distinct words of texts in lower case, a word number for each occurrence, and the words of each text."""
    data, offsets = plain(texts)
    size = np.diff(offsets)
    inside, first = ~_SPACE[data], offsets[:-1][size > 0]
    start, end = inside.copy(), inside.copy()
    start[1:] &= ~inside[:-1]
    end[:-1] &= ~inside[1:]
    start[first] = inside[first]
    last = offsets[1:][size > 0] - 1
    end[last] = inside[last]
    starts = np.flatnonzero(start)
    lower = data + ((data - np.uint8(65) < 26).view(np.uint8) << np.uint8(5))
    coded = _binary(lower[inside], np.flatnonzero(end) - starts + 1).dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy(), np.diff(np.searchsorted(starts, offsets))


def blocks(docs: DataFrame) -> DataFrame:
    """Blocks of docs(doc_id, text, train): ids, words (the end is the empty one, and the first), token numbers, ends of texts, and which are learned from."""

    def run(batches):
        hold()
        number = TaskContext.get().partitionId() << 32
        for part in joined(batches, 1, BLOCK):
            known, codes, count = split_words(part.column(1))
            ends = np.cumsum(count)
            codes = np.insert(codes + 1, ends, 0)
            often = np.bincount(codes, minlength=len(known) + 1)
            often[0] = len(codes) + 1
            order = np.argsort(-often, kind="stable")  # frequent words have small numbers, which take less room
            place = np.empty(len(order), np.int32)
            place[order] = np.arange(len(order), dtype=np.int32)
            data, sizes = _flat(pa.concat_arrays([pa.array([b""], pa.large_binary()), known]).take(pa.array(order)))
            train = part.column(2).fill_null(False).to_numpy(zero_copy_only=False).astype(np.uint8)
            ids = pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), part.column(0))
            row = [pa.array([number]), pa.array([None], pa.int32()), pa.array([pack(data, sizes.astype(np.int32))]), pa.array([pack(place[codes], ends + np.arange(1, len(ends) + 1), train)]), ids, pa.array([len(codes)])]
            yield pa.RecordBatch.from_arrays(row, names=["block", "part", "words", "data", "ids", "tokens"])
            number += 1
            release()

    small_batches(docs.sparkSession)
    return docs.mapInArrow(run, f"{ASKED}, ids array<long>, tokens long")


class Block:
    """A block and what the count tables have answered so far."""

    def __init__(self, data: bytes):
        self.codes, self.ends, train = unpack(data)
        starts = np.append(0, self.ends[:-1])
        self.size = self.ends - starts
        self.train = np.repeat(train.astype(bool), self.size)
        self.at = _short(np.arange(len(self.codes)) - np.repeat(starts, self.size))  # place within its text

    def ask_words(self, words: pa.LargeBinaryArray, parts: int):
        """(part, words, packed counts, steps of their places, and sizes) of the distinct words."""
        n = np.bincount(self.codes[self.train], minlength=len(words))
        order, sizes = _dealt(np.array([xxhash.xxh3_64_intdigest(w) for w in words.to_numpy(zero_copy_only=False)], np.uint64), parts)
        data, length = _flat(words.take(pa.array(order)))
        bounds, compress = _bounds(sizes), zstandard.ZstdCompressor(level=3).compress
        at = _bounds(length)[bounds].tolist()
        packed = pack_each(*[(x, bounds) for x in (n[order], _steps(_heads(sizes), order), length)])
        for part, (i, d) in zip(np.flatnonzero(sizes).tolist(), ((i, d) for i, d in enumerate(packed) if sizes[i])):
            yield part, compress(data[at[i] : at[i + 1]]), d

    def learn_words(self, answers: list[bytes], model: Model) -> None:
        """Takes the numbers and counts of the words; c[m] are the counts of the n-grams of length m that end at each token, p the probabilities so far."""
        (own, sizes), (counts, _), (steps, _) = unpack_each(answers, 3)
        rows = _sums(_heads(sizes), steps)
        number, count = np.empty(len(rows), np.int64), np.empty(len(rows), np.int64)
        number[rows], count[rows] = own.astype(np.int64) + START, counts
        self.number, rank = np.unique(np.append(number, START), return_inverse=True)
        self.number, rank = _short(self.number), rank.astype(np.int32)
        self.rank, self.start = rank[self.codes], rank[-1]
        level, count = model.levels[0], _short(count)
        p = np.where(count > 0, (count - level.lost(count)) / max(1, model.tokens), model.unknown)
        self.c, self.p = [None, count[self.codes]], p[self.codes]

    def before(self, k: int) -> np.ndarray:
        """The rank of the word k places before each token."""
        if not k:
            return self.rank
        return np.where(self.at >= k, np.concatenate([np.full(k, self.start), self.rank])[: len(self.rank)], self.start)

    def context(self, m: int, model: Model) -> np.ndarray:
        """The count of the context of the n-gram of length m that ends at each token; 0 if there is no such n-gram."""
        before = np.concatenate([self.c[m - 1][:1] * 0, self.c[m - 1][:-1]])
        if m == 2:
            return np.where(self.at == 0, model.texts, before)
        return np.where(self.at >= m - 2, before, 0)

    def grouped(self, m: int, model: Model, parts: int):
        """For the n-grams of length m whose context was seen: the tokens, the distinct n-gram of each, a token for each of these, their words (the nearest of the context first, the token itself last), the context's count, whether it is hot, and (order by parts, those in each)."""
        context = self.context(m, model)
        rows = np.flatnonzero(context > 0)
        words = [self.before(k)[rows] for k in (*range(1, m), 0)]
        order, starts, inverse = distinct(words)
        first = order[starts]
        keys, first = [self.number[w[first]] for w in words], rows[first]
        context = context[first]
        del words, order, starts
        hot = context > model.tokens // HOT
        h = np.full(len(first), 7, np.uint64)
        with np.errstate(over="ignore"):
            for k in keys[:-1]:
                h = (h ^ k.astype(np.uint64)) * _MIX
                h ^= h >> np.uint64(31)
            h = np.where(hot, (h ^ keys[-1].astype(np.uint64)) * _MIX, h)
        return rows, inverse, first, keys, context, hot, _dealt(h ^ (h >> np.uint64(29)), parts)

    def ask(self, m: int, model: Model, parts: int):
        """(part, packed columns): the words of the distinct n-grams, their counts, the counts of the n-gram and the context that p_{m-1} comes from, and whether the context is hot."""
        rows, inverse, first, keys, _, hot, (order, sizes) = self.grouped(m, model, parts)
        n = np.bincount(inverse[self.train[rows]], minlength=len(first))
        del rows, inverse
        lower = np.where(n > 0, self.c[m - 1][first], 0)
        over = self.context(m - 1, model)[first] if m > 2 else np.zeros(len(first), np.int32)
        packed = pack_grams(sizes, [k[order] for k in keys], n[order], lower[order], over[order], hot[order].astype(np.uint8))
        return ((part, d) for part, d in enumerate(packed) if sizes[part])

    def learn(self, m: int, model: Model, parts: int, answers: list[bytes]) -> None:
        """Takes the counts of length m, and goes from p_{m-1} to p_m."""
        rows, inverse, first, keys, context, hot, (order, _) = self.grouped(m, model, parts)
        level, total = model.levels[m - 1], np.zeros(len(first), np.int64)
        left, low, share = np.zeros(len(first)), np.zeros(len(first)), np.append(level.loss[1:], level.loss[K])
        if answers:
            (c, _), (counts, _), (lows, _) = unpack_each(answers, 3)
            total[order] = c
            unseen = order[(c == 0) & ~hot[order]]
            which = _runs([k[unseen] for k in keys[:-1]])
            left[unseen], low[unseen] = (counts.reshape(-1, K + 1) @ share)[which], lows.astype(np.uint64).view(np.float64)[which]
        unseen = np.flatnonzero((total == 0) & hot)
        new = _starts([k[unseen] for k in keys[:-1]])
        found = [level.hot[tuple(int(k[i]) for k in keys[:-1])] for i in unseen[new].tolist()]
        if found:
            which = np.cumsum(new) - 1
            left[unseen], low[unseen] = np.array([counts @ share for counts, _ in found])[which], np.array([x for _, x in found])[which]
        total, seen = _short(total), total > 0
        del keys, order, hot
        value = np.where(seen, (total - level.lost(total)) / context, left / context / (1 - low))
        c, own = np.zeros(len(self.codes), total.dtype), value[inverse]
        c[rows] = total[inverse]
        self.c.append(c)
        self.p[rows] = np.where(seen[inverse], own, self.p[rows] * own)

    def scores(self, model: Model) -> list[np.ndarray]:
        """Tokens, known tokens, base score and score of each text."""
        starts, c = self.ends - self.size, self.c[1]
        base = np.log10((c + 1) / (model.tokens + model.distinct + 1))
        return [self.size, *[np.add.reduceat(x, starts) for x in ((c > 0).astype(np.int64), base, np.log10(self.p))]]


def _dealt(hashes: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """The rows by part, in order within each, and how many are in each part."""
    part = (hashes % np.uint64(parts)).astype(np.uint16 if parts <= 1 << 16 else np.int64)
    return np.argsort(part, kind="stable"), np.bincount(part, minlength=parts)  # short numbers are sorted by counting


def _runs(columns: list[np.ndarray]) -> np.ndarray:
    """The number of the run of equal rows that each row is in."""
    return np.cumsum(_starts(columns)) - 1


def add_words(parts: int, tables: bool):
    """The function of a part of the word table: adds counts up, numbers the words, most frequent first, and answers each block; with `tables` its own words and counts stay."""

    def run(key, table):
        hold()
        part, rows = key[0].as_py(), sorted(table.select(["block", "words", "data"]).to_pylist(), key=lambda r: r["block"])
        (n, sizes), (places, _), (length, _) = unpack_each([r["data"] for r in rows], 3)
        expand = zstandard.ZstdDecompressor().decompress
        coded = _binary(b"".join([expand(r["words"]) for r in rows]), length).dictionary_encode()
        vocabulary, codes = coded.dictionary, coded.indices.to_numpy()
        total = np.bincount(codes, n, len(vocabulary)).astype(np.int64)
        number = np.empty(len(vocabulary), np.int64)
        number[np.argsort(-total, kind="stable")] = np.arange(len(vocabulary)) * parts + part
        if rows[0]["block"] == STORED:
            number[:] = UNSEEN
            number[codes[: sizes[0]]] = places[: sizes[0]]
        number[total == 0] = UNSEEN
        bounds = _bounds(sizes)
        told = pack_each(*[(x, bounds) for x in (number[codes] - START, total[codes], places)])
        out = [(r["block"], None, d, None, None, None) for r, d in zip(rows, told) if r["block"] != STORED]
        seen = np.flatnonzero(total)
        texts = int(total[pc.binary_length(vocabulary).to_numpy() == 0].sum())
        counts = [int(total.sum()), len(seen), texts, *np.bincount(np.minimum(total, K + 2), minlength=K + 3)[1 : K + 2].tolist()]
        if len(seen):
            kept = (None, None)
            if tables:
                data, length = _flat(vocabulary.take(pa.array(seen)))
                whole = np.array([0, len(seen)])
                kept = (zstandard.ZstdCompressor(level=3).compress(data), *pack_each((total[seen], whole), (number[seen], whole), (length, whole)))
            out.append((STORED, *kept, counts, None, None))
        return _answers(part, out)

    return run


def add_grams(m: int, model: Model, tables: bool):
    """The function of a part of the table of n-grams of length m, which stays with `tables`."""
    below = model.levels[m - 2]

    def run(key, table):
        hold()
        part, rows = key[0].as_py(), sorted(table.select(["block", "data"]).to_pylist(), key=lambda r: r["block"])
        sizes, columns = unpack_grams([r["data"] for r in rows], m)
        order, starts, inverse = distinct(columns[:m])
        first = order[starts]
        total = np.bincount(inverse, columns[m], len(first)).astype(np.int64)
        lower, over = (np.maximum.reduceat(columns[m + i][order], starts).astype(np.int64) for i in (1, 2))
        keys, hot = [c[first] for c in columns[:m]], columns[m + 3][first].astype(bool)
        del columns, order
        seen, context = total > 0, _runs(keys[:-1])
        n = int(context[-1]) + 1
        p = np.where(seen, (lower - below.lost(lower)) / (np.maximum(1, over) if m > 2 else model.tokens or 1), 0.0)
        counts = np.bincount(context[seen] * (K + 1) + np.minimum(total[seen], K + 1) - 1, minlength=n * (K + 1)).reshape(n, K + 1)
        low = np.bincount(context, p, n)
        told = total[inverse]
        unseen = np.flatnonzero((total == 0) & ~hot)
        asked = np.zeros(len(total), bool)
        asked[unseen] = True
        asked = np.flatnonzero(asked[inverse])  # the rows whose contexts are told about, each context once to a block
        to, owner = context[inverse[asked]], np.repeat(np.arange(len(sizes)), sizes)[asked]
        new = _starts([owner, to])
        to, size = to[new], np.bincount(owner[new], minlength=len(sizes))
        bounds = _bounds(size)
        packed = pack_each((told, _bounds(sizes)), (counts[to].ravel(), bounds * (K + 1)), (low[to], bounds))
        out = [(r["block"], None, d, None, None, None) for r, d in zip(rows, packed) if r["block"] != STORED]
        if seen.any():
            kept = next(iter(pack_grams(np.array([seen.sum()]), [k[seen] for k in keys], total[seen], lower[seen], over[seen], hot[seen].astype(np.uint8)))) if tables else None
            out.append((STORED, None, kept, np.bincount(np.minimum(total, K + 2), minlength=K + 3)[1 : K + 2].tolist(), None, None))
        for i in np.flatnonzero(hot & (np.diff(context, prepend=-1) != 0)).tolist():
            out.append((SUMMED, None, None, None, [*[int(k[i]) for k in keys[:-1]], *counts[context[i]].tolist()], float(low[context[i]])))
        return _answers(part, out)

    return run


def _answers(part: int, rows: list[tuple]) -> pa.Table:
    block, words, data, counts, hot, low = zip(*rows)
    columns = [pa.array(block, pa.int64()), pa.array([part] * len(rows), pa.int32()), pa.array(words, pa.binary()), pa.array(data, pa.binary()), pa.array(counts, pa.list_(pa.int64())), pa.array(hot, pa.list_(pa.int64())), pa.array(low, pa.float64())]
    release()
    return pa.table(columns, names=["block", "part", "words", "data", "counts", "hot", "low"])


def _asked(rows: list[tuple[int, int, bytes | None, bytes]]) -> pa.Table:
    block, part, words, data = zip(*rows) if rows else ((), (), (), ())
    return pa.table([pa.array(block, pa.int64()), pa.array(part, pa.int32()), pa.array(words, pa.binary()), pa.array(data, pa.binary())], names=["block", "part", "words", "data"])


def _with_answers(files: Scratch, cut: DataFrame, answers: list[DataFrame]):
    """Rows of each block together: its own (level 0) and the answers of each level."""
    rows = cut.select("block", F.lit(0).alias("level"), F.lit(None).cast("int").alias("part"), "data", "ids")
    for m, a in enumerate(answers, 1):
        rows = rows.unionByName(a.where("block >= 0").select("block", F.lit(m).alias("level"), "part", "data", F.lit(None).cast("array<long>").alias("ids")))
    return rows.groupBy("block")


def _evaluated(table: pa.Table, model: Model, upto: int) -> tuple[Block, dict]:
    hold()
    answers, own = [{} for _ in range(upto + 1)], None
    for r in table.to_pylist():
        if r["level"]:
            answers[r["level"]][r["part"]] = r["data"]
        else:
            own = r
    b, told = Block(own["data"]), [[a[part] for part in sorted(a)] for a in answers]
    b.learn_words(told[1], model)
    for m in range(2, upto + 1):
        b.learn(m, model, model.parts, told[m])
    return b, own


def _asker(m: int, model: Model):
    def run(table):
        b, own = _evaluated(table, model, m - 1)
        out = _asked([(own["block"], p, None, c) for p, c in b.ask(m, model, model.parts)])
        release()
        return out

    return run


def evaluate(spark: SparkSession, docs: DataFrame, train: Column | None = None, model: Model | None = None, text: str = "text", id: str = "doc_id", order: int = ORDER, parts: int | None = None, tables: bool = True) -> tuple[DataFrame, Model]:
    """((doc_id, n_tokens, n_known, base_score, score), model): scores of all docs, by what is learned from those that `train` chooses, or by a model learned before.

    Without `tables` the model's own tables, which only later texts need, are not written; the scores are the same.
    """
    files, old = scratch(spark), model
    if old and not old.tables:
        raise ValueError("the model was learned without tables")
    tables = tables and not old
    model = old and dataclasses.replace(old, tables=())
    chosen = train if train is not None and old is None else F.lit(False)
    source = docs.select(F.col(id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"), chosen.alias("train"))
    cut, (tokens,) = files.counted(blocks(source), "blocks", F.sum("tokens"))
    parts = old.parts if old else parts or max(PARTS, -(-tokens // GROUP))
    order = len(old.levels) if old else order
    answers: list[DataFrame] = []

    def asked(batches):
        for batch in batches:
            for r in batch.to_pylist():
                told = Block(r["data"]).ask_words(_binary(*unpack(r["words"])), parts)
                yield from _asked([(r["block"], p, w, d) for p, w, d in told]).to_batches()

    for m in range(1, order + 1):
        if m == 1:
            wanted = cut.select("block", "words", "data").mapInArrow(asked, ASKED)
        else:
            wanted = _with_answers(files, cut, answers).applyInArrow(_asker(m, model), ASKED)
        if old:
            wanted = wanted.unionByName(old.tables[m - 1].select("block", "part", "words", "data"))
        with cleaned(spark):
            told = files.keep(wanted.groupBy("part").applyInArrow(add_words(parts, tables) if m == 1 else add_grams(m, model, tables), ANSWERED), f"counts-{m}")
        answers.append(told)
        if m == 1:  # nothing reads the words again
            whole, cut = cut, files.keep(cut.select("block", "data", "ids"), "coded")
            files.drop(whole)
        if not old:
            model = _learned(told, m, model, parts)
    done = dataclasses.replace(model, tables=())

    def scored(table):
        b, own = _evaluated(table, done, order)
        out = pa.table([pa.array(own["ids"], pa.int64()), *[pa.array(x) for x in b.scores(done)]], names=["doc_id", "n_tokens", "n_known", "base_score", "score"])
        release()
        return out

    found = _with_answers(files, cut, answers).applyInArrow(scored, "doc_id long, n_tokens long, n_known long, base_score double, score double")
    return found, old or dataclasses.replace(model, tables=tuple(a.where(F.col("block") == STORED) for a in answers if tables))


def _learned(told: DataFrame, m: int, model: Model | None, parts: int) -> Model:
    """The model with what a new table tells of its length."""
    n = K + 1 + (3 if m == 1 else 0)
    sums = told.where(F.col("block") == STORED).agg(*[F.sum(F.col("counts")[i]) for i in range(n)]).first()
    counts = [int(x or 0) for x in sums]
    if m == 1:
        tokens, kinds, texts, *counts = counts
        loss = losses(counts)
        lost = sum(float(loss[r]) * counts[r - 1] for r in range(1, K + 1)) + float(loss[K]) * (kinds - sum(counts[:K]))
        return Model(tokens, kinds, texts, lost / tokens if tokens else 1.0, parts, (Level(loss, {}),))
    ctx = F.slice("hot", 1, m - 1)
    hot = told.where(F.col("block") == SUMMED).groupBy(ctx.alias("context")).agg(*[F.sum(F.col("hot")[m - 1 + i]).alias(f"c{i}") for i in range(K + 1)], F.sum("low").alias("low")).collect()
    level = Level(losses(counts), {tuple(r["context"]): (np.array([r[f"c{i}"] for i in range(K + 1)]), r["low"]) for r in hot})
    return dataclasses.replace(model, levels=(*model.levels, level))
