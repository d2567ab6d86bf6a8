"""Benchmark decontamination by pigeonhole edit matching.

A test item of m characters may be found with k = floor(RATE * m) edits.  Cut
into k + 1 pieces, at least one piece of it stands unedited in a text that
holds it, so that one pass of an Aho-Corasick automaton over all pieces finds
every place worth a look.  Myers' bit-parallel distance, run for many places at
once, decides: the item must be within k edits of a part of the text.

Before that, runs of up to PIECES neighbouring pieces are looked at in the same way: as the
pieces are one more than the edits, some run of L pieces has at most L - 1 edits, and
one of its pieces none.  So a piece leads to its item only where its run stands with
fewer edits than it has pieces, which takes a few dozen characters to tell.

Texts and items are compared in lower case, with every run of characters other
than letters and digits as one space.

Nulls, empty texts and items without a letter or digit match nothing.  Repeated
rows give repeated results, repeated items (by item_id) one result each; equal
items under different ids both match.  A very long text is searched whole, in memory
in proportion to it and to the places where pieces stand.  Only the two named columns
count; others stay in what clean() keeps.  An empty table on either side gives an
empty result.  The items go to the executors in blocks of at most BLOCK_CHARS
characters, with a pass over the texts for each block.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexquarry.llm.arrow import keep, slices, small_batches

#: Edits for each character of an item, and characters of the items of one pass.
RATE, BLOCK_CHARS = 0.1, 4 << 20
#: Places whose alignments are near another are looked at together; places of one batch.
NEAR, PLACES = 32, 4096
#: Pieces of a run at most; a run also fits a word of 64 bits.
PIECES = 3
#: Bytes of text that are searched at once.
SLICE = 3 << 20

_OTHER = re.compile(r"[\W_]+")


def plain_text(text: str | None) -> str:
    return _OTHER.sub(" ", (text or "").lower()).strip()


class Matcher:
    """Finds items, given as (item_id, text)."""

    def __init__(self, items: list[tuple[int, str]], rate: float = RATE):
        self.items = [(i, t) for i, t in ((i, plain_text(t)) for i, t in items) if t]
        self.patterns = [t for _, t in self.items]  # and the runs behind the items
        budget = [int(len(t) * rate) for t in self.patterns]
        self.run: dict[int, tuple[int, int]] = {}  # (item, where it stands there)
        pieces: dict[str, list[tuple[int, int]]] = {}
        for at, (_, t) in enumerate(self.items):
            n = budget[at] + 1
            cuts = [len(t) * j // n for j in range(n + 1)]
            runs = -(-n // max(1, min(PIECES, 64 // -(-len(t) // n))))
            for r in range(runs):
                first, last = n * r // runs, n * (r + 1) // runs
                own, start = at, 0
                if 1 < last - first < n:
                    own, start = len(self.patterns), cuts[first]
                    self.run[own] = at, start
                    self.patterns.append(t[start : cuts[last]])
                    budget.append(last - first - 1)
                for a, b in zip(cuts[first:last], cuts[first + 1 :]):
                    pieces.setdefault(t[a:b], []).append((own, b - start))
        self.budget, self.size = np.array(budget, np.int64), np.array([len(t) for t in self.patterns], np.int64)
        self.automaton = ahocorasick.Automaton()
        for piece, owners in pieces.items():
            self.automaton.add_word(piece, owners)
        if pieces:
            self.automaton.make_automaton()
        self.letters = {c: i + 1 for i, c in enumerate(sorted({c for _, t in self.items for c in t}))}
        self.code = np.zeros(sys.maxunicode + 1, np.int32)
        for c, i in self.letters.items():
            self.code[ord(c)] = i
        self.words = -(-self.size // 64)
        self.masks: dict[int, np.ndarray] = {}

    def mask(self, at: int) -> np.ndarray:
        """Places of each letter in an item or run, as bits: letters by words."""
        if at not in self.masks:
            t, m = self.patterns[at], np.zeros((len(self.letters) + 1, int(self.words[at])), np.uint64)
            for i, c in enumerate(t):
                m[self.letters[c], i >> 6] |= np.uint64(1 << (i & 63))
            self.masks[at] = m
        return self.masks[at]

    def hits(self, text: str) -> set[tuple[int, int]]:
        """(item or run, where its start would be) of each piece that the text holds."""
        return {(at, end + 1 - b) for end, owners in self.automaton.iter(text) for at, b in owners} if self.items else set()

    def find(self, texts: list[str]) -> list[tuple[int, int, int, int]]:
        """(text number, item number, distance, end in the plain text): the best place of each pair."""
        best: dict[tuple[int, int], tuple[int, int]] = {}
        codes = [self.code[np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32)] for t in texts]
        places: set[tuple[int, int, int]] = set()
        runs: list[tuple[int, int, int]] = []
        for k, text in enumerate(texts):
            for at, start in self.hits(text):
                if at in self.run:
                    runs.append((k, at, start))
                else:
                    places.add((k, at, start // NEAR * NEAR))
        for (k, at, start), d, _ in self.measured(runs, 1, codes):
            if d <= self.budget[at]:
                item, before = self.run[at]
                places.add((k, item, (start - before) // NEAR * NEAR))
        for (k, at, _), d, end in self.measured(sorted(places), NEAR, codes):
            if d <= self.budget[at] and (d, end) < best.get((k, at), (d + 1, 0)):
                best[k, at] = (d, end)
        return [(k, at, d, end) for (k, at), (d, end) in sorted(best.items())]

    def measured(self, places: list[tuple[int, int, int]], near: int, codes: list[np.ndarray]):
        """Each (text number, item or run, start) with what distances() tells of it."""
        groups: dict[int, list[tuple[int, int, int]]] = {}
        for x in places:
            groups.setdefault(int(self.words[x[1]]), []).append(x)
        for words, todo in groups.items():
            todo.sort(key=lambda x: self.size[x[1]])
            for a in range(0, len(todo), PLACES):
                part = todo[a : a + PLACES]
                yield from zip(part, *self.distances(words, part, near, codes))

    def distances(self, words: int, part: list[tuple[int, int, int]], near: int, texts: list[np.ndarray]) -> tuple[list[int], list[int]]:
        """Least distance of each item or run to a part of its text, which starts less than `near` behind the place or, by edits, off that, and where that ends."""
        own = {at: i for i, at in enumerate(sorted({at for _, at, _ in part}))}
        masks = np.stack([self.mask(at) for at in own])
        item = np.array([own[at] for _, at, _ in part])
        where = np.array([at for _, at, _ in part])
        start = np.maximum(np.array([s for _, _, s in part]) - self.budget[where], 0)
        stop = np.array([s for _, _, s in part]) + near + self.size[where] + self.budget[where]
        length = int((stop - start).max())
        codes = np.zeros((len(part), length), np.int32)
        for i, ((k, _, _), a, b) in enumerate(zip(part, start.tolist(), stop.tolist())):
            seen = texts[k][a : max(b, 0)]
            codes[i, : len(seen)] = seen
        codes = np.ascontiguousarray(codes.T)
        one, high = np.uint64(1), np.uint64(63)
        pv = np.full((words, len(part)), ~np.uint64(0))
        mv = np.zeros((words, len(part)), np.uint64)
        top = ((self.size[where] - 1) & 63).astype(np.uint64)
        score = self.size[where].copy()
        least, end = score.copy(), np.zeros(len(part), np.int64)
        for j in range(length):
            carry = up = down = np.zeros(len(part), np.uint64)
            for w in range(words):
                p, m, eq = pv[w], mv[w], masks[item, codes[j], w]
                xv = eq | m
                low = eq & p
                total = low + p
                over = (total < low).astype(np.uint64)
                total = total + carry
                carry = over | (total < carry)
                xh = (total ^ p) | eq
                ph, mh = m | ~(xh | p), p & xh
                if w == words - 1:
                    score += ((ph >> top) & one).astype(np.int64) - ((mh >> top) & one).astype(np.int64)
                ph, up = ph << one | up, ph >> high
                mh, down = mh << one | down, mh >> high
                pv[w], mv[w] = mh | ~(xv | ph), ph & xv
            lower = score < least
            least[lower] = score[lower]
            end[lower] = j + 1
        return least.tolist(), (start + end).tolist()


_matchers: dict[tuple, Matcher] = {}


def matcher_of(items: list[tuple[int, str]], rate: float) -> Matcher:
    """The matcher of a block, which a worker keeps from task to task until it gets another block."""
    key = (rate, *map(tuple, items))
    if key not in _matchers:
        _matchers.clear()
        _matchers[key] = Matcher(items, rate)
    return _matchers[key]


def blocks(benchmark: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """The items of (item_id, text), in blocks of bounded size; each block is fetched when its turn comes."""
    items = benchmark.select(F.col("item_id").cast("long"), "text").where("text IS NOT NULL").dropDuplicates(["item_id", "text"])
    size = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n = -(-size // BLOCK_CHARS)
    for i in range(n):
        yield [tuple(r) for r in items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == i).collect()]


def leaks(df: DataFrame, benchmark: DataFrame, rate: float = RATE) -> DataFrame:
    """(doc_id, item_id, distance, budget, ends_at) for each text of df(doc_id, text) that holds an item."""
    schema = "doc_id long, item_id long, distance long, budget long, ends_at long"
    small_batches(df.sparkSession)
    docs, out = df.select(F.col("doc_id").cast("long"), "text"), None
    for items in blocks(benchmark):

        def run(batches, items=items):
            matcher = matcher_of(items, rate)
            for batch in batches:
                for part in slices(batch, 1, SLICE):
                    got = matcher.find([plain_text(t) for t in part.column(1).to_pylist()])
                    doc = part.column(0).to_pylist()
                    rows = [(doc[k], matcher.items[at][0], d, int(matcher.budget[at]), end) for k, at, d, end in got]
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows) if rows else [[]] * 5)], names=["doc_id", "item_id", "distance", "budget", "ends_at"])

        found = docs.mapInArrow(run, schema)
        out = found if out is None else out.unionByName(found)
    return docs.sparkSession.createDataFrame([], schema) if out is None else out


def clean(df: DataFrame, benchmark: DataFrame, text: str = "text", rate: float = RATE) -> DataFrame:
    """The rows of df whose text holds no item; all columns stay."""
    for items in blocks(benchmark):

        def make(items=items):
            matcher = matcher_of(items, rate)

            def f(column):
                held = {k for k, *_ in matcher.find([plain_text(t) for t in column.to_pylist()])}
                return [k not in held for k in range(len(column))]

            return f

        df = keep(df, text, make, SLICE)
    return df
