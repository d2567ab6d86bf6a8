"""Toxic spans and document scores by a linear-chain conditional random field.

A text is a sequence of words, each tagged clean or toxic.  The score of a tag
is the sum of weights of hashed features of the word (itself, its beginnings and
its ending), and of the pair of neighbouring tags.  Forward-backward marginals
give the chance of each word to be toxic; a logistic function of their largest
value and their sum is the document's score, and the runs of words that are
toxic rather than not are its offending spans.

Labels are of documents, so the labelled tokens come from them: a word of a
toxic document is toxic if it, or one of its beginnings, is far more frequent in
toxic documents than in clean ones (CUE_DOCS, CUE_ODDS).  The fit reads a
bounded sample of labelled rows (`labelled.ROWS`, `labelled.BYTES`).

Chains run through the whole text.  They are cut into blocks whose 2 x 2
products are combined, which is exact and lets numpy advance all blocks at once.

A null or empty text, or one without words, has the score of a text without a
toxic word.  Without training rows, or with one label only, every score is 0; a
sample in which no word is a cue gives every text the share of toxic rows.  A very
long text is one chain; it takes memory in proportion to its words.  Repeated rows
get equal scores; an empty table gives an empty result.  Other columns stay; one
with the name of a result is replaced.
"""

from __future__ import annotations

import re
import sys
import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from lexquarry.llm.arrow import Lexicon, append, keep, release

#: Hashed features; words of a block of a chain.
BUCKETS, BLOCK = 1 << 18, 32
#: Hashed words and beginnings of words that are looked at for cues.
CUE_BUCKETS = 1 << 22
#: A cue is in so many toxic documents at least, and so many times likelier in them than in clean ones.
CUE_DOCS, CUE_ODDS = 6, 20.0
#: A text that shares so many long words with an earlier one, and a fifth of its own, is a copy.
COPIED = 10
#: Texts of the sample whose chains are in memory at once; bytes of text that are scored at once.
GROUP, SLICE = 250, 3 << 19
#: Steps of the fit, its rate, and the weight of the squared weights.
STEPS, RATE, DECAY = 40, 0.25, 1e-2

_WORD = re.compile(r"\w+")


def cue_buckets(word: str) -> list[int]:
    """Hashes of a word and its beginnings, of what may be a cue; the same number for every word."""
    return [zlib.crc32(p.encode()) % CUE_BUCKETS for p in (word, f"{word[:4]}-", f"{word[:5]}-", f"{word[:6]}-")]


def features(word: str) -> list[int]:
    """Buckets of a word: itself, three beginnings, its ending; the same number for every word."""
    parts = (f"w {word}", f"4 {word[:4]}", f"5 {word[:5]}", f"6 {word[:6]}", f"e {word[-4:]}")
    return [zlib.crc32(p.encode()) % BUCKETS for p in parts]


def words_of(piece: bytes) -> list[str]:
    return _WORD.findall(piece.decode().lower())


def table(words: list[str], make: Callable[[str], list[int]], width: int) -> np.ndarray:
    """The numbers that make() gives for each word."""
    return np.fromiter((x for w in words for x in make(w)), np.int32, width * len(words)).reshape(-1, width)


class Chains:
    """Forward-backward over all texts at once, two tags, in ratios of toxic to clean."""

    def __init__(self, sizes: np.ndarray):
        blocks = -(-sizes // BLOCK)
        self.sizes, n = sizes, int(blocks.sum())
        text = np.repeat(np.arange(len(sizes)), blocks)
        self.rank = np.arange(n) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        start = np.repeat(np.cumsum(sizes) - sizes, blocks) + self.rank * BLOCK
        self.size = np.minimum(BLOCK, sizes[text] - self.rank * BLOCK)
        self.at = np.minimum(start[None, :] + np.arange(BLOCK)[:, None], max(0, int(sizes.sum()) - 1))
        self.real = np.arange(BLOCK)[:, None] < self.size[None, :]
        order = np.argsort(-blocks, kind="stable")
        self.first = (np.cumsum(blocks) - blocks)[order]
        self.count = blocks[order]

    def marginals(self, e: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each word: its chance of being toxic, the ratio before it, and the ratio of what follows."""
        if not len(e):
            return e, e, e
        (a, b), (c, d) = np.exp(trans)
        weight = np.exp(np.clip(e, -30, 30))[self.at]
        n = weight.shape[1]
        p, q, r, s = np.ones(n), np.zeros(n), np.zeros(n), np.ones(n)
        for w, real in zip(weight, self.real):
            p2, q2, r2, s2 = p * a + q * c, (p * b + q * d) * w, r * a + s * c, (r * b + s * d) * w
            top = np.maximum(np.maximum(p2, q2), np.maximum(r2, s2))
            p, q, r, s = (np.where(real, x / top, y) for x, y in ((p2, p), (q2, q), (r2, r), (s2, s)))
        into, out = np.zeros(n), np.ones(n)
        for k in range(1, int(self.count.max(initial=0))):
            now = self.first[: np.searchsorted(-self.count, -k, side="left")] + k
            x = into[now - 1]
            into[now] = (q[now - 1] + s[now - 1] * x) / (p[now - 1] + r[now - 1] * x)
        for k in range(int(self.count.max(initial=0)) - 2, -1, -1):
            now = self.first[: np.searchsorted(-self.count, -(k + 1), side="left")] + k
            x = out[now + 1]
            out[now] = (r[now + 1] + s[now + 1] * x) / (p[now + 1] + q[now + 1] * x)
        before, ratio, x = np.empty_like(weight), np.empty_like(weight), into
        for j in range(BLOCK):
            before[j] = x
            ratio[j] = x = np.where(self.real[j], weight[j] * (b + d * x) / (a + c * x), x)
        after, x = np.empty_like(weight), out
        for j in range(BLOCK - 1, -1, -1):
            after[j] = x
            x = np.where(self.real[j], (c + d * weight[j] * x) / (a + b * weight[j] * x), x)
        chance = ratio * after / (1 + ratio * after)
        flat = [np.empty(len(e)) for _ in range(3)]
        for x, y in zip(flat, (chance, before, after)):
            x[self.at[self.real]] = y[self.real]
        return tuple(flat)


def originals(texts: list[np.ndarray], long: np.ndarray) -> list[bool]:
    """Whether each text (its distinct word numbers) is no copy: fewer than COPIED or than a fifth of its long words came first in one text before it."""
    owner = np.full(len(long), -1, np.int32)
    out = []
    for i, held in enumerate(texts):
        held = held[long[held]]
        seen = owner[held]
        shared = np.bincount(seen[seen >= 0]).max(initial=0) if len(held) else 0
        out.append(5 * shared < len(held) or shared < COPIED)
        owner[held[seen < 0]] = i
    return out


def cues(texts: list[np.ndarray], toxic: np.ndarray, buckets: np.ndarray, long: np.ndarray) -> np.ndarray:
    """Which words have a bucket that marks toxic documents.  Copies of a text count once."""
    seen, at = np.unique(buckets, return_inverse=True)
    at = at.reshape(buckets.shape)
    df, total = np.zeros((2, len(seen)), np.int32), [0, 0]
    for held, y, new in zip(texts, toxic.tolist(), originals(texts, long)):
        if new:
            df[y, np.unique(at[held])] += 1
            total[y] += 1
    return ((df[1] >= CUE_DOCS) & ((df[1] + 0.5) / (total[1] + 1) >= CUE_ODDS * (df[0] + 0.5) / (total[0] + 1)))[at].any(1)


class Group:
    """Some texts of the sample: word numbers, tags, and what does not change from step to step."""

    def __init__(self, ids: np.ndarray, sizes: np.ndarray, y: np.ndarray):
        self.ids, self.y, self.chains = ids, y.astype(np.float32), Chains(sizes)
        first = np.zeros(len(ids), bool)
        first[(np.cumsum(sizes) - sizes)[sizes > 0]] = True
        last = np.where(first, 0.0, np.append(0.0, y[:-1])) if len(y) else y
        self.seen = np.array([[0, ((1 - last) * y).sum()], [(last * (1 - y)).sum(), (last * y).sum()]])

    def expected(self, e: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Chance of each word to be toxic, and the expected number of each pair of tags."""
        chance, before, after = self.chains.marginals(e, trans)
        (a, b), (c, d) = np.exp(trans)
        to = np.exp(np.clip(e, -30, 30)) * after
        whole = a + b * to + before * (c + d * to)
        return chance, np.array([[0, (b * to / whole).sum()], [(before * c / whole).sum(), (before * d * to / whole).sum()]])


class Model:
    def __init__(self, weights: np.ndarray, bias: float, trans: np.ndarray, link: np.ndarray | None):
        self.weights, self.bias, self.trans, self.link = weights.astype(np.float32), bias, trans, link

    @classmethod
    def fit(cls, rows: list[tuple[str, int]]) -> "Model":
        weights, trans = np.zeros(BUCKETS), np.array([[0.0, -2.0], [0.0, 0.0]])
        toxic = np.array([y for _, y in rows], np.int64)
        if not rows or not toxic.any() or toxic.all():
            return cls(weights, -6.0, trans, None)
        lexicon = Lexicon(words_of, lambda words: np.zeros((len(words), 0)), sys.maxsize)  # numbers hold for the whole sample
        read = [lexicon.read(pa.array([t for t, _ in rows[a : a + GROUP]]))[:2] for a in range(0, len(rows), GROUP)]
        distinct = list(lexicon.number)
        del lexicon
        texts = [np.unique(x) for ids, sizes in read for x in np.split(ids, np.cumsum(sizes)[:-1])]
        hot = cues(texts, toxic, table(distinct, cue_buckets, 4), np.array([len(w) > 6 for w in distinct], bool))
        del texts
        tagged = [(ids, sizes, hot[ids] & (np.repeat(toxic[a * GROUP : (a + 1) * GROUP], sizes) == 1)) for a, (ids, sizes) in enumerate(read)]
        groups = [Group(ids, sizes, y.astype(float)) for ids, sizes, y in tagged]
        observed = sum(np.bincount(ids, y, len(distinct)) for ids, _, y in tagged)
        seen = sum(g.seen for g in groups)
        del tagged
        buckets = table(distinct, features, 5)
        bias, scale = -4.0, len(rows)
        x = np.zeros(BUCKETS + 4)
        m, v = np.zeros_like(x), np.zeros_like(x)
        x[BUCKETS:] = bias, *trans.ravel()[1:]
        for step in range(1, STEPS + 1):
            trans = np.array([[0.0, x[BUCKETS + 1]], [x[BUCKETS + 2], x[BUCKETS + 3]]])
            each = x[buckets].sum(1) + x[BUCKETS]
            lack, pair = -observed, -seen
            for g in groups:
                chance, pairs = g.expected(each[g.ids], trans)
                lack = lack + np.bincount(g.ids, chance, len(distinct))
                pair = pair + pairs
            slope = sum(np.bincount(buckets[:, i], lack, BUCKETS) for i in range(5))
            slope = np.concatenate([slope, [lack.sum()], pair.ravel()[1:]]) / scale + DECAY * x / scale
            m, v = 0.9 * m + 0.1 * slope, 0.99 * v + 0.01 * slope**2
            x = x - RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        model = cls(x[:BUCKETS], x[BUCKETS], np.array([[0.0, x[BUCKETS + 1]], [x[BUCKETS + 2], x[BUCKETS + 3]]]), None)
        each = model.emissions(buckets)
        got = [model.tag(sizes, each[ids])[1:] for ids, sizes in read]
        top, total = (np.concatenate(x) for x in zip(*got))
        model.link = _logistic(np.stack([np.ones(len(toxic)), top, np.log1p(total)], 1), toxic)
        del read, groups, buckets
        release()
        return model

    def emissions(self, buckets: np.ndarray) -> np.ndarray:
        """The score of the toxic tag of each word, from its buckets."""
        return self.weights[buckets].sum(1) + self.bias

    def reader(self) -> Callable[[pa.Array], tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """A function of a column of texts: words of each text, chance of each word, the largest and the sum of each text."""
        lexicon = Lexicon(words_of, lambda words: self.emissions(table(words, features, 5)))

        def read(column):
            ids, sizes, each = lexicon.read(column)
            return sizes, *self.tag(sizes, each[ids])

        return read

    def tag(self, sizes: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Chance of each word, of texts of so many words; the largest and the sum of each text."""
        chance, _, _ = Chains(sizes).marginals(e.astype(float), self.trans)
        total = np.concatenate([[0], np.cumsum(chance)])
        ends = np.cumsum(sizes)
        top = np.zeros(len(sizes))
        some = sizes > 0
        if some.any():
            top[some] = np.maximum.reduceat(chance, (ends - sizes)[some])
        return chance, top, np.maximum(total[ends] - total[ends - sizes], 0)

    def score(self, top: np.ndarray, total: np.ndarray) -> np.ndarray:
        if self.link is None:
            return np.zeros(len(top))
        return 1 / (1 + np.exp(-np.clip(self.link[0] + self.link[1] * top + self.link[2] * np.log1p(total), -30, 30)))


def _logistic(x: np.ndarray, y: np.ndarray, steps: int = 30, ridge: float = 0.05) -> np.ndarray:
    """Weights of a logistic regression with a small ridge, by Newton steps."""
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (p - y) + ridge * w
        w = w - np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + ridge * np.eye(len(w)), slope)
    return w


def spans_of(text: str, chance: np.ndarray) -> list[dict[str, int]]:
    """Runs of words that are toxic rather than not, as character offsets of the text."""
    out, last, low = [], False, text.lower()
    for m, x in zip(_WORD.finditer(low), chance):
        if x >= 0.5 and last:
            out[-1]["end"] = m.end()
        elif x >= 0.5:
            out.append({"start": m.start(), "end": m.end()})
        last = x >= 0.5
    if out and len(low) != len(text):  # a letter whose lower-case form is longer
        place = [i for i, c in enumerate(text) for _ in c.lower()]
        out = [{"start": place[s["start"]], "end": place[s["end"] - 1] + 1} for s in out]
    return out


def score_toxicity(df: DataFrame, model: Model, text: str = "text", spans: bool = True) -> DataFrame:
    """df with score and predicted (score >= 0.5), and with spans: the offending offsets."""

    def make():
        read = model.reader()

        def f(batch):
            sizes, chance, top, total = read(batch.column(text))
            score = model.score(top, total)
            out = [pa.array(score), pa.array((score >= 0.5).astype(np.int32))]
            if spans:
                texts, ends = batch.column(text), np.cumsum(sizes).tolist()
                found = [spans_of(texts[i].as_py(), chance[b - n : b]) if x >= 0.5 else [] for i, (x, b, n) in enumerate(zip(top.tolist(), ends, sizes.tolist()))]
                out.append(pa.array(found, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))))
            return out

        return f

    span = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
    return append(df, text, [("score", T.DoubleType()), ("predicted", T.IntegerType())] + [("spans", span)] * spans, make, SLICE)


def without_toxic(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The rows of df that the model doesn't predict to be toxic; all columns stay."""

    def make():
        read = model.reader()

        def f(column):
            _, _, top, total = read(column)
            return model.score(top, total) < 0.5

        return f

    return keep(df, text, make, SLICE)
