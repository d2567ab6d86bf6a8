"""Document quality by logistic regression on hashed word n-grams, fitted with FTRL-proximal updates.

A text is a sequence of words and runs of symbols.  Each gives its own n-grams
of one and two, and those of its shape (case, digits, the symbol itself, whether
it repeats its predecessor); all are hashed to BUCKETS numbers.  A feature's
value is its count over the text's length, times SCALE, so that a score is one
sparse dot product.  The fit reads a bounded sample of labelled rows
(`labelled.ROWS`, `labelled.BYTES`) in a fixed order.

A null or empty text has the score of the bias alone.  Without training rows,
or with one label only, every score is that label's share in them, or 1.
A very long text takes memory in proportion to its words.  Repeated rows get equal
scores; an empty table gives an empty result.  Other columns stay; one with the
name of a result is replaced.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from lexquarry.llm.arrow import Lexicon, append, keep, release

BUCKETS, SCALE = 1 << 18, 8.0
#: Bytes of text that are scored at once.
SLICE = 3 << 19
#: FTRL-proximal: rate, its offset, and the weights of the absolute and the squared weights; passes over the sample.
ALPHA, BETA, L1, L2, PASSES = 0.3, 1.0, 1e-3, 1e-3, 4

_TOKEN = re.compile(r"\w+|[^\w\s]+")


def shape(token: str) -> str:
    """Case or kind of a token; short symbols stand for themselves."""
    if not (token[0].isalnum() or token[0] == "_"):
        return token[:3]
    if token.isdigit():
        return "0"
    kind = "A" if token.isupper() else "a" if token.islower() else "Aa"
    return f"{kind}{min(len(token) // 4, 4)}"


def _hash(kind: str, token: str) -> int:
    return xxhash.xxh3_64_intdigest(f"{kind} {token}")


def tokens_of(piece: bytes) -> list[str]:
    return _TOKEN.findall(piece.decode())


def hashes(tokens: list[str]) -> np.ndarray:
    """Two hashes of each token: of its lower-case form and of its shape."""
    return np.array([(_hash("w", t.lower()), _hash("s", shape(t))) for t in tokens], np.uint64).reshape(-1, 2)


class Grams:
    """The hashed n-grams of some texts: for each token its four features."""

    def __init__(self, column: pa.Array, lexicon: Lexicon):
        ids, self.sizes, values = lexicon.read(column)
        n = len(ids)
        again = np.zeros(n, bool)
        again[1:] = ids[1:] == ids[:-1]
        first = np.zeros(n, bool)
        first[(np.cumsum(self.sizes) - self.sizes)[self.sizes > 0]] = True
        again &= ~first
        with np.errstate(over="ignore"):
            word, form = values[ids, 0], values[ids, 1]
            form = form ^ (again.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
            self.buckets = np.stack([_bucket(word), _bucket(form), _pair(word, first), _pair(form, first)])


def _bucket(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return (h >> np.uint64(46)).astype(np.int32) % BUCKETS


def _pair(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    last = np.append(np.zeros(1, np.uint64), h)[: len(h)]
    last[first] = 1
    return _bucket(last * np.uint64(0xD6E8FEB86659FD93) + h)


class Model:
    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias = weights.astype(np.float32), float(bias)

    @classmethod
    def fit(cls, rows: list[tuple[str, int]]) -> "Model":
        y = np.array([label for _, label in rows], float)
        if not rows or y.min() == y.max():
            return cls(np.zeros(BUCKETS), -30.0 if rows and not y.any() else 30.0)
        sparse, lexicon = [], Lexicon(tokens_of, hashes)
        for a in range(0, len(rows), 200):
            grams = Grams(pa.array([t for t, _ in rows[a : a + 200]]), lexicon)
            for b, n in zip(np.cumsum(grams.sizes), grams.sizes):
                at, count = np.unique(grams.buckets[:, b - n : b], return_counts=True)
                sparse.append((np.append(at, BUCKETS).astype(np.int32), np.append(count * (SCALE / max(1, n)), 1.0).astype(np.float32)))
        z, n = np.zeros(BUCKETS + 1), np.zeros(BUCKETS + 1)
        balance = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))

        def weights(at):
            w = -(z[at] - np.sign(z[at]) * L1) / ((BETA + np.sqrt(n[at])) / ALPHA + L2)
            return np.where(np.abs(z[at]) <= L1, 0.0, w)

        for step in range(PASSES):
            for i in np.random.default_rng(step).permutation(len(rows)):
                at, x = sparse[i]
                w = weights(at)
                p = 1 / (1 + np.exp(-np.clip(w @ x, -30, 30)))
                g = (p - y[i]) * balance[i] * x
                z[at] += g - (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA * w
                n[at] += g * g
        w = weights(np.arange(BUCKETS + 1))
        del sparse, lexicon, grams
        release()
        return cls(w[:BUCKETS], w[BUCKETS])

    def score(self, column: pa.Array, lexicon: Lexicon | None = None) -> np.ndarray:
        grams = Grams(column, lexicon or Lexicon(tokens_of, hashes))
        each = self.weights[grams.buckets].sum(0, dtype=np.float64) if grams.sizes.sum() else np.zeros(0)
        total = np.concatenate([[0.0], np.cumsum(each)])
        ends = np.cumsum(grams.sizes)
        dot = (total[ends] - total[ends - grams.sizes]) * SCALE / np.maximum(1, grams.sizes)
        return 1 / (1 + np.exp(-np.clip(dot + self.bias, -30, 30)))


def score_quality(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """df with score and predicted (score >= 0.5)."""

    def make():
        lexicon = Lexicon(tokens_of, hashes)

        def f(batch):
            score = model.score(batch.column(text), lexicon)
            return [pa.array(score), pa.array((score >= 0.5).astype(np.int32))]

        return f

    return append(df, text, [("score", T.DoubleType()), ("predicted", T.IntegerType())], make, SLICE)


def with_quality(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The rows of df that the model predicts to be of good quality; all columns stay."""

    def make():
        lexicon = Lexicon(tokens_of, hashes)
        return lambda column: model.score(column, lexicon) >= 0.5

    return keep(df, text, make, SLICE)
