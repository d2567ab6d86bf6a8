"""Token counts by rank-synchronous array merging.

The distinct pre-tokens of a batch are held as one ragged numpy array of
symbols.  In each step every sequence applies its lowest-rank pair at all of
its places at once; sequences without a pair leave the array.  The surviving
symbols are counted.

A pair that contains a merged symbol always has a later rank than the merge
that made the symbol, so that applying one pair at all its places is what the
one-at-a-time rule gives.

Nulls and empty texts have 0 tokens.  Special strings inside a text are one
token each, as the library's default has it.  Rows pass through as they are,
repeated or not; an empty table gives an empty result.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from lexquarry.llm.arrow import Memo, append, chunks

_NONE = np.int64(1) << 40
_loaded: dict[str, "Counter"] = {}


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in set(own) else chr(next(rest)) for b in range(256)]


class Counter:
    """Counts tokens of a byte-level BPE vocabulary in tokenizers' JSON form."""

    def __init__(self, path: str, pattern: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        self.symbol = np.array([vocab[c] for c in byte_symbols()], np.int64)
        self.base = max(vocab.values()) + 1
        key = np.array([vocab[a] * self.base + vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(key, kind="stable")
        self.key, self.rank = key[order], order
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        self.split = regex.compile(pattern)
        special = [t["content"] for t in spec.get("added_tokens", [])]
        self.special = regex.compile("|".join(regex.escape(s) for s in sorted(special, key=len, reverse=True))) if special else None
        self.memo = Memo()

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left * self.base + right
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        return np.where(self.key[at] == key, self.rank[at], _NONE)

    def merge(self, words: list[bytes]) -> np.ndarray:
        """Surviving symbols of each pre-token; all of them are non-empty."""
        count = np.zeros(len(words), np.int64)
        lens = np.fromiter(map(len, words), np.int64, len(words))
        ids = self.symbol[np.frombuffer(b"".join(words), np.uint8)]
        seq, which = np.repeat(np.arange(len(words)), lens), np.arange(len(words))
        while len(ids):
            first = np.flatnonzero(np.diff(seq, prepend=-1))
            rank = np.full(len(ids), _NONE)
            inside = np.flatnonzero(seq[1:] == seq[:-1])
            rank[inside] = self.ranks(ids[inside], ids[inside + 1])
            lens = np.diff(np.append(first, len(ids)))
            least = np.minimum.reduceat(rank, first)
            live = least < _NONE
            count[which[~live]] = lens[~live]
            chosen = (rank == np.repeat(least, lens)) & np.repeat(live, lens)
            at = np.flatnonzero(chosen)
            if len(at):  # of overlapping places, as in a run of one symbol, every other one counts
                run = np.cumsum(np.diff(at, prepend=-2) != 1)
                at = at[(at - at[np.searchsorted(run, run)]) % 2 == 0]
                ids[at] = self.made[rank[at]]
            keep = np.repeat(live, lens)
            keep[at + 1] = False
            ids = ids[keep]
            seq = (np.cumsum(live) - 1)[seq[keep]] if len(ids) else seq[:0]
            which = which[live]
        return count

    def pieces(self, text: str) -> tuple[list[bytes], int]:
        """Pre-tokens of a text, and its special strings."""
        if self.special is None or not (found := self.special.findall(text)):
            return [w.encode() for w in self.split.findall(text)], 0
        return [w.encode() for part in self.special.split(text) for w in self.split.findall(part)], len(found)

    def learn(self, new: list[bytes]) -> None:
        parts = [self.pieces(w.decode()) for w in new]
        distinct = list({p for ps, _ in parts for p in ps})
        n = dict(zip(distinct, self.merge(distinct).tolist() if distinct else []))
        for w, (ps, special) in zip(new, parts):
            self.memo[w] = special + sum(n[p] for p in ps)

    def count(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        c = chunks(column)
        new = [w for w in c.words if w not in self.memo]
        self.memo.room(len(c.words))
        if len(new) < len(c.words) and not self.memo:
            new = c.words
        for at in range(0, len(new), 50_000):
            self.learn(new[at : at + 50_000])
        per = np.fromiter(map(self.memo.__getitem__, c.words), np.int64, len(c.words))
        return c.size, c.per_text(per)


def count_tokens(df: DataFrame, path: str, pattern: str, text: str = "text", limit: int = 512) -> DataFrame:
    """df with n_bytes, n_tokens and over_limit (n_tokens > limit) of the column `text`."""

    def make():
        counter = _loaded.get(path) or _loaded.setdefault(path, Counter(path, pattern))

        def f(batch):
            size, n = counter.count(batch.column(text))
            return [size.astype(np.int64), n, n > limit]

        return f

    return append(df, text, [("n_bytes", T.LongType()), ("n_tokens", T.LongType()), ("over_limit", T.BooleanType())], make)
