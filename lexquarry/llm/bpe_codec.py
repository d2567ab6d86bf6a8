"""Byte-level BPE encoding and decoding by recursive DuckDB queries.

Each task holds the pre-tokens of its partition that it has not met yet as
rows (word, position, next position, token).  A recursive query joins neighbouring
tokens to the merge table and contracts every word's leftmost pair of minimum rank, round
by round, until no word has a pair.  A word that is itself a token is one row with
that token from the start, as in tiktoken.  A text is the sequence of its words, so
its ids are those of its words, one after another; an ordered aggregation of the
ids of whole texts over the vocabulary's bytes decodes them.

A word has no more rounds than bytes, so the rows of all rounds of a query are
bounded by ROWS if no word in it is longer than WINDOW.  A longer word enters as
windows that overlap, each a word of its own.  A sequence of tokens is the encoding
of its bytes if every two neighbours are the encoding of theirs: the first contraction
over a wrong border would be one of the two tokens beside it as well.  So two windows
are joined at a token that both have at the same place; where there is none, the
next window is encoded again from a border of the tokens before it.

Nulls and empty texts have no ids and decode to nothing.  Very long texts and words
take time in proportion to their length.  Rows pass through, repeated or not, with
all other columns; a column that has the name of a result is replaced.  An empty
table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
from itertools import islice

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from lexquarry.llm.arrow import append, chunks, gather

#: Bytes of new words, and rows of all of their rounds, that one recursive query takes on.
QUERY_BYTES, ROWS = 150_000, 1_500_000
#: Bytes of the longest word that enters a query whole; bytes from one window of a longer word to the next.
WINDOW, STEP = 128, 96
#: Words that a worker remembers before it starts afresh, at about 40 bytes each.
WORDS = 600_000
#: Bytes of text that are encoded at once, and ids that are decoded at once.
SLICE, DECODED = 2 << 20, 400_000
#: Memory of a worker's database, which never writes to disk.
MEMORY = "160MB"

_ENCODE = """
WITH RECURSIVE state(round, word, pos, next, token) AS (
    SELECT 0::SMALLINT, word, pos, next, token FROM seed
  UNION ALL (
    WITH chosen AS (
        SELECT a.word, min(m.made * 4294967296 + a.pos) AS best,
               arg_min(b.pos, m.made * 4294967296 + a.pos) AS gone, arg_min(b.next, m.made * 4294967296 + a.pos) AS after
        FROM state a JOIN state b ON b.pos = a.next JOIN merges m ON m.pair = a.token::BIGINT * {size} + b.token
        GROUP BY a.word
    )
    SELECT (s.round + 1)::SMALLINT, s.word, s.pos,
           CASE WHEN s.pos = c.best % 4294967296 THEN c.after ELSE s.next END::INTEGER,
           CASE WHEN s.pos = c.best % 4294967296 THEN c.best // 4294967296 ELSE s.token END::INTEGER
    FROM state s JOIN chosen c ON c.word = s.word
    WHERE s.pos <> c.gone
  )
)
SELECT s.word, s.token
FROM state s
JOIN (SELECT word, max(round) AS round FROM state GROUP BY word) l ON l.word = s.word AND l.round = s.round
ORDER BY s.pos
"""

_DECODE = """
SELECT t.text, string_agg(v.hex, '' ORDER BY t.pos) AS hex
FROM tokens t JOIN vocabulary v ON v.token = t.token
GROUP BY t.text
"""

_loaded: dict[str, "Codec"] = {}


class Known:
    """Tokens of words by 128-bit hashes, in arrays; a bounded memory of a worker, whose loss costs time only."""

    def __init__(self):
        self.clear()

    def clear(self) -> None:
        self.low, self.high = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        self.first, self.count, self.tokens = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def find(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The place of each word, or -1."""
        if not len(self.low):
            return np.full(len(low), -1)
        at = np.minimum(np.searchsorted(self.low, low), len(self.low) - 1)
        return np.where((self.low[at] == low) & (self.high[at] == high), at, -1)

    def add(self, low: np.ndarray, high: np.ndarray, tokens: np.ndarray, count: np.ndarray) -> None:
        first = np.cumsum(count) - count + len(self.tokens)
        merged = [np.concatenate(x) for x in ((self.low, low), (self.high, high), (self.first, first), (self.count, count))]
        order = np.argsort(merged[0], kind="stable")
        self.low, self.high, self.first, self.count = (x[order] for x in merged)
        self.tokens = np.concatenate([self.tokens, tokens])


class Codec:
    """Encodes texts by a file of base64 tokens and their ranks."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.split = regex.compile(pattern)
        self.symbol = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        size = max(self.ranks.values()) + 1
        self.length = np.zeros(size, np.int64)
        for t, r in self.ranks.items():
            self.length[r] = len(t)
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": MEMORY, "temp_directory": ""})
        made = [(self.ranks[t[:i]] * size + self.ranks[t[i:]], r) for t, r in self.ranks.items() for i in range(1, len(t)) if t[:i] in self.ranks and t[i:] in self.ranks]
        merges = pa.table({"pair": pa.array([p for p, _ in made], pa.int64()), "made": pa.array([r for _, r in made], pa.int64())})
        vocabulary = pa.table({"token": pa.array(list(self.ranks.values()), pa.int32()), "hex": [t.hex() for t in self.ranks]})
        for name, table in (("merges", merges), ("vocabulary", vocabulary)):
            self.db.register("given", table)
            self.db.execute(f"CREATE TABLE {name} AS SELECT * FROM given")
            self.db.unregister("given")
        self.query = _ENCODE.format(size=size)
        self.words = Known()

    def _ask(self, name: str, table: pa.Table, query: str) -> dict[str, np.ndarray]:
        self.db.register(name, table)
        out = self.db.execute(query).fetchnumpy()
        self.db.unregister(name)
        return out

    def contract(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of some non-empty words, one after another, and their number for each word; one that is a token starts whole."""
        known = [self.ranks.get(w) for w in words]
        lens = np.array([len(w) if k is None else 1 for w, k in zip(words, known)], np.int64)
        ends = np.cumsum(lens)
        pos = np.arange(ends[-1], dtype=np.int32)
        follow = pos + np.int32(1)
        follow[ends - 1] = -1
        whole = np.array([k is not None for k in known])
        token = np.empty(ends[-1], np.int32)
        token[np.repeat(~whole, lens)] = self.symbol[np.frombuffer(b"".join([w for w, k in zip(words, known) if k is None]), np.uint8)]
        token[(ends - 1)[whole]] = [k for k in known if k is not None]
        got = self._ask("seed", pa.table({"word": np.repeat(np.arange(len(words), dtype=np.int32), lens), "pos": pos, "next": follow, "token": token}), self.query)
        return np.asarray(got["token"], np.int32), np.bincount(got["word"], minlength=len(words))

    def batches(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """contract() of many words, none longer than WINDOW but where it is alone, in queries of bounded size."""
        out, at = [], 0
        while at < len(words):
            to, size, rows = at, 0, 0
            while to < len(words) and (to == at or size + len(words[to]) <= QUERY_BYTES and rows + len(words[to]) ** 2 // 2 <= ROWS):
                size, rows = size + len(words[to]), rows + len(words[to]) ** 2 // 2
                to += 1
            out.append(self.contract(words[at:to]))
            at = to
        return np.concatenate([t for t, _ in out]), np.concatenate([c for _, c in out])

    def long_word(self, word: bytes) -> np.ndarray:
        """Tokens of a word of more than WINDOW bytes."""
        starts = range(0, max(1, len(word) - WINDOW + STEP), STEP)
        number = {w: i for i, w in enumerate(dict.fromkeys(word[a : a + WINDOW] for a in starts))}
        flat, count = self.batches(list(number))
        parts = np.split(flat, np.cumsum(count)[:-1])
        tokens, ends = [], []  # of the word up to some place, and where each token ends
        for a in starts:
            ends = self._join(tokens, ends, parts[number[word[a : a + WINDOW]]], a, word)
        return np.array(tokens, np.int32)

    def _join(self, tokens: list[int], ends: list[int], part: np.ndarray, a: int, word: bytes) -> list[int]:
        """Continues a word's tokens by those of the window that starts at `a`."""
        stop = a + np.cumsum(self.length[part])
        own = {(e, t): i for i, (e, t) in enumerate(islice(zip(reversed(ends), reversed(tokens)), WINDOW))}
        place = next((j for j, x in enumerate(zip(stop.tolist(), part.tolist())) if x in own), None) if tokens else -1
        back = 2
        while place is None:  # no token in common: again from a border of the tokens before
            back = min(2 * back, len(ends))
            a = ends[-back - 1] if back < len(ends) else 0
            part, _ = self.contract([word[a : a + (ends[-1] - a) + WINDOW]])
            stop = a + np.cumsum(self.length[part])
            if back == len(ends):
                del tokens[:], ends[:]
                place, own = -1, {}
            else:
                own = {(e, t): i for i, (e, t) in enumerate(islice(zip(reversed(ends), reversed(tokens)), back))}
                place = next((j for j, x in enumerate(zip(stop.tolist(), part.tolist())) if x in own), None)
        if place >= 0:
            keep = len(tokens) - own[stop.tolist()[place], part.tolist()[place]]
            del tokens[keep:], ends[keep:]
        tokens.extend(part.tolist()[place + 1 :])
        ends.extend(stop.tolist()[place + 1 :])
        return ends

    def lookup(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first, number) in the tokens of each of some distinct words, and the tokens."""
        hashes = np.frombuffer(b"".join([xxhash.xxh3_128_digest(w) for w in words]), np.uint64).reshape(-1, 2)
        high, low = np.ascontiguousarray(hashes[:, 0]), np.ascontiguousarray(hashes[:, 1])
        at = self.words.find(low, high)
        if len(self.words.low) + int((at < 0).sum()) > WORDS:
            self.words.clear()
            at = np.full(len(words), -1)
        fresh = np.flatnonzero(at < 0)
        if len(fresh):
            lens = np.fromiter(map(len, words), np.int64, len(words))[fresh]
            fresh = fresh[np.argsort(lens, kind="stable")]  # words of one length have their rounds in common
            short = [words[i] for i in fresh if len(words[i]) <= WINDOW]
            tokens, count = self.batches(short) if short else (np.zeros(0, np.int32), np.zeros(0, np.int64))
            rest = [self.long_word(words[i]) for i in fresh[len(short) :]]
            tokens = np.concatenate([tokens, *rest])
            count = np.concatenate([count, np.array([len(r) for r in rest], np.int64)])
            self.words.add(low[fresh], high[fresh], tokens, count)
            at = self.words.find(low, high)
            if (at < 0).any():  # two words of this slice whose 64 low bits agree
                self.words.clear()
                one = self.batches(words) if max(map(len, words)) <= WINDOW else [self.long_word(w) if len(w) > WINDOW else self.contract([w])[0] for w in words]
                tokens, count = one if isinstance(one, tuple) else (np.concatenate(one), np.array(list(map(len, one))))
                return np.cumsum(count) - count, count, tokens
        return self.words.first[at], self.words.count[at], self.words.tokens

    def ids(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of some texts, one after another, and where those of each text end; the first is 0."""
        c = chunks(column)
        parts = [self.split.findall(p.decode()) for p in c.words]
        number: dict[str, int] = {}
        flat = np.array([number.setdefault(w, len(number)) for ps in parts for w in ps], np.int64)
        if not len(flat):
            return np.zeros(0, np.int32), np.zeros(len(column) + 1, np.int64)
        count = np.fromiter(map(len, parts), np.int64, len(parts))
        first, size, tokens = self.lookup([w.encode() for w in number])
        sequence = flat[gather(np.cumsum(count) - count, count, c.codes)]
        words = np.concatenate([[0], np.cumsum(c.per_text(count))])
        ends = np.concatenate([[0], np.cumsum(size[sequence])])[words]
        return tokens[gather(first, size, sequence)], ends

    def decode(self, ids: np.ndarray, ends: np.ndarray) -> list[bytes]:
        """The bytes of each text, from its ids alone."""
        out = [b""] * (len(ends) - 1)
        text = np.repeat(np.arange(len(out), dtype=np.int32), np.diff(ends))
        for a in range(0, len(ids), DECODED):
            b = min(a + DECODED, len(ids))
            got = self._ask("tokens", pa.table({"text": text[a:b], "pos": np.arange(b - a, dtype=np.int32), "token": ids[a:b]}), _DECODE)
            for i, data in zip(got["text"].tolist(), got["hex"].tolist()):
                out[i] += bytes.fromhex(data)
        return out


    def encode(self, column: pa.Array) -> list[tuple[int, str, bytes]]:
        """(number of ids, ids as decimal text, decoded bytes) of each text."""
        ids, ends = self.ids(column)
        return [(int(n), t.as_py(), b) for n, t, b in zip(np.diff(ends), decimal(ids, ends), self.decode(ids, ends))]


def decimal(ids: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The ids of each text as decimal numbers joined by commas."""
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pc.cast(pa.array(ids), pa.string())), ",")


def _codec(path: str, pattern: str) -> Codec:
    return _loaded.get(path) or _loaded.setdefault(path, Codec(path, pattern))


def _sha256(parts) -> pa.Array:
    return pa.array([hashlib.sha256(p).hexdigest() for p in parts], pa.string())


def _results(df: DataFrame, path: str, pattern: str, text: str, fields: list[tuple[str, T.DataType]], arrays) -> DataFrame:
    """df with what arrays(codec, ids, ends) gives for each slice."""

    def make():
        codec = _codec(path, pattern)
        return lambda batch: arrays(codec, *codec.ids(batch.column(text)))

    return append(df, text, fields, make, SLICE)


def _lists(ids: np.ndarray, ends: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids, pa.int32()))


def encode_decode(df: DataFrame, path: str, pattern: str, text: str = "text") -> DataFrame:
    """df with token_ids (array of int) and decoded (string) of the column `text`."""
    fields = [("token_ids", T.ArrayType(T.IntegerType())), ("decoded", T.StringType())]
    return _results(df, path, pattern, text, fields, lambda codec, ids, ends: [_lists(ids, ends), pa.array([b.decode() for b in codec.decode(ids, ends)], pa.string())])


def encode_ids(df: DataFrame, path: str, pattern: str, text: str = "text") -> DataFrame:
    """df with token_ids and decoded_sha256, the digest of what they decode to."""
    fields = [("token_ids", T.ArrayType(T.IntegerType())), ("decoded_sha256", T.StringType())]
    return _results(df, path, pattern, text, fields, lambda codec, ids, ends: [_lists(ids, ends), _sha256(codec.decode(ids, ends))])


def encode_digests(df: DataFrame, path: str, pattern: str, text: str = "text") -> DataFrame:
    """df with n_tokens, ids_sha256 (of the decimal ids joined by commas) and decoded_sha256."""

    def arrays(codec, ids, ends):
        return [pa.array(np.diff(ends), pa.int64()), _sha256(s.as_buffer() for s in decimal(ids, ends)), _sha256(codec.decode(ids, ends))]

    return _results(df, path, pattern, text, [("n_tokens", T.LongType()), ("ids_sha256", T.StringType()), ("decoded_sha256", T.StringType())], arrays)
