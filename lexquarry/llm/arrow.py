"""Arrow plumbing shared by the text operators.

`append` runs a batch function beside a DataFrame's own columns.  `chunks`
dictionary-encodes the white-space delimited pieces of a column of texts, so
that the per-word work of an operator is done once for each distinct piece of
a slice instead of once for each occurrence; a `Lexicon` remembers what it did
for a bounded number of pieces.

Batches between the JVM and the workers are bounded in bytes as well as in rows
(`small_batches`), and workers hand freed memory back (`release`), since two
workers and two tasks of the JVM share an executor's memory.
"""

from __future__ import annotations

import ctypes
import math
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

#: Bytes of text that are held in numpy form at once, unless one text is longer.
SLICE_BYTES = 6 << 20
#: Entries that a worker's word memo may hold before it starts afresh.
MEMO_WORDS = 600_000
#: Pieces that a Lexicon remembers before it starts afresh, at about 250 bytes each.
PIECES = 150_000
#: Bytes of text after which a worker hands back what it has freed.
RELEASE_BYTES = 8 << 20
#: Settings of a session that has Spark's defaults for them: bytes of an Arrow batch, rows of a batch of the Parquet reader.
BATCHES = {"spark.sql.execution.arrow.maxBytesPerBatch": ("67108864b", "4m"), "spark.sql.parquet.columnarReaderBatchSize": ("4096", "1024")}

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def small_batches(spark: SparkSession) -> None:
    """Bounds the batches of texts that are in memory at once; a session's own settings stay."""
    for key, (default, ours) in BATCHES.items():
        if spark.conf.get(key, default) == default:
            spark.conf.set(key, ours)


_libc = ctypes.CDLL(None)


def hold() -> None:
    """Lets this worker keep freed memory until release(), where the C library can; a fresh page for every passing array takes time."""
    if hasattr(_libc, "mallopt"):
        _libc.mallopt(-3, 32 << 20)  # M_MMAP_THRESHOLD
        _libc.mallopt(-1, 256 << 20)  # M_TRIM_THRESHOLD


def release() -> None:
    """Hands freed memory back to the system, where the C library can."""
    pa.default_memory_pool().release_unused()
    if hasattr(_libc, "malloc_trim"):
        _libc.malloc_trim(0)


class Memo(dict):
    """A bounded word memo.  It lives as long as the Python worker; losing it costs time only."""

    def room(self, extra: int) -> None:
        if self and len(self) + extra > MEMO_WORDS:
            self.clear()


class Chunks:
    """words: the distinct pieces; codes: a piece number for each occurrence; doc: the
    offsets of each text's occurrences; size: UTF-8 bytes of each text."""

    __slots__ = ("words", "codes", "doc", "size")

    def __init__(self, words, codes, doc, size):
        self.words, self.codes, self.doc, self.size = words, codes, doc, size

    def per_text(self, value: np.ndarray) -> np.ndarray:
        """Sums a number of each distinct piece over each text."""
        total = np.concatenate([[0], np.cumsum(value[self.codes])])
        return total[self.doc[1:]] - total[self.doc[:-1]]


def plain(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, one after another, and their offsets.  A null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(column: pa.Array, lower: str = "", blank: bool = False, signs: bytes = b"") -> Chunks:
    """Cuts every text where white space follows something else.

    With `blank`, ASCII white space is made a space; with lower="all", A-Z are
    made lower case, with lower="ascii" only before another ASCII character, so
    that no letter before a combining mark changes; with `signs`, a text is cut
    between an ASCII letter and one of these as well.

    A piece is a run of white space and the run of other characters behind it.
    A cut is made only before ASCII white space whose predecessor is surely no
    white space of any script; a missed cut makes a longer piece, nothing else.
    """
    data, offsets = plain(column)
    size = np.diff(offsets)
    if not len(data):
        return Chunks([], np.zeros(0, np.int32), np.zeros(len(offsets), np.int64), size)
    space = _SPACE[data]
    cut = np.zeros(len(data), bool)
    cut[1:] = space[1:] & ~space[:-1]
    high = np.flatnonzero(cut[1:] & (data[:-1] >= 0x80)) + 1
    if len(high):
        two, three = data[np.maximum(high - 2, 0)], data[np.maximum(high - 3, 0)]
        cut[high[(two == 0xC2) | ((three >= 0xE1) & (three <= 0xE3))]] = False
    cut[offsets[:-1][size > 0]] = True
    if blank:
        data = np.where(space, np.uint8(32), data)
    if lower or signs:
        capital = data - np.uint8(65) < 26
    if signs:
        sign = np.zeros(256, bool)
        sign[list(signs)] = True
        cut[1:] |= sign[data[1:]] & (capital | (data - np.uint8(97) < 26))[:-1]
    if lower == "ascii":
        capital[:-1] &= data[1:] < 0x80
    if lower:
        data = np.where(capital, data + np.uint8(32), data)
    starts = np.flatnonzero(cut)
    ends = np.append(starts, len(data)).astype(np.int32)
    pieces = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(data))])
    coded = pieces.dictionary_encode()
    return Chunks(coded.dictionary.to_pylist(), coded.indices.to_numpy(), np.searchsorted(starts, offsets), size)


def gather(first: np.ndarray, count: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Positions in a ragged array of the values of each code, one code after another."""
    lens = count[codes]
    ends = np.cumsum(lens)
    total = int(ends[-1]) if len(ends) else 0
    return np.repeat(first[codes] - (ends - lens), lens) + np.arange(total)


def distinct(columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An order of the rows, where distinct ones start in it, and the distinct row that each row is."""
    low = [int(c.min(initial=0)) for c in columns]
    span = [int(c.max(initial=0)) - a + 1 for c, a in zip(columns, low)]
    if math.prod(span) < 1 << 63:  # one number tells the rows apart
        key = np.zeros(len(columns[0]), np.int64)
        for c, a, n in zip(columns, low, span):
            key = key * n + (c - a)
        columns, order = [key], np.argsort(key)
    else:
        order = np.lexsort(columns[::-1])
    new = np.zeros(len(order), bool)
    new[:1] = True
    for c in columns:
        s = c[order]
        new[1:] |= s[1:] != s[:-1]
    inverse = np.empty(len(order), np.int64)
    inverse[order] = np.cumsum(new) - 1
    return order, np.flatnonzero(new), inverse


class Lexicon:
    """The words of texts as numbers, and a row of values for each word.

    split() gives the words of a piece, describe() a row of values for each of
    some new words.  Both are asked once for a piece or word, until `most` pieces
    are remembered.
    """

    def __init__(self, split: Callable[[bytes], list[str]], describe: Callable[[list[str]], np.ndarray], most: int = PIECES):
        self.split, self.describe, self.most = split, describe, most
        self.clear()

    def clear(self) -> None:
        self.pieces: dict[bytes, tuple[int, ...]] = {}
        self.number: dict[str, int] = {}
        self.values = None

    def read(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Number of each word, one text after another; words of each text; values by number."""
        c = chunks(column)
        if self.pieces and len(self.pieces) + len(c.words) > self.most:
            self.clear()
        pieces, number, known, parts = self.pieces, self.number, len(self.number), []
        for w in c.words:
            p = pieces.get(w)
            if p is None:
                p = pieces[w] = tuple([number.setdefault(x, len(number)) for x in self.split(w)])
            parts.append(p)
        new = list(number)[known:]
        if new or self.values is None:
            rows = self.describe(new)
            self.values = rows if self.values is None else np.concatenate([self.values, rows])
        count = np.fromiter(map(len, parts), np.int64, len(parts))
        flat = np.fromiter(chain.from_iterable(parts), np.int32, int(count.sum()))
        return flat[gather(np.cumsum(count) - count, count, c.codes)], c.per_text(count), self.values


def slices(batch: pa.RecordBatch, column: int, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with at most so many bytes of text, or a single row."""
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends, at = np.cumsum(size), 0
    while at < len(size):
        before = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + most, side="right")))
        yield batch.slice(at, to - at)
        at = to


def released(batches: Iterator[pa.RecordBatch], column: int, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The slices of all batches of a task, with freed memory handed back now and then and at the end."""
    held = 0
    for batch in batches:
        for part in slices(batch, column, most):
            yield part
            held += part.nbytes
            if held > RELEASE_BYTES:
                held = 0
                release()
    release()


def joined(batches: Iterator[pa.RecordBatch], column: int, most: int) -> Iterator[pa.RecordBatch]:
    """Batches of about so many bytes, or a single row, of the batches of a task."""
    held, size = [], 0
    for batch in batches:
        for part in slices(batch, column, most):
            if held and size + part.nbytes > most:
                yield pa.concat_batches(held)
                held, size = [], 0
            held.append(part)
            size += part.nbytes
    if held:
        yield pa.concat_batches(held)


def append(df: DataFrame, text: str, fields: list[tuple[str, T.DataType]], make: Callable[[], Callable[[pa.RecordBatch], list]], most: int = SLICE_BYTES) -> DataFrame:
    """df with new columns computed from slices of its batches; a column of the same name is replaced.

    make() is called once in each task and returns the function of a slice
    (its text is in the column `text`) that gives one array for each field.
    """
    names = {n for n, _ in fields}
    kept = [c for c in df.columns if c not in names or c == text]
    hidden = {c: f"__in_{c}" for c in kept if c in names}  # the text itself may have the name of a result
    src = df.select(*[df[c].alias(hidden.get(c, c)) for c in kept])
    out = T.StructType([f for f in src.schema.fields if f.name not in hidden.values()] + [T.StructField(n, t) for n, t in fields])
    source, drop = hidden.get(text, text), set(hidden.values())
    at = src.columns.index(source)

    def run(batches):
        f = make()
        for part in released(batches, at, most):
            arrays = f(part.rename_columns([text if n == source else n for n in part.schema.names]))
            keep = [(n, c) for n, c in zip(part.schema.names, part.columns) if n not in drop]
            yield pa.RecordBatch.from_arrays([c for _, c in keep] + [a if isinstance(a, pa.Array) else pa.array(a) for a in arrays], names=[n for n, _ in keep] + [n for n, _ in fields])

    small_batches(df.sparkSession)
    return src.mapInArrow(run, out)


def keep(df: DataFrame, text: str, make: Callable[[], Callable[[pa.Array], np.ndarray]], most: int = SLICE_BYTES) -> DataFrame:
    """The rows of df, with all of their columns, for whose text the function that make() returns says true."""

    at = df.columns.index(text)

    def run(batches):
        f = make()
        for part in released(batches, at, most):
            yield part.filter(pa.array(f(part.column(at)), pa.bool_()))

    small_batches(df.sparkSession)
    return df.mapInArrow(run, df.schema)
