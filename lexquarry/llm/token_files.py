"""Token-id files: canonical Huffman codes of ids, in ascending order of documents.

A file set has two tables, both written by Spark so that any file system of the
cluster serves and a lost executor's tasks run again:

`codebook`  (symbol, length): the canonical code, from the counts of all ids.
`segments`  (shard, segment, doc_ids, sizes, bits, payload): the documents of a
            shard in ascending doc_id, `sizes` ids each, in independent blocks of
            BLOCK ids whose bit lengths are `bits`.

Shards are ranges of doc_id, so that segments ordered by (shard, segment) are in
document order.  Rows of one doc_id keep together and are ordered by their ids;
a null doc_id comes first; a null text is an empty one and has the end id only;
an empty table gives no segments.  Only the two named columns are read.
"""

from __future__ import annotations

import os
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexquarry.llm import huffman
from lexquarry.llm.arrow import MEMO_WORDS, Memo, chunks, gather, plain, slices
from lexquarry.sources.scratch import scratch

#: Rows of a shard, as long as the table has no more than SHARDS times as many.
SHARD_ROWS, SHARDS = 2048, 20_000
#: Ids of a segment; a longer document is a segment by itself.
SEGMENT_IDS = 1 << 19
#: Words that are encoded in one call.
LINE = 256

_ENCODED = "doc_id long, shard long, n_tokens long, ids binary"
_SEGMENTS = "shard long, segment int, doc_ids array<long>, sizes array<int>, bits array<int>, payload binary"
#: Signs that this family of tokenizers never joins with the letters before them.
_SIGNS = b".,;:!?*#%&$|)"
_loaded: dict[str, "Encoder"] = {}


class Encoder:
    """Encodes texts by the tokenizers library, each distinct word once.

    White space is a boundary of this family of tokenizers and is dropped, so a
    text's ids are those of its pieces, one after another; and signs behind
    ASCII letters are words of their own.  Words of letters alone are encoded
    many at a time, and told apart by the ids that end a word.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        vocab = self.tokenizer.get_vocab()
        self.kind = np.dtype("<u2" if max(vocab.values()) < 1 << 16 else "<u4")
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for w, i in vocab.items() if w.endswith("</w>")]] = True
        self.special = [t.content.encode().lower() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.memo = Memo()

    def learn(self, new: list[str]) -> None:
        letters, rest = [w for w in new if w.isalpha()], [w for w in new if not w.isalpha()]
        lines = [letters[a : a + LINE] for a in range(0, len(letters), LINE)]
        for line, e in zip(lines, self.tokenizer.encode_batch_fast([" ".join(line) for line in lines], add_special_tokens=False)):
            ids = np.array(e.ids, self.kind)
            stops = ((np.flatnonzero(self.ends[ids]) + 1) * self.kind.itemsize).tolist()
            if len(stops) == len(line):
                data = ids.tobytes()
                self.memo.update(zip(line, [data[a:b] for a, b in zip([0, *stops], stops)]))
            else:
                rest += line
        for w, e in zip(rest, self.tokenizer.encode_batch_fast(rest, add_special_tokens=False)):
            self.memo[w] = np.array(e.ids, self.kind).tobytes()

    def encode(self, column: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids with an end id behind each text, and the number of ids of each."""
        text = plain(column)[0].tobytes().lower()
        if any(s in text for s in self.special):  # these strings count as they stand, in their own case
            c = chunks(column)
        else:
            c = chunks(column, lower="ascii", blank=True, signs=_SIGNS)
        words = [w.strip(b" \t\n\v\f\r").decode() for w in c.words]
        new = {w for w in words if w not in self.memo}
        if len(self.memo) + len(new) > MEMO_WORDS:
            self.memo.clear()
            new = set(words)
        self.learn(list(new))
        got = list(map(self.memo.__getitem__, words))
        count = np.fromiter(map(len, got), np.int64, len(got)) // self.kind.itemsize
        flat = np.frombuffer(b"".join(got), self.kind)
        sizes = c.per_text(count) + 1
        out = np.full(int(sizes.sum()), end, self.kind)
        inner = np.ones(len(out), bool)
        inner[np.cumsum(sizes) - 1] = False
        out[inner] = flat[gather(np.cumsum(count) - count, count, c.codes)]
        return out, sizes


def _encoder(path: str) -> Encoder:
    return _loaded.get(path) or _loaded.setdefault(path, Encoder(path))


def encode(df: DataFrame, path: str, end: int, bounds: list[int]) -> DataFrame:
    """(doc_id, shard, n_tokens, ids) of (doc_id, text); ids are packed unsigned integers."""

    def run(batches):
        encoder, edges = _encoder(path), np.array(bounds, np.int64)
        for batch in batches:
            for part in slices(batch, 1):
                ids, sizes = encoder.encode(part.column(1), end)
                ends = np.concatenate([[0], np.cumsum(sizes)]) * encoder.kind.itemsize
                doc = part.column(0)
                shard = np.searchsorted(edges, pc.fill_null(doc, 0).to_numpy(zero_copy_only=False), side="right")
                shard[doc.is_null().to_numpy(zero_copy_only=False)] = -1
                packed = pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(ids)])
                yield pa.RecordBatch.from_arrays([doc, pa.array(shard, pa.int64()), pa.array(sizes), packed], names=["doc_id", "shard", "n_tokens", "ids"])

    return df.mapInArrow(run, _ENCODED)


def id_counts(encoded: DataFrame, kind: np.dtype) -> DataFrame:
    """(symbol, n) over all ids: an array of counts in each task, then one sum for each symbol."""

    def run(batches):
        total = np.zeros(0, np.int64)
        for batch in batches:
            for part in slices(batch, 0):
                ids = np.frombuffer(b"".join(part.column(0).to_pylist()), kind)
                n = np.bincount(ids, minlength=len(total)).astype(np.int64)
                n[: len(total)] += total
                total = n
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int64)), pa.array(total[used])], names=["symbol", "n"])

    return encoded.select("ids").mapInArrow(run, "symbol long, n long").groupBy("symbol").agg(F.sum("n").alias("n"))


def segments(encoded: DataFrame, kind: np.dtype, lengths: np.ndarray) -> DataFrame:
    """Packs rows that are in the order (shard, doc_id, ids) within each partition."""

    def run(batches):
        codes = huffman.codes_of(lengths)

        def close(shard, k, docs, sizes, parts):
            ids = np.concatenate(parts)
            payload, bits = huffman.pack(ids, lengths, codes)
            return pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int64()), "segment": pa.array([k], pa.int32()), "doc_ids": pa.array([docs], pa.list_(pa.int64())), "sizes": pa.array([sizes], pa.list_(pa.int32())), "bits": pa.array([bits.astype(np.int32)], pa.list_(pa.int32())), "payload": pa.array([payload], pa.binary())})

        shard, k, held, docs, sizes, parts = None, 0, 0, [], [], []
        for batch in batches:
            for doc, at, n, ids in zip(*(batch.column(i) for i in range(4))):
                at, n = at.as_py(), n.as_py()
                if docs and (at != shard or held + n > SEGMENT_IDS):
                    yield close(shard, k, docs, sizes, parts)
                    k, held, docs, sizes, parts = (k + 1 if at == shard else 0), 0, [], [], []
                shard, held = at, held + n
                docs.append(doc.as_py())
                sizes.append(n)
                parts.append(np.frombuffer(ids.as_buffer(), kind))
        if docs:
            yield close(shard, k, docs, sizes, parts)

    return encoded.mapInArrow(run, _SEGMENTS)


def write(spark: SparkSession, df: DataFrame, path: str, end: int, to: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Encodes df(doc_id, text) by the tokenizer file at `path`; returns (segments, codebook) as read from their files."""
    files, kind = scratch(spark), _encoder(path).kind
    df = df.select(F.col("doc_id").cast("long"), "text")
    rows = df.count()
    n = min(SHARDS, -(-rows // SHARD_ROWS))
    bounds = sorted(set(df.approxQuantile("doc_id", [i / n for i in range(1, n)], 0.2 / n))) if n > 1 else []
    encoded = files.keep(encode(df, path, end, [int(b) for b in bounds]), "token-ids", compression="zstd")
    counted = id_counts(encoded, kind).collect()  # as many rows as the vocabulary has, at most
    counts = np.zeros(max([0, *(r["symbol"] for r in counted)]) + 1, np.int64)
    for r in counted:
        counts[r["symbol"]] = r["n"]
    lengths = huffman.code_lengths(counts)
    codebook = spark.createDataFrame([(int(s), int(lengths[s])) for s in np.flatnonzero(lengths)], "symbol int, length int")
    dealt = encoded.repartition(max(n, 1), "shard").sortWithinPartitions("shard", "doc_id", "ids")
    out = files.keep(segments(dealt, kind, lengths), "token-files", to=to and f"{to}/segments"), files.keep(codebook.coalesce(1), "token-codebook", to=to and f"{to}/codebook")
    files.drop(encoded)
    return out


def read(segments: DataFrame, codebook: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, ids) of a file set; `ids` is an array of int."""
    return _documents(segments, codebook, ids=True)


def digests(segments: DataFrame, codebook: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of a file set."""
    return _documents(segments, codebook, ids=False)


def _documents(segments: DataFrame, codebook: DataFrame, ids: bool) -> DataFrame:
    lengths = np.zeros(1, np.uint8)
    for r in codebook.collect():  # bounded by the vocabulary
        if r["symbol"] >= len(lengths):
            lengths = np.append(lengths, np.zeros(r["symbol"] + 1 - len(lengths), np.uint8))
        lengths[r["symbol"]] = r["length"]

    def run(batches):
        table, most = huffman.table_of(lengths)
        for batch in batches:
            for shard, segment, docs, sizes, bits, payload in zip(*(batch.column(i) for i in range(6))):
                sizes = np.array(sizes.as_py(), np.int64)
                got = huffman.unpack(payload.as_py(), np.array(bits.as_py(), np.int64), int(sizes.sum()), table, most).astype("<u4")
                ends = np.cumsum(sizes)
                out = {
                    "doc_id": pa.array(docs.as_py(), pa.int64()),
                    "shard": pa.array([shard.as_py()] * len(sizes), pa.int64()),
                    "segment": pa.array([segment.as_py()] * len(sizes), pa.int32()),
                    "inside": pa.array(ends - sizes),
                    "n_tokens": pa.array(sizes),
                    "ids_crc32": pa.array([zlib.crc32(got[b - n : b].tobytes()) for b, n in zip(ends.tolist(), sizes.tolist())], pa.int64()),
                }
                if ids:
                    out["ids"] = pa.array([got[b - n : b].astype(np.int32) for b, n in zip(ends.tolist(), sizes.tolist())], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_pydict(out)

    schema = "doc_id long, shard long, segment int, inside long, n_tokens long, ids_crc32 long" + ", ids array<int>" * ids
    # Two levels of running sums: over the segments of a shard, and over the shards, of which there are SHARDS at most.
    size = segments.select("shard", "segment", F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x).alias("n"))
    per_shard = size.groupBy("shard").agg(F.sum("n").alias("n"))
    before_shard = per_shard.select("shard", F.coalesce(F.sum("n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before_shard"))
    before = size.select("shard", "segment", F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    starts = before.join(before_shard, "shard")
    rows = segments.select("shard", "segment", "doc_ids", "sizes", "bits", "payload").mapInArrow(run, schema)
    kept = ["doc_id", (F.col("before_shard") + F.col("before") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32"] + ["ids"] * ids
    return rows.join(starts, ["shard", "segment"]).select(*kept)
