"""Bounded training samples of labelled texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows, and bytes of text, that a classifier is fitted on at most.
ROWS, BYTES = 2200, 8 << 20


def fold(doc_id: str, folds: int) -> Column:
    """crc32 of a doc_id as text, modulo the number of folds; a null has no fold."""
    return F.crc32(F.col(doc_id).cast("string")) % folds


def least_hashes(df: DataFrame, key: str, rows: int) -> DataFrame:
    """About the `rows` rows with the least hashes of a key: a cut at four times their share first, so that no task gathers more."""
    n = df.count()
    hashed = F.pmod(F.xxhash64(key), F.lit(1 << 40))
    near = df.where(hashed < F.lit(int((1 << 40) * min(1.0, 4 * rows / max(1, n)))))
    return near.orderBy(hashed, key).limit(rows)


def sample(docs: DataFrame, labels: DataFrame, label: str, rows: int = ROWS, most: int = BYTES) -> list[tuple[str, int]]:
    """(text, label) of labelled documents, in the order of a hash of their ids, as far as the bounds go.

    Rows without an id, a label or a document are no training rows; a text that
    would go beyond the bytes is passed over; an id labelled twice counts once.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    chosen = least_hashes(known, "doc_id", 2 * rows)  # some may have no document
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    sizes = texts.select("doc_id", F.octet_length("text").alias("n")).join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "y").agg(F.max("n").alias("n"))
    ids, total = [], 0
    for r in sizes.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows).collect():
        if total + r["n"] <= most:
            ids.append((r["doc_id"], r["y"]))
            total += r["n"]
    if not ids:
        return []
    wanted = docs.sparkSession.createDataFrame(ids, "doc_id long, y int")
    got = texts.join(F.broadcast(wanted), "doc_id").groupBy("doc_id", "y").agg(F.max("text").alias("text")).collect()
    return [(r["text"], r["y"]) for r in sorted(got, key=lambda r: r["doc_id"])]
