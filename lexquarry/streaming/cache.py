"""A judge cache that grows from a stream, last answer wins, and what a session of queries carries from one to the next."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexquarry.sources.committed import Committed


def latest(answers: DataFrame) -> DataFrame:
    """(key, label, created_at): the last answer of each key."""
    return answers.groupBy("key").agg(F.max_by("label", F.struct("created_at", "label")).alias("label"), F.max("created_at").alias("created_at"))


def follow(spark: SparkSession, source: str, schema: str, target: str, checkpoint: str):
    """Appends what arrives at `source` (JSON files) to the Parquet table at `target`, once each; returns the query."""
    stream = spark.readStream.schema(schema).json(source).where("key IS NOT NULL")
    return stream.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_votes(events: DataFrame, late: str = "1 hour", width: str = "1 day") -> DataFrame:
    """(day, source, votes) of (ts, source): tumbling windows with a watermark; batch or stream."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "source").agg(F.count("*").alias("votes")).select(F.col("w.start").alias("day"), "source", "votes")


def keeper(table: Committed, key: str = "key", pos: str = "pos") -> Callable[[DataFrame, int], None]:
    """What foreachBatch calls: publishes the last row of each key of a batch, once for each batch id.

    A batch that comes again after a restart changes nothing.  Rows without a key are left out.
    """

    def keep(batch: DataFrame, batch_id: int) -> None:
        last = F.max_by(F.struct(*batch.columns), F.struct(pos, F.to_json(F.struct(*batch.columns)))).alias("row")
        table.append(batch.where(F.col(key).isNotNull()).groupBy(key).agg(last).select("row.*"), f"batch-{batch_id:09d}")

    return keep


def current(table: Committed, key: str = "key") -> DataFrame | None:
    """The row of each key in the latest batch that has one; None before the first batch."""
    rows = table.read()
    if rows is None:
        return None
    fields = [c for c in rows.columns if c != "batch"]
    return rows.groupBy(key).agg(F.max_by(F.struct(*fields), "batch").alias("row")).select("row.*")


def compact(table: Committed, key: str = "key") -> None:
    """Puts one batch of current rows in the place of all; it sorts as the latest of them."""
    names = [b["name"] for b in table.batches()]
    if len(names) > 1:
        table.append(current(table, key), f"{max(names)}+", instead_of=names)


def follow_into(spark: SparkSession, source: str, schema: str, table: Committed, checkpoint: str, files: int = 1):
    """Feeds what arrives at `source` (Parquet files) to keeper(), so many files a batch; returns the query."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(source)
    return stream.writeStream.foreachBatch(keeper(table)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def carried(queries: DataFrame, session: str = "session", pos: str = "pos", share: float = 0.8) -> DataFrame:
    """queries with `target` and `taken`: each query's estimate, at least a share of what the session took on average before.

    queries has session, pos, estimate and available (integers); `taken` is the target as far as
    rows are available.  Sessions are dealt to tasks and sorted by pos, and a task reads its rows
    once with one session's state, so a long session is never held as a group.  Null estimates
    and numbers count 0; rows of equal pos follow each other by estimate and number available;
    rows without a session are one session.
    """
    rows = queries.repartition(session).sortWithinPartitions(session, pos, "estimate", "available")
    names = rows.columns
    schema = T.StructType([*rows.schema.fields, T.StructField("target", T.LongType()), T.StructField("taken", T.LongType())])

    def run(batches):
        of, count, total = object(), 0, 0
        for batch in batches:
            number = lambda c: pc.fill_null(batch.column(names.index(c)).cast(pa.int64()), 0).to_pylist()
            out = np.zeros((2, batch.num_rows), np.int64)
            for i, (s, estimate, available) in enumerate(zip(batch.column(names.index(session)).to_pylist(), number("estimate"), number("available"))):
                if s != of:
                    of, count, total = s, 0, 0
                target = max(estimate, int(total / count * share)) if count else estimate
                taken = max(0, min(target, available))
                out[:, i] = target, taken
                count, total = count + 1, total + taken
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out[0]), pa.array(out[1])], names=schema.names)

    return rows.mapInArrow(run, schema)
