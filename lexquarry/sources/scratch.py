"""Intermediate tables in the shared folder of the cluster.

A written table cuts lineage: a lost executor costs the tasks it ran, never a
recomputation of the stages before.  Files are in spark.checkpoint.dir, through
Spark's own readers and writers, so that any file system of the cluster serves.
Where that is unset, a session on one machine gets a folder of its own; on a
cluster that is an error, since executors don't share such folders.

Nothing reads the shuffle files that led to a written table, so they go as soon as
it stands; otherwise they would stay until the driver collects its garbage.
"""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Observation, SparkSession

#: Spark's setting that drops the shuffle files of a query when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def cleaned(spark: SparkSession):
    """Shuffle files of the jobs within are dropped as soon as each is done, since what they lead to is written; the session's setting comes back."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)


class Scratch:
    def __init__(self, spark: SparkSession):
        self.spark = spark
        root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
        if not root:
            if not spark.sparkContext.master.split("[")[0] == "local":
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            root = "file://" + tempfile.mkdtemp(prefix="lexquarry-")
            spark.conf.set("spark.checkpoint.dir", root)
        self.root = f"{root.rstrip('/')}/lexquarry"

    def keep(self, df: DataFrame, name: str, to: str | None = None, **options: str) -> DataFrame:
        """Writes df as Parquet, to a folder of its own or to `to`, and reads it again."""
        path = to or f"{self.root}/{name}-{uuid.uuid4().hex}"
        with cleaned(self.spark):
            df.write.options(**options).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def counted(self, df: DataFrame, name: str, *sums: Column) -> tuple[DataFrame, tuple]:
        """keep() and some aggregates of the rows, taken while they are written; a sum of no rows is 0."""
        seen = Observation()
        out = self.keep(df.observe(seen, *[s.alias(f"x{i}") for i, s in enumerate(sums)]), name)
        return out, tuple(seen.get[f"x{i}"] or 0 for i in range(len(sums)))

    def drop(self, *tables: DataFrame) -> None:
        """Deletes the files of tables that keep() returned and that no later plan reads."""
        jvm = self.spark.sparkContext._jvm
        for f in {p.rsplit("/", 1)[0] for df in tables for p in df.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(f)
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def scratch(spark: SparkSession) -> Scratch:
    return Scratch(spark)
