"""Sources and sinks: corpora, queries, runs, predictions, caches and stage artifacts."""

from __future__ import annotations

import json
import time

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexquarry.functions import text as fn
from lexquarry.sources.scratch import scratch


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """A CSV with a header, fields of any length and line breaks inside quotes, or Parquet."""
    if path.endswith((".csv", ".csv.gz")):
        return spark.read.csv(path, header=True, multiLine=True, escape='"', maxCharsPerColumn=-1)
    return spark.read.parquet(path)


def slice_queries(queries: DataFrame, pos: str, ids: DataFrame | None = None, offset: int = 0, limit: int | None = None) -> DataFrame:
    """The queries of an id list, in file order, from an offset, up to a limit - in this order."""
    rows = queries.join(ids.select("query_id"), "query_id", "left_semi") if ids is not None else queries
    rows = rows.orderBy(pos).offset(offset)
    return rows if limit is None else rows.limit(limit)


def explode_gold(rows: DataFrame, column: str = "gold_citations") -> DataFrame:
    return rows.select("query_id", F.explode(fn.split_citations(F.col(column))).alias("citation"))


def prediction_column(rows: DataFrame) -> Column:
    """The first of the known column names that a file has."""
    for name in ("predicted_citations", "citations", "gold_citations"):
        if name in rows.columns:
            return F.col(name)
    raise ValueError(f"no prediction column among {rows.columns}")


def explode_predictions(rows: DataFrame) -> DataFrame:
    return rows.select("query_id", F.explode(fn.split_citations(prediction_column(rows))).alias("citation"))


def read_json_map(spark: SparkSession, path: str, value: str) -> DataFrame:
    """(query_id, value) of a JSON object that is keyed by query."""
    text = spark.read.text(path, wholetext=True)
    return text.select(F.explode(F.from_json("value", f"map<string,{value}>")).alias("query_id", "value"))


def union_runs(runs: dict[str, DataFrame]) -> DataFrame:
    """All runs as one long table with their name."""
    out = None
    for name, rows in sorted(runs.items()):
        part = rows.withColumn("run", F.lit(name))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    if out is None:
        raise ValueError("no runs")
    return out


def run_frequency(runs: DataFrame) -> DataFrame:
    """(query_id, citation, freq, first): in how many runs a citation is, and the first of them by name."""
    return runs.select("run", "query_id", "citation").distinct().groupBy("query_id", "citation").agg(F.count("*").alias("freq"), F.min("run").alias("first"))


def existing(spark: SparkSession, paths: list[str]) -> list[str]:
    """Those paths that exist, on any file system."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    found = []
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        if path.getFileSystem(conf).globStatus(path):
            found.append(p)
    return found


def read_shards(spark: SparkSession, pattern: str, policy: str = "first", key: str = "query_id") -> DataFrame:
    """Shards of a stage; a query in several of them raises an error, or its first or last shard counts."""
    rows = spark.read.parquet(pattern).withColumn("shard", F.input_file_name())
    if policy == "error":
        twice = rows.select(key, F.regexp_replace("shard", r"/[^/]*$", "").alias("s")).distinct().groupBy(key).count().where("count > 1")
        if not twice.isEmpty():
            raise ValueError(f"queries in several shards: {twice.first()[0]}, ...")
        return rows.drop("shard")
    w = Window.partitionBy(key)
    chosen = F.min("shard").over(w) if policy == "first" else F.max("shard").over(w)
    return rows.withColumn("chosen", chosen).where("shard = chosen").drop("shard", "chosen")


def write_predictions(predictions: DataFrame, path: str) -> None:
    """A CSV row for each query: its citations sorted and joined by semicolons."""
    prediction_rows(predictions).write.mode("overwrite").csv(path, header=True)


def prediction_rows(predictions: DataFrame) -> DataFrame:
    return predictions.groupBy("query_id").agg(fn.join_citations(F.collect_set("citation")).alias("predicted_citations"))


def write_stage(df: DataFrame, path: str, stage: str, config: dict) -> None:
    """A stage's rows as Parquet, and a manifest with its configuration and counts."""
    began = time.time()
    df.write.mode("overwrite").parquet(f"{path}/{stage}")
    spark = df.sparkSession
    manifest = {"stage": stage, "config": config, "rows": spark.read.parquet(f"{path}/{stage}").count(), "elapsed_sec": round(time.time() - began, 3)}
    spark.createDataFrame([(json.dumps(manifest, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/{stage}.manifest")


def pending(rows: DataFrame, done: DataFrame, key: str = "query_id") -> DataFrame:
    """Rows whose key is not done yet."""
    return rows.join(done.select(key).distinct(), key, "left_anti")


def append_pending(rows: DataFrame, path: str, key: str = "query_id") -> int:
    """Appends the rows whose key the table at `path` lacks; returns how many keys that were.

    A row without a key can't be told from one that was written before: it is an
    error.  The rows are evaluated once.
    """
    spark = rows.sparkSession
    todo = pending(rows, spark.read.parquet(path), key) if existing(spark, [path]) else rows
    files = scratch(spark)
    todo, (nameless,) = files.counted(todo, "pending", F.count_if(F.col(key).isNull()))
    if nameless:
        files.drop(todo)
        raise ValueError(f"{nameless} rows without {key}")
    n = todo.select(key).distinct().count()
    if n:
        todo.write.mode("append").parquet(path)
    files.drop(todo)
    return n


def read_cache(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The last good line of each key of a JSONL cache (key, created_at, ...)."""
    rows = spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path).where("key IS NOT NULL")
    w = Window.partitionBy("key").orderBy(F.desc("created_at"), F.desc(F.to_json(F.struct(*rows.columns))))
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def pair_files(spark: SparkSession, folder: str, left: str = "test_submission_", right: str = "val_pred_") -> DataFrame:
    """(name, left, right): files whose names differ in their prefix only."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(folder)
    names = [s.getPath().getName() for s in path.getFileSystem(conf).listStatus(path)]
    rows = [(n[len(left) :], f"{folder}/{n}", f"{folder}/{right}{n[len(left):]}") for n in names if n.startswith(left) and f"{right}{n[len(left):]}" in names]
    return spark.createDataFrame(sorted(rows), "name string, left string, right string")
