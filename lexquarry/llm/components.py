"""Connected components of a link table by alternating large and small stars, and joins that deal hubs out."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexquarry.sources.scratch import Scratch

#: A key with more rows than both SPLIT (what a task does in a second) and a HUBS-th of all rows is a hub; its rows go to SALTS tasks.
SPLIT, HUBS, SALTS = 20_000, 10_000, 64


def spread(files: Scratch, rows: DataFrame, one: DataFrame, key: str, by: list[str], counts: DataFrame, total: int, how: str = "inner") -> DataFrame:
    """rows joined with `one`, which has one row for each key; no key is one task's alone.

    counts has (key, k), the number of rows of each key, which are `total` in all.
    Fewer than HUBS keys can be hubs, so that every executor can hold the list of
    them; a hub's row of `one` goes to each of its SALTS parts, told apart by `by`.
    Without hubs it is a plain join.
    """
    limit = max(SPLIT, total // HUBS)
    if total <= limit:
        return rows.join(one, key, how)
    hubs, (n,) = files.counted(counts.where(F.col("k") > limit).select(key), "hubs", F.count(F.lit(1)))
    if not n:
        files.drop(hubs)
        return rows.join(one, key, how)
    hub = F.broadcast(hubs.withColumn("hub", F.lit(True)))
    part = F.when(F.col("hub"), F.pmod(F.xxhash64(*by), F.lit(SALTS))).otherwise(F.lit(0)).cast("int")
    parts = F.when(F.col("hub"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    many = rows.join(hub, key, "left").withColumn("part", part).drop("hub")
    few = one.join(hub, key, "left").withColumn("part", F.explode(parts)).drop("hub")
    return many.join(few, [key, "part"], how).drop("part")


def with_count(files: Scratch, rows: DataFrame, key: str, name: str, total: int) -> DataFrame:
    """`total` rows with the number of rows of their key; rows of other keys than hubs are counted where they meet, in one shuffle."""
    counted = rows.withColumn(name, F.count("*").over(Window.partitionBy(key)))
    limit = max(SPLIT, total // HUBS)
    if total <= limit:
        return counted
    hubs, (n,) = files.counted(rows.groupBy(key).agg(F.count("*").alias(name)).where(F.col(name) > limit), "hubs", F.count(F.lit(1)))
    if not n:
        files.drop(hubs)
        return counted
    rest = rows.join(F.broadcast(hubs.select(key)), key, "left_anti").withColumn(name, F.count("*").over(Window.partitionBy(key)))
    return rest.unionByName(rows.join(F.broadcast(hubs), key))


def components(files: Scratch, links: DataFrame, rounds: int | None = None) -> DataFrame:
    """(id, component) for every id in links(a, b); component is the smallest id reachable.

    Each round moves edges towards the smallest neighbour and writes the edge
    table, so that plans stay short and nothing is gathered on the driver.  With
    `rounds`, it stops after so many: ids of one component are then connected,
    but not all connected ids need have met.
    Links of an id with itself, null ends and repeated links add nothing; an
    empty table has no components.
    """
    edges, state = _kept(files, links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    while state[0] and rounds != 0:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count("*").alias("k"))
        large = spread(files, both, least.select("u", "m"), "u", ["v"], least, 2 * state[0]).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("k"))
        moved = spread(files, large, small.select("u", "m"), "u", ["v"], small, state[0]).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after, now = _kept(files, moved.unionByName(small.select("u", F.col("m").alias("v"))).distinct())
        files.drop(edges)
        edges = after
        if now == state:
            break
        state, rounds = now, None if rounds is None else rounds - 1
    least = edges.groupBy("u").agg(F.min("v").alias("v"))  # one edge for each id, if rounds came to their end
    roots = least.select(F.col("v").alias("id")).distinct().join(least.select(F.col("u").alias("id")), "id", "left_anti")
    found = files.keep(least.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(roots.select("id", F.col("id").alias("component"))), "components")
    files.drop(edges)
    return found


def _kept(files: Scratch, edges: DataFrame) -> tuple[DataFrame, tuple]:
    """The written edges, and what tells them from others: their number and two sums of hashes."""
    return files.counted(edges, "edges", F.count(F.lit(1)), F.sum(F.xxhash64("u", "v") % 1000003), F.sum(F.xxhash64("v", "u") % 1000033))
