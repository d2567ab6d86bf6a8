"""Whole grids of the hybrid score: every combination of weights and selection options, in one job.

A query's candidates, a row of terms each, meet blocks of weight vectors in matrix
products.  A vector orders the candidates once, whatever the options are; an option's
selection under caps is three running counts over that order.  What leaves a task are
counts for each (configuration, query), so the shuffle afterwards doesn't grow with
candidates x configurations.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexquarry.functions import text as fn
from lexquarry.operators import ensemble

#: Weight vectors that are multiplied at once.
VECTORS = 64
#: Rows of an order that are looked at first; where they fill a set, no later row gets in.
FIRST = 192


@dataclass(frozen=True)
class Options:
    """How many rows of an order are taken: a target of mult * estimate, halves to even, and bias; caps of 0 for a base are none."""

    mult: float = 1.0
    bias: int = 2
    min_output: int = 8
    max_output: int = 32
    court_fraction: float = 0.2
    law_per_base: int = 0
    court_per_base: int = 0


@dataclass(frozen=True)
class Grid:
    """Weight vectors by options; configuration i has vector i // len(options) and option i % len(options)."""

    names: tuple[str, ...]
    weights: np.ndarray
    options: tuple[Options, ...]

    @staticmethod
    def of(fixed: dict[str, float], weights: dict[str, list[float]], option: Options = Options(), **options: list) -> Grid:
        """All combinations, the last list varying fastest."""
        names = tuple(fixed)
        rows = [[{**fixed, **dict(zip(weights, v))}[n] for n in names] for v in product(*weights.values())]
        return Grid(names, np.array(rows), tuple(replace(option, **dict(zip(options, v))) for v in product(*options.values())))

    def __len__(self) -> int:
        return len(self.weights) * len(self.options)

    def config(self, i: int) -> dict[str, float]:
        w, o = divmod(i, len(self.options))
        return {**dict(zip(self.names, self.weights[w].tolist())), **vars(self.options[o])}

    def drawn(self, ids: list[int]) -> list[tuple[int, Grid]]:
        """Grids of one configuration each, with its number."""
        return [(i, Grid(self.names, self.weights[i // len(self.options)][None], (self.options[i % len(self.options)],))) for i in ids]


def terms(pool: DataFrame, candidates: DataFrame, priors: DataFrame, gold: DataFrame) -> DataFrame:
    """The terms of the hybrid score with label, estimate, court and base of each candidate."""
    c, keys = F.col("citation"), ["query_id", "citation"]
    rows = ensemble.hybrid_terms(pool, candidates, priors)
    own = rows.join(candidates.select(*keys, "kind"), keys, "left").join(gold.select(*keys).distinct().withColumn("label", F.lit(1)), keys, "left")
    estimate = candidates.groupBy("query_id").agg(F.max("estimate").alias("estimate"))
    court = ~F.coalesce(F.col("kind") == "law", fn.is_law(c))
    return own.join(estimate, "query_id").withColumn("court", court).withColumn("base", F.when(court, fn.court_base(c)).otherwise(fn.law_base_by_tokens(c))).fillna(0, ["label"])


class _Order:
    """Rows of some orders, a column an order, from the first on."""

    def __init__(self, court: np.ndarray, label: np.ndarray, base: np.ndarray, order: np.ndarray):
        self.court, self.label, b = court[order], label[order], base[order]
        inner = np.argsort(b, axis=0, kind="stable")
        sorted_b = np.take_along_axis(b, inner, 0)
        new = np.ones_like(sorted_b, bool)
        new[1:] = sorted_b[1:] != sorted_b[:-1]
        place = np.arange(len(order))[:, None]
        self.rank = np.empty_like(inner)
        np.put_along_axis(self.rank, inner, place - np.maximum.accumulate(np.where(new, place, 0), 0) + 1, 0)

    def taken(self, o: Options, target: int, n: int) -> np.ndarray:
        """How many rows of each order an option takes, of n candidates in all, how many of them are labelled, and how many decisions."""
        c = self.court
        ok = self.rank <= np.where(c, o.court_per_base or n, o.law_per_base or n)
        cap = max(0, round(target * o.court_fraction))
        ok &= ~c | (np.cumsum(ok & c, 0) <= cap)
        ok &= np.cumsum(ok, 0) <= target
        return np.array([ok.sum(0), (ok * self.label).sum(0), (ok & c).sum(0)])


def selected_counts(rows: DataFrame, grid: Grid, ids: list[int] | None = None) -> DataFrame:
    """(config_id, query_id, n_pred, tp, courts) of terms(), for the whole grid or some of its configurations.

    Candidates are ordered by score, rounded to six places, then those of the left set
    and of the right one first, then by citation.  A query's candidates are one task's
    work: as many as its sources together return for it.  A missing term counts 0; a
    query without candidates has no row.  An order's later rows are looked at only where the
    first ones leave a set short.
    """
    grids = [(0, grid)] if ids is None else grid.drawn(ids)
    names, has = grid.names, "v7_bonus" in grid.names and "v11_bonus" in grid.names
    columns = ["query_id", "citation", "estimate", "court", "base", "label"]

    def run(table):
        query, n = table.column("query_id")[0].as_py(), table.num_rows
        matrix = np.stack([table.column(x).to_numpy() for x in names], 1)
        keys = [table.column("citation").to_pylist()]
        if has:
            keys = [1 - table.column("v7_bonus").to_numpy(), 1 - table.column("v11_bonus").to_numpy(), *keys]
        first = np.array(sorted(range(n), key=lambda i: [k[i] for k in keys]))
        court, label = (table.column(x).to_numpy(zero_copy_only=False)[first] for x in ("court", "label"))
        base = table.column("base").combine_chunks().dictionary_encode().indices.to_numpy()[first].astype(np.int64) * 2 + court
        matrix, estimate, out = matrix[first], table.column("estimate")[0].as_py(), []
        for start, g in grids:
            targets = [max(o.min_output, min(1 << 30, round(estimate * o.mult) + o.bias)) for o in g.options]
            targets = [min(o.max_output, t) for o, t in zip(g.options, targets)]
            for at in range(0, len(g.weights), VECTORS):
                w = g.weights[at : at + VECTORS]
                score = np.round(matrix @ w.T, 6)
                order = np.argsort(-score, axis=0, kind="stable")
                few, whole = _Order(court, label, base, order[:FIRST]), None
                for j, (o, target) in enumerate(zip(g.options, targets)):
                    got = few.taken(o, target, n)
                    if n > FIRST and (got[0] < target).any():  # the first rows don't fill some set
                        whole = whole or _Order(court, label, base, order)
                        got = whole.taken(o, target, n)
                    out.append([start + (at + np.arange(len(w))) * len(g.options) + j, *got])
        config, size, tp, courts = (np.concatenate(x).astype(np.int32) for x in zip(*out))
        return pa.table({"config_id": config, "query_id": pa.array([query] * len(config), table.schema.field("query_id").type), "n_pred": size, "tp": tp, "courts": courts})

    kind = rows.schema["query_id"].dataType.simpleString()
    own = rows.select(*columns, *[F.coalesce(F.col(x).cast("double"), F.lit(0.0)).alias(x) for x in names])
    return own.groupBy("query_id").applyInArrow(run, f"config_id int, query_id {kind}, n_pred int, tp int, courts int")


def grid_scores(counts: DataFrame, gold: DataFrame, queries: DataFrame) -> DataFrame:
    """(config_id, macro_f1, avg_n, court_fraction, objective) over all queries; those without candidates have empty sets.

    The objective is the mean F1 less what court share and set size lack to their floors.
    """
    size = queries.select("query_id").distinct().join(gold.groupBy("query_id").agg(F.count_distinct("citation").alias("n_gold")), "query_id", "left").fillna(0, ["n_gold"])
    with_rows = counts.select("query_id").distinct()
    total, blank = size.join(with_rows.withColumn("_has", F.lit(1)), "query_id", "left").agg(F.count(F.lit(1)), F.count_if(F.col("_has").isNull() & (F.col("n_gold") == 0))).first()
    rows = counts.join(F.broadcast(size), "query_id")  # a row for each query
    empty = (F.col("n_pred") == 0) & (F.col("n_gold") == 0)
    f1 = F.when(empty, 1.0).otherwise(2 * F.col("tp") / F.greatest(F.lit(1), F.col("n_pred") + F.col("n_gold")))
    share = F.when(F.col("n_pred") == 0, 0.0).otherwise(F.col("courts") / F.col("n_pred"))
    means = rows.groupBy("config_id").agg(*[(x / total).alias(n) for n, x in (("macro_f1", F.sum(f1) + blank), ("avg_n", F.sum("n_pred")), ("court_fraction", F.sum(share)))])
    objective = F.col("macro_f1") - ensemble.low_penalty(F.col("court_fraction"), 0.28, 0.9) - ensemble.low_penalty(F.col("avg_n"), 24, 0.01)
    return means.withColumn("objective", objective).select("config_id", *[F.round(x, 6).alias(x) for x in ("macro_f1", "avg_n", "court_fraction", "objective")])
