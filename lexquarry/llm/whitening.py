"""Whitening of embeddings by column aggregates over the upper triangle.

1. A vector's entries become longs, x = floor(1024 * c) + 100000.  One aggregation
   counts the vectors and sums every dimension, exactly.
2. Spark SQL expressions are generated that sum the product of every pair of
   dimensions, each less its mean first, so that one aggregation without a shuffle
   of rows gives the upper triangle of the covariance: dims * (dims + 1) / 2 numbers,
   whatever the number of vectors.
3. LAPACK decomposes the matrix on the driver; the components go back into
   expressions that project and scale each row where it is.
4. Two more aggregations measure the covariance of what came out.

The sums of step 2 stand in groups of `GROUP` struct fields, so that the generated
code of one method stays small.

Rows whose vector is null, or holds a null, a NaN or an infinity, are left out, as are
vectors of another length than the most frequent one (of equally frequent ones, the
longest).  An entry beyond +-2^40 counts as that bound.  A component without variance
(its eigenvalue is not above the rounding of the greatest) has a null whitened value
and takes no part in identity_error.  A null or repeated vec_id is a row like any
other; an empty table, or one of empty vectors, gives an empty result.  Only the two named columns are read.
"""

from __future__ import annotations

import dataclasses

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What an entry becomes: floor(SCALE * c) + SHIFT, with SCALE * c held within +-BOUND.
SCALE, SHIFT, BOUND = 1024, 100_000, float(1 << 50)
#: Components returned at most, and sums in one struct of an aggregation.
COMPONENTS, GROUP = 8, 64
#: An eigenvalue of less than so much of the greatest is none.
RANK = 1e-12


@dataclasses.dataclass(frozen=True)
class Whitening:
    """What a fit found: the number of vectors, the sums of x, the covariance and its decomposition, greatest eigenvalues first."""

    n: int
    sums: list[int]
    least: int
    most: int
    covariance: np.ndarray
    values: np.ndarray
    vectors: np.ndarray

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])

    def live(self, count: int) -> int:
        """How many of the first `count` components have a variance."""
        return int((self.values[:count] > max(0.0, self.values[0]) * RANK).sum())


def integers(df: DataFrame, id: str = "vec_id", embedding: str = "embedding") -> tuple[DataFrame, int]:
    """(id, x) of the rows with a usable vector, and the length of x; 0 if there is none."""
    vector = F.col(embedding).cast("array<double>")
    sound = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    kept = df.select(F.col(id).alias("vec_id"), vector.alias("v")).where(F.col("v").isNotNull() & sound)
    most = kept.groupBy(F.size("v").alias("dims")).count().orderBy(F.desc("count"), F.desc("dims")).first()
    dims = most["dims"] if most else 0
    entry = lambda c: F.floor(F.greatest(F.least(c * SCALE, F.lit(BOUND)), F.lit(-BOUND))).cast("long") + F.lit(SHIFT)
    return kept.where(F.size("v") == dims).select("vec_id", F.transform("v", entry).alias("x")), dims


def _sums(df: DataFrame, expressions: list[str]) -> list:
    """The sum of each expression over all rows, in one aggregation of structs."""
    groups = [expressions[i : i + GROUP] for i in range(0, len(expressions), GROUP)]
    row = df.agg(*[F.struct(*[F.expr(f"sum({e})").alias(f"s{j}") for j, e in enumerate(g)]).alias(f"g{i}") for i, g in enumerate(groups)]).first()
    return [v for g in row for v in g]


def centred_products(df: DataFrame, columns: list[str], n: int) -> np.ndarray:
    """The covariance (divisor n) of expressions that are centred already: every pair of the upper triangle in one aggregation."""
    pairs = [(i, j) for i in range(len(columns)) for j in range(i, len(columns))]
    flat = df.select(*[F.expr(c).alias(f"d{i}") for i, c in enumerate(columns)])
    out = np.zeros((len(columns), len(columns)))
    for (i, j), s in zip(pairs, _sums(flat, [f"d{i} * d{j}" for i, j in pairs])):
        out[i, j] = out[j, i] = s / n
    return out


def fit(vectors: DataFrame, dims: int) -> Whitening | None:
    """The decomposition of the covariance of vectors(x); None without vectors."""
    if not dims:
        return None
    # An exact sum of longs may pass 64 bits.
    n, *sums = _sums(vectors, ["1", *[f"CAST(x[{i}] AS DECIMAL(28, 0))" for i in range(dims)]])
    if not n:
        return None
    sums = [int(s) for s in sums]
    least, most = vectors.agg(F.min(F.array_min("x")), F.max(F.array_max("x"))).first()
    covariance = centred_products(vectors, [f"x[{i}] - {s / n!r}D" for i, s in enumerate(sums)], n)
    values, components = np.linalg.eigh(covariance)
    return Whitening(n, sums, least, most, covariance, values[::-1].copy(), components.T[::-1].copy())


def project(vectors: DataFrame, model: Whitening, count: int) -> DataFrame:
    """vectors(vec_id, x) with w, the whitened values of the first `count` components."""
    mean, live = model.mean.tolist(), model.live(count)
    flat = vectors.withColumn("y", F.expr(f"transform(x, (v, i) -> v - array({', '.join(f'{m!r}D' for m in mean)})[i])"))
    scaled = [model.vectors[k] / np.sqrt(model.values[k]) for k in range(live)]
    terms = [" + ".join(f"y[{i}] * {float(v)!r}D" for i, v in enumerate(row)) for row in scaled]
    return flat.select("vec_id", "x", F.expr(f"array({', '.join([*terms, *['CAST(NULL AS DOUBLE)'] * (count - live)])})").alias("w"))


def identity_error(projected: DataFrame, model: Whitening, count: int) -> float:
    """The largest absolute entry of the covariance of w less the identity, measured on the rows."""
    live = model.live(count)
    if not live:
        return 0.0
    means = [s / model.n for s in _sums(projected, [f"w[{k}]" for k in range(live)])]
    found = centred_products(projected, [f"w[{k}] - {m!r}D" for k, m in enumerate(means)], model.n)
    return float(np.abs(found - np.eye(live)).max())


def _deviation(model: Whitening) -> Column:
    """Sum over dimensions of (n * x - S)^2, in longs if they surely hold it, else in decimals; null if a long can't hold the result."""
    n, sums = model.n, model.sums
    if len(sums) * (n * (model.most - model.least + 1)) ** 2 < 1 << 63 and n * max(abs(model.most), abs(model.least)) < 1 << 62:
        return F.expr(" + ".join(f"({n}L * x[{i}] - {s}L) * ({n}L * x[{i}] - {s}L)" for i, s in enumerate(sums)))
    off = [f"CAST({n}BD * x[{i}] - {s}BD AS DECIMAL(38, 0))" for i, s in enumerate(sums)]
    return F.expr(f"try_cast(aggregate(array({', '.join(off)}), CAST(0 AS DECIMAL(38, 0)), (a, d) -> CAST(a + try_multiply(d, d) AS DECIMAL(38, 0))) AS BIGINT)")


def whiten(df: DataFrame, id: str = "vec_id", embedding: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error), a row for each usable vector and component."""
    vectors, dims = integers(df, id, embedding)
    model = fit(vectors, dims)
    count = min(components, dims)
    if model is None:
        return vectors.limit(0).selectExpr("vec_id", "1 AS component", "1L AS n", "1L AS deviation", "1D AS whitened", "1D AS explained", "0D AS identity_error")
    projected = project(vectors, model, count)
    error = identity_error(projected, model, count)
    trace = float(np.trace(model.covariance))
    share = [float(v / trace) if trace > 0 else None for v in model.values[:count]]
    rows = F.posexplode(F.array(*[F.struct(F.col("w")[k].alias("w"), F.lit(e).cast("double").alias("e")) for k, e in enumerate(share)]))
    out = projected.select("vec_id", _deviation(model).alias("deviation"), rows.alias("component", "p"))
    return out.select("vec_id", (F.col("component") + 1).cast("int").alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", F.col("p.w").alias("whitened"), F.col("p.e").alias("explained"), F.lit(error).alias("identity_error"))
