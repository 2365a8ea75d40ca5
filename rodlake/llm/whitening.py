"""Embedding whitening: upper-triangle column aggregates, components from LAPACK.

One Spark SQL aggregation sums the centred products of every pair of dimensions; the
driver gets these sums alone (a matrix of dims x dims) and decomposes it.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, floored, matrix, same_length, save

#: Products that one aggregation sums: all pairs of 90 dimensions. Wider vectors take an aggregation for each such number.
PRODUCTS = 4096
#: Groups in which the sums of tasks meet, so that no task reads a row of every task.
GROUPS = 64
#: Largest integer component: the differences from a mean are exact as doubles.
BOUND = 1 << 40


@dataclass(frozen=True)
class Whitening:
    """Of ``n`` vectors: exact integer sums, the nearest integers to the means, the largest distance from those, eigenvalues (falling), unit eigenvectors as columns."""

    n: int
    sums: tuple[int, ...]
    near: np.ndarray
    span: int
    eigenvalues: np.ndarray
    axes: np.ndarray

    @property
    def rest(self) -> tuple[int, ...]:
        """n times what the means have beyond ``near``."""
        return tuple(s - self.n * int(r) for s, r in zip(self.sums, self.near))

    @property
    def rank(self) -> int:
        """Components with a variance beyond rounding."""
        e = self.eigenvalues
        return int((e > max(e[0], 0) * len(e) * 8 * np.finfo(float).eps).sum())


def grouped_sums(df: DataFrame, terms: list[str], kind: str = "sum") -> list[tuple]:
    """A row for each of at most GROUPS groups of tasks, with an aggregate of each SQL term."""
    dealt = df.withColumn("_group", F.pmod(F.spark_partition_id(), F.lit(GROUPS)))
    columns = ", ".join(f"{kind}({t}) as t{i}" for i, t in enumerate(terms))
    return [tuple(r) for r in df.sparkSession.sql(f"select {columns} from {{dealt}} group by _group", dealt=dealt).collect()]


def covariance(df: DataFrame, centred: list[str], n: int) -> np.ndarray:
    """Mean products of the SQL expressions ``centred`` (doubles, each less its mean), over the ``n`` rows of ``df``."""
    dims = len(centred)
    columns = df.select(*[F.expr(f"coalesce({c}, 0D)").alias(f"c{i}") for i, c in enumerate(centred)])  # none is null: this halves the code of the sums
    pairs = [(i, j) for i in range(dims) for j in range(i, dims)]
    out = np.zeros((dims, dims))
    for at in range(0, len(pairs), PRODUCTS):
        some = pairs[at : at + PRODUCTS]
        sums = np.sum(grouped_sums(columns, [f"c{i} * c{j}" for i, j in some]), axis=0)
        for (i, j), s in zip(some, sums):
            out[i, j] = out[j, i] = s / n
    return out


def fit(vectors: DataFrame, dims: int, column: str = "x") -> Whitening | None:
    """Fitted on all rows: ``column`` holds ``dims`` longs within BOUND. None if there is no row.

    Sums are exact; products are of differences from the mean, taken before multiplying.
    Eigenvectors have either sign: here the entry farthest from 0 is positive.
    """
    entry = [f"{column}[{i}]" for i in range(dims)]
    n = vectors.count()
    if not n:
        return None
    sums = tuple(sum(int(v) for v in c) for c in zip(*grouped_sums(vectors, [f"cast({e} as decimal(38,0))" for e in entry])))
    low, high = (np.array([f(c) for c in zip(*grouped_sums(vectors, entry, k))]) for k, f in (("min", min), ("max", max)))
    near = np.array([(2 * s + n) // (2 * n) for s in sums])
    rest = [(s - n * int(r)) / n for s, r in zip(sums, near)]
    v = covariance(vectors, [f"cast({e} - {int(r)}L as double) - {f!r}D" for e, r, f in zip(entry, near, rest)], n)
    values, axes = np.linalg.eigh(v)
    values, axes = values[::-1].copy(), axes[:, ::-1].copy()
    axes *= np.sign(axes[np.abs(axes).argmax(axis=0), np.arange(dims)])
    return Whitening(n, sums, near, int(max((near - low).max(), (high - near).max())), values, axes)


def whiten(vectors: DataFrame, model: Whitening, components: int, keep: list[str], column: str = "x") -> DataFrame:
    """The columns ``keep``, ``deviation`` (sum over dimensions of (n x - S)^2, exact; null beyond a long) and ``whitened`` (one double per component).

    A component without variance has null. Vectors need not be those of the fit.
    """
    n, dims, some = model.n, len(model.near), min(components, len(model.near))
    near, rest = model.near, np.array(model.rest)
    ways = model.axes[:, : min(some, model.rank)] / np.sqrt(model.eigenvalues[: min(some, model.rank)])

    def deviations(d: np.ndarray) -> list:
        span = max(int(d.max()), -int(d.min())) + 1
        if (n * span) ** 2 * dims < 1 << 63:
            t = n * d - rest
            return (t * t).sum(axis=1).tolist()
        exact = (sum((n * v - r) ** 2 for v, r in zip(row, rest.tolist())) for row in d.tolist())
        return [v if v < 1 << 63 else None for v in exact]

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            d = matrix(b.column(b.num_columns - 1), dims) - near
            out = np.full((len(d), some), np.nan)
            out[:, : ways.shape[1]] = (d - rest / n) @ ways
            flat = pa.array(out.ravel(), from_pandas=True)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(d) + 1, dtype=np.int32) * some), flat)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(deviations(d), pa.int64()), lists], names=[*names, "deviation", "whitened"])

    names = [f"k{i}" for i in range(len(keep))]
    given = vectors.select(*[F.col(f"`{c}`").alias(k) for c, k in zip(keep, names)], F.col(column).alias("x"))
    schema = ", ".join(f"{k} {given.schema[k].dataType.simpleString()}" for k in names)
    out = given.mapInArrow(run, f"{schema}, deviation long, whitened array<double>")
    return out.select(*[F.col(k).alias(c) for c, k in zip(keep, names)], "deviation", "whitened")


def identity_error(whitened: DataFrame, n: int, components: int, column: str = "whitened") -> float:
    """Largest absolute entry of the covariance of ``column`` (its first ``components``) minus the identity; 0 if there is none."""
    entry = [f"{column}[{i}]" for i in range(components)]
    if not entry:
        return 0.0
    means = np.sum(grouped_sums(whitened, entry), axis=0) / n
    return float(np.abs(covariance(whitened, [f"{e} - {float(m)!r}D" for e, m in zip(entry, means)], n) - np.eye(components)).max())


def whitened_rows(vectors: DataFrame, key: str = "vec_id", embedding: str = "embedding", components: int = 32, scale: int = 64, offset: int = 1_000_000) -> DataFrame:
    """A row for each vector and component: key, component (from 1), n, deviation, whitened, explained, identity_error.

    The fit is over all vectors kept, in integers: ``scale`` times a component, rounded down, plus
    ``offset``. Vectors that are null, empty, or hold null or non-finite entries (or entries whose
    integer is beyond 2^40) are dropped, as are those of another length than most. Repeated and
    null keys keep their rows; equal vectors count each time. A component without variance, as of
    equal vectors alone, has null in ``whitened``, takes no part in ``identity_error`` and explains
    0; with fewer dimensions than ``components`` there are as many components as dimensions.
    Further columns are ignored. Empty table, or no vector left: no rows.
    """
    x = floored(F.col(embedding), scale, BOUND - offset)
    rows = save(vectors.select(F.col(key).alias("key"), F.transform(x, lambda v: v + F.lit(offset)).alias("x")).where("x is not null"), "wh-rows")
    kept, dims = same_length(rows, "x")
    model = fit(kept, dims) if dims else None
    if model is None:
        kind = vectors.schema[key].dataType.simpleString()
        return vectors.sparkSession.createDataFrame([], f"`{key}` {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double")
    out = save(whiten(kept, model, components, ["key"]), "wh-out")
    error = identity_error(out, model.n, min(components, model.rank))
    discard(rows)
    total = float(model.eigenvalues.sum())
    explained = [float(e) / total if i < model.rank else 0.0 for i, e in enumerate(model.eigenvalues[:components])]
    each = out.select("key", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return each.select(
        F.col("key").alias(key), (F.col("at") + 1).cast("int").alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened",
        F.element_at(F.lit(explained), F.col("at") + 1).alias("explained"), F.lit(error).alias("identity_error"),
    )
