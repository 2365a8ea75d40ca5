"""Populating a box: candidates by rejection, elimination of intersections, batches until the target is met."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import fields, vec
from ..functions.grid import Grid
from ..plans.tables import discard, keep
from . import density, orient, spatial

Box = tuple[float, float, float]

# Coefficients of a published rational approximation of the inverse error function (Giles 2010).
_NEAR = (2.81022636e-08, 3.43273939e-07, -3.5233877e-06, -4.39150654e-06, 0.00021858087, -0.00125372503, -0.00417768164, 0.246640727, 1.50140941)
_FAR = (-0.000200214257, 0.000100950558, 0.00134934322, -0.00367342844, 0.00573950773, -0.0076224613, 0.00943887047, 1.00167406, 2.83297682)


def erfinv(x: Column) -> Column:
    """Inverse error function, to about 1e-7, for |x| < 1."""
    w = -F.log((1.0 - x) * (1.0 + x))

    def horner(v: Column, c: tuple) -> Column:
        p = F.lit(c[0])
        for k in c[1:]:
            p = p * v + k
        return p

    return x * F.when(w < 5.0, horner(w - 2.5, _NEAR)).otherwise(horner(F.sqrt(w) - 3.0, _FAR))


def truncated_normal(u: Column, mean, sigma: float, half_width: float) -> Column:
    """Symmetric bounded law about ``mean`` as the generator defines it: mean + 2 sigma sqrt(2) erfinv(F (1 - 2u)), F = erf(-half_width / (sigma sqrt 2)) / 2."""
    f = 0.5 * math.erf(-half_width / sigma / math.sqrt(2))
    return mean + 2 * sigma * math.sqrt(2) * erfinv(f * (1.0 - 2.0 * u))


@dataclass(frozen=True)
class Model:
    """Orientation: uniform where a spread is None, else bounded normal about the mean; then turned by (mu, xi)."""

    theta: float = 0.0
    theta_sd: float | None = None
    phi: float = 0.0
    phi_sd: float | None = None
    mu: float = 0.0
    xi: float = 0.0


def directions(u: Column, v: Column, model: Model) -> vec.Vec:
    """Unit vectors from two uniform numbers."""
    cz = 2.0 * u - 1.0 if model.theta_sd is None else F.cos(truncated_normal(u, model.theta, model.theta_sd, math.pi / 2))
    phi = 2.0 * math.pi * v if model.phi_sd is None else truncated_normal(v, model.phi, model.phi_sd, math.pi)
    flat = F.sqrt(F.greatest(F.lit(0.0), 1.0 - cz * cz))
    c = (flat * F.cos(phi), flat * F.sin(phi), cz)
    return c if model.mu == 0 and model.xi == 0 else vec.to_frame(c, F.lit(model.mu), F.lit(-model.xi))


def candidates(spark: SparkSession, first: int, count: int, box: Box, length: float, radius: float, seed: int = 1, model: Model = Model(), mesh: DataFrame | None = None, ext: density.Ext | None = None) -> DataFrame:
    """Rods with ids from ``first``; those whose place the density mesh refuses are missing.

    Every number comes from the id and the seed, so a lost task makes the same rods again.
    """
    s = F.col("id")
    u = lambda k: fields.uniform(s, seed * 64 + k)
    df = spark.range(first, first + count).select(s.alias("rod_id"), *[(u(k) * n).alias(v) for k, (v, n) in enumerate(zip("xyz", box))], u(3).alias("_u"), u(4).alias("_v"), u(5).alias("_w"))
    if mesh is not None:
        df = density.sample(df, mesh, ext, box).where(F.col("_w") < F.col("rho"))
    c = directions(F.col("_u"), F.col("_v"), model)
    return df.select("rod_id", "x", "y", "z", *[e.alias(n) for e, n in zip(c, ("cx", "cy", "cz"))], F.lit(length).alias("l"), F.lit(radius).alias("a"))


def step(batch: DataFrame, old: DataFrame | None, box: Box, separation: float = 0.0, soft: float = 1.0, cluster: tuple[float, float] | None = None) -> DataFrame:
    """The rods of a batch that stay: snapped to old ones if ``cluster`` (distance, angle) is given, inserted in the order of ids, clear of ``old``."""
    if old is not None:
        if cluster:
            batch = spatial.clusterise(batch, old, box, *cluster, separation)
        batch = keep(spatial.eliminate_against(batch, old, box, separation, soft), "gen-clear")
    return spatial.greedy_insert(batch, box, keep, separation, soft)


def populate(spark: SparkSession, box: Box, length: float, radius: float, rods: int, seed: int = 1, precision: float = 0.01, separation: float = 0.0, soft: float = 1.0, model: Model = Model(), mesh: DataFrame | None = None, ext: density.Ext | None = None, cluster: tuple[float, float] | None = None, rounds: int = 1000, surplus: float = 1.2, at: tuple[float, ...] = (), on_state: Callable[[float, DataFrame], None] | None = None, align_every: int = 0) -> DataFrame:
    """At least rods * (1 - precision) rods, none intersecting, or as many as fit: stops when a round adds none.

    ``at``: volume percents at which ``on_state`` gets the rods so far. ``align_every``:
    after so many rounds the rods are thinned out to the spread of their cells' axes.
    Each round is a candidate batch, two spatial joins and one table.
    """
    total, first, state, todo, shown = 0, 0, None, sorted(at), False
    for turn in range(rounds):
        want = max(64, math.ceil((rods - total) * surplus))
        batch = keep(candidates(spark, first, want, box, length, radius, seed, model, mesh, ext), "gen-batch")
        first += want
        new = step(batch, state, box, separation, soft, cluster)
        old, state = state, keep(new if state is None else state.unionByName(new), "gen-state")
        discard(batch, None if shown else old)
        was, total, shown = total, state.count(), False
        while todo and todo[0] <= total * math.pi * radius**2 * length / math.prod(box) * 100:
            if on_state:
                on_state(todo[0], state)
                shown = True  # whoever got the table may still read it
            todo.pop(0)
        if total >= rods * (1 - precision) or total == was:
            break
        if align_every and (turn + 1) % align_every == 0:
            grid = Grid.for_reach(box, length + 2 * radius)
            old, state = state, keep(orient.thin_out(state, grid, orient.realigned(state, grid), seed + turn), "gen-thin")
            discard(None if shown else old)
            total, shown = state.count(), False
    return state


def kd_partition(rods: DataFrame, grid: Grid, most: int = 1024) -> DataFrame:
    """(leaf, x0, x1, y0, y1, z0, z1, n): boxes of cells with at most ``most`` rods (or one cell), split at the plane nearest to equal loads.

    The tree is planned from counts of cells, one row a cell, level by level in Spark:
    for each open box the best plane is the one with the least difference of loads.
    """
    ix, iy, iz = grid.split(F.col("cell_id"))
    cells = keep(rods.groupBy(grid.join_id(F.col("x"), F.col("y"), F.col("z")).alias("cell_id")).agg(F.count(F.lit(1)).alias("n")).select(ix.alias("c0"), iy.alias("c1"), iz.alias("c2"), "n", F.lit(1).cast("long").alias("leaf")), "kd")
    ends = [F.struct(F.lit(0).alias("lo"), F.lit(n).alias("hi")) for n in grid.ext]
    boxes = cells.sparkSession.range(1, 2).select(F.col("id").alias("leaf"), *[e.alias(f"b{i}") for i, e in enumerate(ends)])
    while True:  # ends, as every round makes the open boxes smaller
        load = cells.groupBy("leaf").agg(F.sum("n").alias("n"))
        wide = F.greatest(*[F.col(f"b{i}.hi") - F.col(f"b{i}.lo") for i in range(3)])
        open_ = keep(boxes.join(load, "leaf").where((F.col("n") > most) & (wide > 1)), "kd-open")
        if not open_.limit(1).count():
            break
        cuts = None
        for i in range(3):
            lines = cells.join(open_.select("leaf", F.col("n").alias("total"), F.col(f"b{i}.lo").alias("lo"), F.col(f"b{i}.hi").alias("hi")), "leaf").groupBy("leaf", "total", "lo", "hi", F.col(f"c{i}").alias("c")).agg(F.sum("n").alias("n"))
            run = F.sum("n").over(Window.partitionBy("leaf").orderBy("c").rowsBetween(Window.unboundedPreceding, 0))
            one = lines.withColumn("left", run).where(F.col("c") + 1 < F.col("hi")).select("leaf", F.lit(i).alias("axis"), (F.col("c") + 1).alias("cut"), F.abs(F.col("total") - 2 * F.col("left")).alias("off"))
            edge = open_.where(F.col(f"b{i}.hi") - F.col(f"b{i}.lo") > 1).select("leaf", F.lit(i).alias("axis"), F.floor((F.col(f"b{i}.lo") + F.col(f"b{i}.hi")) / 2).cast("int").alias("cut"), F.col("n").alias("off"))
            cuts = one.union(edge) if cuts is None else cuts.union(one).union(edge)
        best = keep(cuts.groupBy("leaf").agg(F.min(F.struct("off", "axis", "cut")).alias("p")).select("leaf", "p.axis", "p.cut"), "kd-cut")
        value = F.when(F.col("axis") == 0, F.col("c0")).when(F.col("axis") == 1, F.col("c1")).otherwise(F.col("c2"))
        child = F.when(F.col("axis").isNull(), F.col("leaf")).otherwise(F.col("leaf") * 2 + F.when(value >= F.col("cut"), 1).otherwise(0))
        before = cells, boxes, open_, best
        cells = keep(cells.join(best, "leaf", "left").select("c0", "c1", "c2", "n", child.alias("leaf")), "kd")
        split = boxes.join(best, "leaf", "left").withColumn("side", F.explode(F.when(F.col("axis").isNull(), F.array(F.lit(-1))).otherwise(F.array(F.lit(0), F.lit(1)))))
        halves = [F.struct(F.when((F.col("axis") == i) & (F.col("side") == 1), F.col("cut")).otherwise(F.col(f"b{i}.lo")).cast("int").alias("lo"), F.when((F.col("axis") == i) & (F.col("side") == 0), F.col("cut")).otherwise(F.col(f"b{i}.hi")).cast("int").alias("hi")).alias(f"b{i}") for i in range(3)]
        boxes = keep(split.select(F.when(F.col("side") < 0, F.col("leaf")).otherwise(F.col("leaf") * 2 + F.col("side")).alias("leaf"), *halves), "kd-boxes")
        discard(*before)
    load = cells.groupBy("leaf").agg(F.sum("n").alias("n"))
    return boxes.join(load, "leaf", "left").select("leaf", *[F.col(f"b{i}.{e}").alias(f"{v}{k}") for i, v in enumerate("xyz") for k, e in enumerate(("lo", "hi"))], F.coalesce("n", F.lit(0)).cast("long").alias("n"))
