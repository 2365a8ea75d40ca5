"""Orientation by cells: moments, principal axes, mean directions, spreads, thinning out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fields, vec
from ..functions.grid import Grid
from .rods import stamped

MOMENTS = ["xx", "yy", "zz", "xy", "xz", "yz"]


def moments(rods: DataFrame, grid: Grid) -> DataFrame:
    """(cell_id, n, xx, yy, zz, xy, xz, yz): mean products of direction components. Empty cells have no row."""
    return stamped(rods, grid).groupBy("cell_id").agg(F.count(F.lit(1)).alias("n"), *[F.avg(F.col("c" + m[0]) * F.col("c" + m[1])).alias(m) for m in MOMENTS])


def principal(cells: DataFrame) -> DataFrame:
    """(cell_id, n, l1, l2, l3, px, py, pz): eigenvalues by size, and the first axis with its last non-zero component positive."""
    df = vec.symmetric_axes(cells.select("cell_id", "n", *MOMENTS), tuple(MOMENTS))
    first = F.col("axes")[0]
    last = F.when(F.abs(first["z"]) > 1e-12, first["z"]).when(F.abs(first["y"]) > 1e-12, first["y"]).otherwise(first["x"])
    sign = F.when(last < 0, -1.0).otherwise(1.0)
    return df.select("cell_id", "n", *[F.col("axes")[i]["w"].alias(f"l{i + 1}") for i in range(3)], *[(first[v] * sign).alias("p" + v) for v in "xyz"])


def mean_directions(rods: DataFrame, grid: Grid, least: float = 0.5) -> DataFrame:
    """(cell_id, n, strength, mx, my, mz, angle, spread).

    Directions are turned to z >= 0. strength = |mean direction|. Where it exceeds
    ``least``: the unit mean direction, and mean and standard deviation of the angles
    to it; else nulls.
    """
    s = F.when(F.col("cz") < 0, -1.0).otherwise(1.0)
    each = stamped(rods, grid).select("cell_id", *[(F.col(c) * s).alias(c) for c in ("cx", "cy", "cz")])
    mean = each.groupBy("cell_id").agg(F.count(F.lit(1)).alias("n"), F.avg("cx").alias("ax"), F.avg("cy").alias("ay"), F.avg("cz").alias("az"))
    mean = mean.withColumn("strength", F.sqrt(F.col("ax") * F.col("ax") + F.col("ay") * F.col("ay") + F.col("az") * F.col("az")))
    unit = [F.when(F.col("strength") > least, F.col("a" + v) / F.col("strength")).alias("m" + v) for v in "xyz"]
    mean = mean.select("cell_id", "n", "strength", *unit)
    angle = vec.angle_between(vec.cols("cx", "cy", "cz"), vec.cols("mx", "my", "mz"))
    far = each.join(mean.where("mx is not null").select("cell_id", "mx", "my", "mz"), "cell_id").groupBy("cell_id").agg(F.avg(angle).alias("angle"), F.stddev_pop(angle).alias("spread"))
    return mean.join(far, "cell_id", "left")


def angle_stats(rods: DataFrame, grid: Grid, mu: float = 0.0, xi: float = 0.0) -> DataFrame:
    """(cell_id, n, phi, phi_sd, theta, theta_sd): mean and standard deviation of the angles of directions turned back from (mu, xi)."""
    c = vec.rotate_y(vec.rotate_z(vec.cols("cx", "cy", "cz"), F.lit(mu)), F.lit(xi))
    theta, phi = vec.angles(c)
    each = stamped(rods, grid).select("cell_id", theta.alias("t"), phi.alias("p"))
    return each.groupBy("cell_id").agg(F.count(F.lit(1)).alias("n"), F.avg("p").alias("phi"), F.stddev_pop("p").alias("phi_sd"), F.avg("t").alias("theta"), F.stddev_pop("t").alias("theta_sd"))


def overall(cells: DataFrame) -> DataFrame:
    """Mean over cells of the columns of ``angle_stats``."""
    return cells.agg(*[F.avg(c).alias(c) for c in ("phi", "phi_sd", "theta", "theta_sd")])


def realigned(rods: DataFrame, grid: Grid) -> DataFrame:
    """(cell_id, mu, xi, phi, phi_sd, theta, theta_sd) for the next batch: each cell's principal axis as two angles, and the spread of directions about it."""
    axis = principal(moments(rods, grid))
    xi = F.atan2(F.sqrt(F.col("px") * F.col("px") + F.col("py") * F.col("py")), F.col("pz"))
    mu = F.atan2(F.col("py"), F.col("px"))
    turn = axis.select("cell_id", mu.alias("mu"), xi.alias("xi"))
    each = stamped(rods, grid).join(turn, "cell_id")
    c = vec.rotate_y(vec.rotate_z(vec.cols("cx", "cy", "cz"), -F.col("mu")), -F.col("xi"))
    theta, phi = vec.angles(c)
    each = each.select("cell_id", "mu", "xi", theta.alias("t"), phi.alias("p"))
    return each.groupBy("cell_id", "mu", "xi").agg(F.avg("p").alias("phi"), F.stddev_pop("p").alias("phi_sd"), F.avg("t").alias("theta"), F.stddev_pop("t").alias("theta_sd"))


def thin_out(rods: DataFrame, grid: Grid, model: DataFrame, seed: int = 1, factor: float = 2.0) -> DataFrame:
    """Rods that survive: a rod goes if factor * p < u, p the product of its angles' likelihoods in its cell's ``model`` (``realigned``).

    u comes from the rod's id, so the result is the same at every run. A null spread, or one
    below 1e-9, which is rounding, has likelihood 1.
    """
    each = stamped(rods, grid).join(model, "cell_id", "left")
    c = vec.rotate_y(vec.rotate_z(vec.cols("cx", "cy", "cz"), -F.coalesce("mu", F.lit(0.0))), -F.coalesce("xi", F.lit(0.0)))
    theta, phi = vec.angles(c)
    like = lambda v, m, s: F.when(F.col(s) > 1e-9, F.exp(-F.pow((v - F.col(m)) / F.col(s), F.lit(2.0)) / 2.0)).otherwise(1.0)
    p = like(theta, "theta", "theta_sd") * like(phi, "phi", "phi_sd")
    return each.where(factor * p >= fields.uniform(F.col("rod_id"), seed)).select(*rods.columns)
