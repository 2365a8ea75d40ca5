"""Statistics of rods and of pairs of rods."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import capsule, fields, vec
from ..functions.grid import Grid
from . import cells, spatial
from .rods import stamped

Box = tuple[float, float, float]


def dense(counts: DataFrame, **bins: int) -> DataFrame:
    """A histogram with a row for every bin, n = 0 where nothing fell."""
    frame = counts.sparkSession.range(math.prod(bins.values())).select(*[
        (F.floor(F.col("id") / math.prod(list(bins.values())[i + 1 :])) % n).cast("int").alias(b) for i, (b, n) in enumerate(bins.items())
    ])
    # at most as many rows as bins
    return frame.join(F.broadcast(counts), list(bins), "left").select(*bins, F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def bin_of(value: Column, low: float, width: float, bins: int) -> Column:
    """Bin number; the last bin holds its upper edge."""
    return F.greatest(F.lit(0), F.least(F.floor((value - low) / width), F.lit(bins - 1))).cast("int")


# ---- cells ------------------------------------------------------------------------------------------------------


def occupancy(rods: DataFrame, grid: Grid) -> DataFrame:
    """(cell_id, n) of the cells that hold rods."""
    return stamped(rods, grid).groupBy("cell_id").agg(F.count(F.lit(1)).alias("n"))


def addresses(counts: DataFrame, cells_per_block: int = 1024) -> DataFrame:
    """(cell_id, n, first, past): prefix sums of counts, or of any number, in the order of cells.

    Two levels: within blocks of cells, then over the blocks' sums; the second has
    as many rows as blocks, so no window holds all cells.
    """
    block = F.floor(F.col("cell_id") / cells_per_block)
    each = counts.select("cell_id", "n", block.alias("block"))
    sums = each.groupBy("block").agg(F.sum("n").alias("s"))
    level = F.floor(F.col("block") / cells_per_block)
    tops = sums.groupBy(level.alias("top")).agg(F.sum("s").alias("t"))
    t = tops.select("top", F.coalesce(F.sum("t").over(Window.orderBy("top").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before_top"))
    w = Window.partitionBy("top").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    s = sums.withColumn("top", level).withColumn("before", F.coalesce(F.sum("s").over(w), F.lit(0))).join(t, "top").select("block", (F.col("before") + F.col("before_top")).alias("before"))
    run = Window.partitionBy("block").orderBy("cell_id").rowsBetween(Window.unboundedPreceding, 0)
    out = each.withColumn("run", F.sum("n").over(run)).join(s, "block")
    return out.select("cell_id", "n", (F.col("before") + F.col("run") - F.col("n")).alias("first"), (F.col("before") + F.col("run")).alias("past"))


def quota(rods: DataFrame, cells: DataFrame, seq: str = "rod_id") -> DataFrame:
    """The first ``quota`` rods of each cell, by ``seq``; cells: (cell_id, quota). Rods of cells without a quota go."""
    rank = F.row_number().over(Window.partitionBy("cell_id").orderBy(seq))
    return rods.withColumn("_rank", rank).join(cells, "cell_id").where("_rank <= quota").drop("_rank", "quota")


def misplaced(rods: DataFrame, grid: Grid) -> DataFrame:
    """(cell_id, n, wrong): rods of each claimed cell, and how many of them lie outside it."""
    inside = grid.inside(F.col("cell_id"), F.col("x"), F.col("y"), F.col("z"))
    return rods.groupBy("cell_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(~inside).alias("wrong"))


# ---- rods -------------------------------------------------------------------------------------------------------


def volume(rods: DataFrame, box: Box) -> DataFrame:
    """n, percent of the volume, and total side area."""
    part = F.pi() * F.col("a") * F.col("a") * F.col("l")
    return rods.agg(F.count(F.lit(1)).alias("n"), (F.sum(part) / math.prod(box) * 100.0).alias("percent"), F.sum(fields.side_area(F.col("l"), F.col("a"))).alias("area"))


def nematic_order(rods: DataFrame, director: tuple[float, float, float] = (0.0, 0.0, 1.0)) -> DataFrame:
    """Mean of (3 cos^2 - 1) / 2 to a fixed director. All directions count."""
    c = F.col("cx") * director[0] + F.col("cy") * director[1] + F.col("cz") * director[2]
    return rods.agg(F.count(F.lit(1)).alias("n"), F.avg((3.0 * c * c - 1.0) / 2.0).alias("order"))


def phi_theta_histogram(rods: DataFrame, bins: int = 32) -> DataFrame:
    """(phi_bin, theta_bin, n): theta from the z axis, phi folded to [0, pi]; phi is 0 on the axis."""
    flat = F.sqrt(F.greatest(F.lit(0.0), 1.0 - F.col("cz") * F.col("cz")))
    theta = F.acos(vec.clamp(F.col("cz"), F.lit(-1.0), F.lit(1.0)))
    off = (theta > capsule.EPS) & (theta < math.pi - capsule.EPS)
    phi = F.when(off, F.acos(vec.clamp(F.col("cx") / flat, F.lit(-1.0), F.lit(1.0)))).otherwise(0.0)
    width = math.pi / bins
    got = rods.select(bin_of(phi, 0.0, width, bins).alias("phi_bin"), bin_of(theta, 0.0, width, bins).alias("theta_bin")).groupBy("phi_bin", "theta_bin").agg(F.count(F.lit(1)).alias("n"))
    return dense(got, phi_bin=bins, theta_bin=bins)


def belt_density(rods: DataFrame, bins: int = 32) -> DataFrame:
    """(bin, n, density): rods by the polar angle of their directions, and their number over the area of each belt of the unit sphere."""
    width = math.pi / bins
    theta = F.acos(vec.clamp(F.col("cz"), F.lit(-1.0), F.lit(1.0)))
    got = rods.select(bin_of(theta, 0.0, width, bins).alias("bin")).groupBy("bin").agg(F.count(F.lit(1)).alias("n"))
    return dense(got, bin=bins).withColumn("density", F.col("n") / fields.belt_area(F.col("bin") * width, (F.col("bin") + 1) * width))


# ---- pairs ------------------------------------------------------------------------------------------------------


def touching(rods: DataFrame, box: Box, limit: float, columns: list[str] | None = None, **options) -> DataFrame:
    """Pairs of bodies within ``limit``, with ``columns`` of them, if given: the unbounded axes' nearest places are also the bounded ones."""
    if not options:
        found = spatial.in_cells(rods, box, ("touch", limit), columns or spatial.PAIR)
        if found is not None:
            return found
    found = _touching(rods, box, limit, **options)
    return found if columns is None else found.select(*columns)


#: Columns that the areas and energies of touching pairs need.
BODIES = ["bx", "by", "bz", "c1x", "c1y", "c1z", "l1", "a1", "l2", "a2", "cc", "u1", "u2", "d", "du"]


def _touching(rods: DataFrame, box: Box, limit: float, **options) -> DataFrame:
    return spatial.spatial_join(rods, box, limit, where=F.col("unclamped") & (F.col("du") - F.col("a1") - F.col("a2") < limit), **options)


def contacts_per_rod(rods: DataFrame, box: Box, limit: float) -> DataFrame:
    """(rod_id, n) for every rod; those without contact have 0.

    Each pair is found once and counted at both ends, in its cell; only the counts leave it.
    """
    found = spatial.degrees(rods, box, limit)
    return rods.select("rod_id").join(found, "rod_id", "left").select("rod_id", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def contacts_summary(rods: DataFrame, box: Box, limit: float) -> DataFrame:
    """rods, total (each pair twice), mean and most contacts of a rod."""
    each = contacts_per_rod(rods, box, limit)
    return each.agg(F.count(F.lit(1)).alias("rods"), F.sum("n").alias("total"), F.avg("n").alias("mean"), F.max("n").alias("most"))


def contacts_histogram(rods: DataFrame, box: Box, limit: float) -> DataFrame:
    """(contacts, rods)."""
    return contacts_per_rod(rods, box, limit).groupBy(F.col("n").alias("contacts")).agg(F.count(F.lit(1)).alias("rods"))


def pair_count(rods: DataFrame, box: Box, limit: float) -> DataFrame:
    """pairs of touching bodies, and twice that over the rods."""
    n = rods.count()
    each = spatial.in_cells(rods, box, ("touch", limit), [], reduce=cells.number, schema="n long")
    if each is None:
        each = touching(rods, box, limit, columns=["i"]).select(F.lit(1).alias("n"))
    return each.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("pairs")).select("pairs", (2.0 * F.col("pairs") / F.lit(n or None)).alias("mean"))


def mutual_angles(rods: DataFrame, box: Box, limit: float, bins: int = 32) -> DataFrame:
    """(bin, n): angles in [0, pi/2] between touching bodies."""
    width = (math.pi + capsule.EPS) / 2 / bins
    got = touching(rods, box, limit, columns=["cc"]).select(bin_of(vec.acos_abs(F.col("cc")), 0.0, width, bins).alias("bin")).groupBy("bin").agg(F.count(F.lit(1)).alias("n"))
    return dense(got, bin=bins)


def radial_distribution(rods: DataFrame, box: Box, radius: float, bins: int = 32) -> DataFrame:
    """(bin, n, total, squares, density): pairs of centres by distance, divided by each shell's volume."""
    width = radius / bins
    r = F.col("r")
    each = cells.distances(rods, Grid.for_reach(box, radius), radius, bins)
    if each is None:
        each = spatial.centre_pairs(rods, box, radius).select(bin_of(r, 0.0, width, bins).alias("bin"), F.lit(1).alias("n"), r.alias("total"), (r * r).alias("squares"))
    got = each.groupBy("bin").agg(*[F.sum(c).alias(c) for c in ("n", "total", "squares")])
    # joined once, as each use of the sums would meet the pairs again
    frame = rods.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin")).join(F.broadcast(got), "bin", "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("long"))
    shell = 4.0 / 3.0 * math.pi * (F.pow((F.col("bin") + 1) * width, F.lit(3.0)) - F.pow(F.col("bin") * width, F.lit(3.0)))
    return frame.select("bin", "n", F.coalesce("total", F.lit(0.0)).alias("total"), F.coalesce("squares", F.lit(0.0)).alias("squares"), (F.col("n") / shell).alias("density"))


def excluded_areas(rods: DataFrame, box: Box, limit: float) -> DataFrame:
    """total side area, and excluded area of touching bodies: parallel, skew and naive."""
    whole = rods.agg(F.sum(fields.side_area(F.col("l"), F.col("a")))).first()[0] or 0.0
    each = spatial.in_cells(rods, box, ("touch", limit), BODIES, reduce=cells.areas(limit), schema="pairs long, parallel double, skew double, naive double")
    if each is not None:
        return each.agg(F.lit(whole).alias("area"), F.coalesce(F.sum("pairs"), F.lit(0)).cast("long").alias("pairs"), *[F.coalesce(F.sum(n), F.lit(0.0)).alias(n) for n in ("parallel", "skew", "naive")])
    return touching(rods, box, limit, columns=BODIES).agg(F.lit(whole).alias("area"), F.count(F.lit(1)).alias("pairs"), *[F.coalesce(F.sum(e), F.lit(0.0)).alias(n) for n, e in (("parallel", capsule.excluded_parallel()), ("skew", capsule.excluded_skew()), ("naive", capsule.excluded_naive(limit)))])


#: Surfaces nearer than the spacing of graphite (in micrometres) touch; the law, which grows without bound there, doesn't hold for them.
LEAST_GAP = 3.4e-4


def vdw_energy(rods: DataFrame, box: Box, limit: float, least: float = LEAST_GAP) -> DataFrame:
    """Van der Waals energy of touching bodies: pairs, close, undefined, energy and energy over the rods.

    close: pairs whose surfaces are at most ``least`` apart, which the energy leaves
    out. undefined: pairs beyond it for which the law has no value (the opening angle is 0 or the cut-off lies
    inside the other tube), left out as well. No pair: energy 0.
    """
    n = rods.count()
    each = spatial.in_cells(rods, box, ("touch", limit), BODIES, reduce=cells.energies(limit, least), schema="pairs long, close long, undefined long, energy double")
    if each is not None:
        out = each.agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in ("pairs", "close", "undefined")], F.coalesce(F.sum("energy"), F.lit(0.0)).alias("energy"))
    else:
        each = touching(rods, box, limit, columns=BODIES).select(capsule.pair_energy(limit).alias("e"), (F.col("du") - F.col("a1") - F.col("a2") <= least).alias("close"))
        bad = F.col("e").isNull() | F.isnan("e")
        out = each.agg(F.count(F.lit(1)).alias("pairs"), F.count_if("close").alias("close"), F.count_if(~F.col("close") & bad).alias("undefined"), F.coalesce(F.sum(F.when(~F.col("close") & ~bad, F.col("e"))), F.lit(0.0)).alias("energy"))
    return out.select("*", (F.col("energy") / F.lit(n or None)).alias("per_rod"))


def least_contacts(rods: DataFrame, box: Box, limit: float) -> DataFrame:
    """fewest, most: the least and largest number of contacts of a rod."""
    return contacts_per_rod(rods, box, limit).agg(F.min("n").alias("fewest"), F.max("n").alias("most"))


def mean_of_ratios(df: DataFrame, value: str, count: str) -> DataFrame:
    """(n, mean): the mean of value / count over rows with a count that is not 0 nor null."""
    ratio = F.when(F.col(count) != 0, F.col(value) / F.col(count))
    return df.agg(F.count(ratio).alias("n"), F.avg(ratio).alias("mean"))
