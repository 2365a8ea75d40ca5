"""Density meshes: sampling, integrals, deposition, agglomerates, conductivity maps.

A mesh is a table (i, j, k, rho) of nx * ny * nz nodes in a periodic box. Node (i, j, k)
lies at the middle of its voxel.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fields
from ..functions.grid import Grid
from ..plans.tables import keep
from . import spatial
from .stats import addresses

Ext = tuple[int, int, int]
Box = tuple[float, float, float]


def constant(spark: SparkSession, ext: Ext, rho: float = 0.5) -> DataFrame:
    nx, ny, nz = ext
    n = F.col("id")
    return spark.range(nx * ny * nz).select((n % nx).cast("int").alias("i"), (F.floor(n / nx) % ny).cast("int").alias("j"), F.floor(n / (nx * ny)).cast("int").alias("k"), F.lit(float(rho)).alias("rho"))


def from_values(values: DataFrame, ext: Ext, order: str = "C") -> DataFrame:
    """Mesh from (pos, rho), pos counted from 0. order F: i runs fastest; C: k runs fastest."""
    nx, ny, nz = ext
    p = F.col("pos")
    i, j, k = ((p % nx), F.floor(p / nx) % ny, F.floor(p / (nx * ny))) if order == "F" else (F.floor(p / (ny * nz)), F.floor(p / nz) % ny, p % nz)
    return values.select(i.cast("int").alias("i"), j.cast("int").alias("j"), k.cast("int").alias("k"), "rho")


def _placed(points: DataFrame, ext: Ext, box: Box) -> DataFrame:
    """``points`` with the lowest of the 8 nodes around each (_ni, _nj, _nk) and the place between the nodes (_fi, _fj, _fk in [0, 1))."""
    out = points
    for v, m, n, length in zip("xyz", "ijk", ext, box):
        at = F.col(v) / length * n - 0.5
        out = out.withColumn(f"_n{m}", F.pmod(F.floor(at), F.lit(n)).cast("int")).withColumn(f"_f{m}", at - F.floor(at))
    return out


#: The corners of a voxel, as steps along the axes.
CORNERS = [(c & 1, c >> 1 & 1, c >> 2) for c in range(8)]


def _weight(corner: tuple[int, int, int]) -> Column:
    """Trilinear weight of a corner at the place of ``_placed``."""
    x, y, z = (F.col(f"_f{m}") if up else 1.0 - F.col(f"_f{m}") for m, up in zip("ijk", corner))
    return x * y * z


#: Nodes along an edge of a tile.
TILE = 8


def tiles(mesh: DataFrame, ext: Ext) -> DataFrame:
    """(_ti, _tj, _tk, _values): the mesh as blocks of TILE^3 nodes, each with the next layer of nodes along each axis.

    _values: rho of the block's nodes, k runs fastest; a tile at the end of an axis is smaller. Nodes that are missing or null are 0,
    repeated nodes add up. A tile whose nodes are all missing is missing.
    """
    axis = []
    for m, n in zip("ijk", ext):
        count, own = -(-n // TILE), F.floor(F.col(m) / TILE).cast("int")
        # a tile's first layer closes the tile before it; the mesh wraps
        before = F.pmod(own - 1, F.lit(count))
        place = lambda t, p: F.struct(t.cast("int").alias("t"), p.cast("int").alias("p"))
        last = F.least(F.lit(TILE), n - before * TILE)
        axis.append(F.when(F.col(m) % TILE == 0, F.array(place(own, F.col(m) % TILE), place(before, last))).otherwise(F.array(place(own, F.col(m) % TILE))))
    each = mesh.select(F.coalesce(F.col("rho").cast("double"), F.lit(0.0)).alias("rho"), *[a.alias(f"_a{m}") for a, m in zip(axis, "ijk")])
    for m in "ijk":
        each = each.withColumn(f"_a{m}", F.explode(f"_a{m}"))
    di, dj, dk = _dims(ext, *[F.col(f"_a{m}.t") for m in "ijk"])
    slot = (F.col("_ai.p") * dj + F.col("_aj.p")) * dk + F.col("_ak.p")
    each = each.select(*[F.col(f"_a{m}.t").alias(f"_t{m}") for m in "ijk"], F.struct(slot.cast("int").alias("slot"), "rho").alias("node"))
    held = each.groupBy("_ti", "_tj", "_tk").agg(F.collect_list("node").alias("nodes"))
    di, dj, dk = _dims(ext, *[F.col(f"_t{m}") for m in "ijk"])
    full = di * dj * dk
    whole = (F.size("nodes") == full) & (F.size(F.array_distinct("nodes.slot")) == full)
    sparse = F.transform(F.sequence(F.lit(0), full - 1), lambda s: F.aggregate(F.filter("nodes", lambda x: x["slot"] == s), F.lit(0.0), lambda a, x: a + x["rho"]))
    return held.select("_ti", "_tj", "_tk", F.when(whole, F.transform(F.array_sort("nodes"), lambda x: x["rho"])).otherwise(sparse).alias("_values"))


def _dims(ext: Ext, *tile: Column) -> list[Column]:
    """Nodes of a tile along each axis, with the layer that closes it."""
    return [F.least(F.lit(TILE), n - t * TILE) + 1 for n, t in zip(ext, tile)]


def sample(points: DataFrame, mesh: DataFrame, ext: Ext, box: Box) -> DataFrame:
    """``points`` (x, y, z) with rho at their place, by trilinear interpolation.

    A point meets its tile alone, so it is shuffled once and once only, whatever tells
    points apart; repeated points keep their rows. Nodes that the mesh lacks count as 0; a point without a place
    has 0. A column rho of ``points`` is replaced.
    """
    at = _placed(points.drop("rho"), ext, box).select("*", *[F.floor(F.col(f"_n{m}") / TILE).cast("int").alias(f"_t{m}") for m in "ijk"])
    joined = at.join(tiles(mesh, ext), ["_ti", "_tj", "_tk"], "left")
    _, dj, dk = _dims(ext, *[F.col(f"_t{m}") for m in "ijk"])
    i, j, k = (F.col(f"_n{m}") % TILE for m in "ijk")
    value = lambda c: F.get("_values", (((i + c[0]) * dj + j + c[1]) * dk + k + c[2]).cast("int"))
    rho = sum((_weight(c) * value(c) for c in CORNERS[1:]), _weight(CORNERS[0]) * value(CORNERS[0]))
    return joined.select(*[F.col(c) for c in points.columns if c != "rho"], F.coalesce(rho, F.lit(0.0)).alias("rho"))


def deposit(points: DataFrame, ext: Ext, box: Box) -> DataFrame:
    """(i, j, k, rho): each point spread over the 8 nodes around it. Points without a place are left out.

    Tasks sum by node before anything is shuffled, so a task sends a node at most once.
    """
    at = _placed(points.select("x", "y", "z").dropna(), ext, box)
    node = lambda c: F.struct(*[F.pmod(F.col(f"_n{m}") + step, F.lit(size)).cast("int").alias(m) for m, step, size in zip("ijk", c, ext)], _weight(c).alias("w"))
    return at.select(F.explode(F.array(*[node(c) for c in CORNERS])).alias("n")).select("n.*").groupBy("i", "j", "k").agg(F.sum("w").alias("rho"))


def relative(mesh: DataFrame, ext: Ext) -> DataFrame:
    """``mesh`` over its largest value, 0 at nodes that it lacks; all nodes are there. A mesh without a value above 0 is 0 throughout."""
    top = mesh.agg(F.max("rho")).first()[0] or 0.0
    every = constant(mesh.sparkSession, ext).drop("rho").join(mesh, ["i", "j", "k"], "left")
    return every.select("i", "j", "k", (F.coalesce("rho", F.lit(0.0)) / F.lit(top if top > 0 else 1.0)).alias("rho"))


def cell_integrals(mesh: DataFrame, ext: Ext, box: Box, grid: Grid, samples: int = 10) -> DataFrame:
    """(cell_id, rho): mean density of each cell, over samples^3 places in it.

    The weights of a node are products of one weight for each axis, so the sum over
    places is taken axis by axis: a node meets the few cells beside it, three times, and no place has a row.
    """
    n = F.col("id")
    now, left = mesh.select("i", "j", "k", "rho"), ["i", "j", "k"]
    for m, nodes, cells, gl, bl in zip("ijk", ext, grid.ext, grid.box, box):
        at = (F.floor(n / samples) + (n % samples + 0.5) / samples) * (gl / cells) / bl * nodes - 0.5
        ends = F.array(*[F.struct(F.pmod(F.floor(at) + up, F.lit(nodes)).cast("int").alias("m"), (at - F.floor(at) if up else 1.0 - (at - F.floor(at))).alias("w")) for up in (0, 1)])
        each = mesh.sparkSession.range(cells * samples).select(F.floor(n / samples).cast("int").alias(f"_c{m}"), F.explode(ends).alias("_e"))
        weights = each.groupBy(f"_c{m}", F.col("_e.m").alias(m)).agg((F.sum("_e.w") / samples).alias("_w"))
        left = [f"_c{m}", *[c for c in left if c != m]]
        now = now.join(weights, m).groupBy(*left).agg(F.sum(F.col("_w") * F.col("rho")).alias("rho"))
    return now.select(grid.compose(*[F.col(f"_c{m}") for m in "ijk"]).alias("cell_id"), "rho")


def quotas(integrals: DataFrame, rods: int, margin: float = 0.0) -> DataFrame:
    """(cell_id, quota): rods of each cell in proportion to its mean density, rounded."""
    total = integrals.agg(F.sum("rho")).first()[0] or 1.0
    return integrals.select("cell_id", F.floor(F.col("rho") / total * rods * (1 + margin) + 0.5).cast("int").alias("quota"))


def difference(mesh: DataFrame, other: DataFrame) -> DataFrame:
    """(i, j, k, rho): the first less the second, node by node."""
    return mesh.join(other.withColumnRenamed("rho", "_o"), ["i", "j", "k"]).select("i", "j", "k", (F.col("rho") - F.col("_o")).alias("rho"))


def agglomerate_mesh(spark: SparkSession, balls: DataFrame, ext: Ext, slope: float, periodic: bool = False) -> DataFrame:
    """(i, j, k, rho): at each node the largest norm * double sigmoid of the distance to a ball (id, x, y, z, w, norm), in the unit box.

    Each ball meets only the nodes where the sigmoid exceeds 1e-12, by index ranges.
    Nodes count from 1 at one step from the origin, as the mesh tool has them.
    """
    step = [1.0 / n for n in ext]
    reach = F.col("w") + 28.0 / slope
    df = balls
    for v, n, s, m in zip("xyz", ext, step, "ijk"):
        low, high = F.ceil((F.col(v) - reach) / s), F.floor((F.col(v) + reach) / s)
        span = F.sequence(low, high) if periodic else F.sequence(F.greatest(low, F.lit(1)), F.least(high, F.lit(n)))
        ok = F.lit(True) if periodic else (high >= 1) & (low <= n)
        df = df.where(ok & (low <= high)).withColumn(f"_{m}", F.explode(span))
    gap = [F.col(v) - F.col(f"_{m}") * s for v, m, s in zip("xyz", "ijk", step)]
    d = F.sqrt(gap[0] * gap[0] + gap[1] * gap[1] + gap[2] * gap[2])
    node = [(F.pmod(F.col(f"_{m}") - 1, F.lit(n)).cast("int") if periodic else (F.col(f"_{m}") - 1).cast("int")).alias(m) for m, n in zip("ijk", ext)]
    hit = df.select(*node, (F.col("norm") * fields.double_sigmoid(d, 0.0, F.col("w"), slope)).alias("rho")).groupBy("i", "j", "k").agg(F.max("rho").alias("rho"))
    return constant(spark, ext, 0.0).drop("rho").join(hit, ["i", "j", "k"], "left").select("i", "j", "k", F.greatest(F.coalesce("rho", F.lit(0.0)), F.lit(0.0)).alias("rho"))


def conductivity_map(mesh: DataFrame, matrix: float, filler: float, threshold: float, power: float) -> DataFrame:
    return mesh.select("i", "j", "k", fields.percolation(F.col("rho"), matrix, filler, threshold, power).alias("sigma"))


def appended(mesh: DataFrame, ext: Ext) -> DataFrame:
    """The mesh with its first layers repeated behind the last along each axis."""
    out = mesh
    for c, n in zip("ijk", ext):
        out = out.unionByName(out.where(F.col(c) == 0).withColumn(c, F.lit(n)))
    return out


MOST_DRAWS = 1 << 24


def agglomerates(spark: SparkSession, volume: float, mean_radius: float, spread: float, seed: int = 1, candidates: int = 4096) -> DataFrame:
    """(id, x, y, z, w, norm) in the unit box: balls with log-normal radii that do not overlap, up to 1.05 times ``volume``.

    Candidates are drawn in order; a radius is accepted by its density, a ball if it
    overlaps none accepted before. From ``candidates`` on, draws double until the volume is
    reached or a doubling adds no ball; earlier balls stay as they are, as later draws
    never displace them. Raises if the volume is not reached by MOST_DRAWS.
    """
    s = F.col("id")
    u = lambda k: fields.uniform(s, seed * 16 + k)
    w = u(3) * mean_radius * 4.0
    most = fields.log_normal(F.lit(mean_radius), mean_radius, spread) * 1.5
    drawn = lambda n: spark.range(n).select(s.alias("rod_id"), u(0).alias("x"), u(1).alias("y"), u(2).alias("z"), w.alias("w"), u(4).alias("u")).where((F.col("u") * most < fields.log_normal(F.col("w"), mean_radius, spread)) & (F.col("w") > 0))
    # a ball is a rod without length
    rods = lambda n: drawn(n).select("rod_id", "x", "y", "z", F.lit(0.0).alias("cx"), F.lit(0.0).alias("cy"), F.lit(1.0).alias("cz"), F.lit(0.0).alias("l"), F.col("w").alias("a"))
    centres = F.sqrt(F.col("bx") * F.col("bx") + F.col("by") * F.col("by") + F.col("bz") * F.col("bz"))
    before = -1
    while True:
        stay = keep(spatial.greedy_insert(keep(rods(candidates), "balls"), (1.0, 1.0, 1.0), keep, then=lambda p: p.withColumn("d", centres)), "balls")
        count, filled = stay.agg(F.count(F.lit(1)), F.sum(4.0 / 3.0 * F.pi() * F.pow(F.col("a"), F.lit(3.0)))).first()
        if (filled or 0.0) >= volume * 1.05 or count == before:
            break
        before, candidates = count, candidates * 2
        if candidates > MOST_DRAWS:
            raise RuntimeError("the volume of the balls is not reached")
    filled = addresses(stay.select(F.col("rod_id").alias("cell_id"), (4.0 / 3.0 * F.pi() * F.pow(F.col("a"), F.lit(3.0))).alias("n")))
    return stay.join(filled.where(F.col("first") < volume * 1.05).select(F.col("cell_id").alias("rod_id")), "rod_id").select(F.col("rod_id").alias("id"), "x", "y", "z", F.col("a").alias("w"), F.lit(1.0).alias("norm"))
