"""Rod tables: the common schema, rods derived from other tables, periodic replication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.grid import Grid
from ..functions.vec import let

ROD = ["rod_id", "x", "y", "z", "cx", "cy", "cz", "l", "a"]
#: Fixed values of the derivation: multiplier, offset and modulus of each coordinate.
PLACE = {"x": (7919, 13, 10007), "y": (104729, 7, 10009), "z": (1299709, 3, 10037)}
TURN = {"pa": (15485863, 1, 2003, 1001.0), "pb": (32452843, 5, 2011, 1005.0)}


def derived(df: DataFrame, key: str, length: float | Column, radius: float | Column) -> DataFrame:
    """Rods in the unit box from a unique integer key: hashed places, directions by stereographic projection.

    The same numbers come out of any engine with 64-bit integers and IEEE doubles.
    """
    k = F.col(key).cast("long")
    place = [((k * m + o) % n).cast("double") / float(n) for m, o, n in PLACE.values()]
    turn = [((k * m + o) % n).cast("double") / s - 1.0 for m, o, n, s in TURN.values()]
    df = df.select(k.alias("rod_id"), *[p.alias(n) for n, p in zip(PLACE, place)], *[t.alias(n) for n, t in zip(TURN, turn)], _c(length).alias("l"), _c(radius).alias("a"))
    pa, pb = F.col("pa"), F.col("pb")
    df = let(df, q=pa * pa + pb * pb)
    q = F.col("q")
    return df.select("rod_id", "x", "y", "z", (2.0 * pa / (1.0 + q)).alias("cx"), (2.0 * pb / (1.0 + q)).alias("cy"), ((q - 1.0) / (1.0 + q)).alias("cz"), "l", "a")


def _c(v) -> Column:
    return v if isinstance(v, Column) else F.lit(float(v))


def from_embeddings(df: DataFrame, key: str = "vec_id", embedding: str = "embedding", length: float = 0.1, radius: float = 0.005) -> DataFrame:
    """Rods from the first six components of an array: three for the place (wrapped to the unit box), three for the direction."""
    e = [F.element_at(embedding, i + 1).cast("double") for i in range(6)]
    df = df.select(F.col(key).alias("rod_id"), *[(v - F.floor(v)).alias(n) for v, n in zip(e, "xyz")], *[v.alias(n) for v, n in zip(e[3:], ("dx", "dy", "dz"))])
    n = F.sqrt(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy") + F.col("dz") * F.col("dz"))
    df = let(df, n=n).where("n > 0")
    return df.select("rod_id", "x", "y", "z", *[(F.col(d) / F.col("n")).alias(c) for d, c in zip(("dx", "dy", "dz"), ("cx", "cy", "cz"))], F.lit(length).alias("l"), F.lit(radius).alias("a"))


def live(rods: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """Rods with a length; tombstones and nulls go."""
    return rods.where(F.col("l") > tolerance)


def stamped(rods: DataFrame, grid: Grid) -> DataFrame:
    """With cell_id."""
    return rods.withColumn("cell_id", grid.join_id(F.col("x"), F.col("y"), F.col("z")))


def expand(rods: DataFrame, grid: Grid, axis: int, layers: int) -> DataFrame:
    """Copies of ``layers`` cell layers at both ends of an axis, beyond the opposite ends.

    Adds origin (the id before) and role (internal, source, sink); ids become
    3 * id + 0, 1, 2 for the rod, its copy before the box and its copy behind it.
    """
    v, length = "xyz"[axis], grid.box[axis]
    wide = layers * length / grid.ext[axis]
    copies = F.filter(F.array(
        F.struct(F.lit(0).alias("n"), F.lit(0.0).alias("by"), F.lit("internal").alias("role")),
        F.when(F.col(v) >= length - wide, F.struct(F.lit(1).alias("n"), F.lit(-length).alias("by"), F.lit("source").alias("role"))),
        F.when(F.col(v) < wide, F.struct(F.lit(2).alias("n"), F.lit(length).alias("by"), F.lit("sink").alias("role"))),
    ), lambda s: s.isNotNull())
    out = rods.select(*rods.columns, F.explode(copies).alias("_s"))
    return out.withColumn("origin", F.col("rod_id")).withColumn("rod_id", F.col("rod_id") * 3 + F.col("_s.n")).withColumn(v, F.col(v) + F.col("_s.by")).withColumn("role", F.col("_s.role")).drop("_s")
