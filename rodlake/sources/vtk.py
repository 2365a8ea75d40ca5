"""Text files of rods and meshes, back as tables: the layouts that ``sinks.text`` writes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.tables import keep
from . import ranges


def _count(lines: DataFrame, pattern: str) -> int:
    """The number in the one line that fits."""
    return int(lines.select(F.regexp_extract("line", pattern, 1).alias("n")).where("n <> ''").first()[0])


def _section(lines: DataFrame, first: int, n: int, names: list[str]) -> DataFrame:
    """(pos, names ...): ``n`` lines from ``first`` on, as doubles."""
    parts = F.split(F.trim("line"), r"\s+")
    return lines.where((F.col("pos") >= first) & (F.col("pos") < first + n)).select((F.col("pos") - first).alias("pos"), *[F.element_at(parts, i + 1).cast("double").alias(c) for i, c in enumerate(names)])


def read_rods(spark: SparkSession, path: str) -> DataFrame:
    """(pos, x, y, z, cx, cy, cz, l, a, cell_id) of ``sinks.text.vtk_rods``."""
    lines = keep(ranges.lines(spark, path), "lines")
    n = _count(lines, r"^POINTS (\d+)")
    out = _section(lines, 5, n, ["x", "y", "z"]).join(_section(lines, 7 + n, n, ["cx", "cy", "cz"]), "pos")
    for k, c in enumerate(("l", "a", "cell_id")):
        out = out.join(_section(lines, 9 + 2 * n + k * (n + 2), n, [c]), "pos")
    return out.withColumn("cell_id", F.col("cell_id").cast("long"))


def read_directions(spark: SparkSession, path: str) -> DataFrame:
    """(pos, cx, cy, cz) of ``sinks.text.vtk_directions``."""
    lines = keep(ranges.lines(spark, path), "lines")
    return _section(lines, 5, _count(lines, r"^POINTS (\d+)"), ["cx", "cy", "cz"])


def read_lammps(spark: SparkSession, path: str) -> DataFrame:
    """(id, x, y, z, length, width, qw, qx, qy, qz) of ``sinks.text.lammps``."""
    lines = keep(ranges.lines(spark, path), "lines")
    n = _count(lines, r"^(\d+) atoms")
    atoms = _section(lines, 12, n, ["id", "kind", "flag", "density", "x", "y", "z"])
    shapes = _section(lines, 15 + n, n, ["id", "length", "width", "height", "qw", "qx", "qy", "qz"])
    return atoms.select(F.col("id").cast("long").alias("id"), "x", "y", "z").join(shapes.select(F.col("id").cast("long").alias("id"), "length", "width", "qw", "qx", "qy", "qz"), "id")


def read_mesh(spark: SparkSession, path: str) -> DataFrame:
    """(i, j, k, rho) of ``sinks.text.vtk_mesh``; the first axis runs fastest."""
    lines = keep(ranges.lines(spark, path), "lines")
    nx, ny, nz = (int(v) for v in lines.where("line like 'DIMENSIONS %'").first()["line"].split()[1:])
    p = F.col("pos")
    return _section(lines, 10, nx * ny * nz, ["rho"]).select((p % nx).cast("int").alias("i"), (F.floor(p / nx) % ny).cast("int").alias("j"), F.floor(p / (nx * ny)).cast("int").alias("k"), "rho")


def read_tiff(spark: SparkSession, path: str) -> DataFrame:
    """(px, py, v) of a grey picture of one strip, as ``sinks.text.tiff`` writes it."""
    import pandas as pd

    def load(batches):
        import struct

        import numpy as np

        for pdf in batches:
            for data in pdf.content:
                first = struct.unpack_from("<I", data, 4)[0]
                tags = {t: (a if k == 4 else a & 0xFFFF) for t, k, _, a in (struct.unpack_from("<HHII", data, first + 2 + 12 * i) for i in range(struct.unpack_from("<H", data, first)[0]))}
                grid = np.frombuffer(data, np.uint8, tags[279], tags[273]).reshape(tags[257], tags[256])
                y, x = np.indices(grid.shape)
                yield pd.DataFrame({"px": x.ravel(), "py": y.ravel(), "v": grid.ravel()}).astype("int32")

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(load, "px int, py int, v int")
