"""Density meshes from text: ``Lx Ly Lz``, ``nx ny nz``, then the values."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import density
from . import ranges


def read(spark: SparkSession, path: str, order: str = "C") -> tuple[DataFrame, tuple, tuple]:
    """(mesh, ext, box). ``order`` F: the first axis runs fastest, as the mesh tool writes; C: the last."""
    tokens = ranges.words(spark, path)
    head = [float(r[0]) for r in tokens.where("pos < 6").orderBy("pos").select("v").collect()]
    box, ext = tuple(head[:3]), tuple(int(v) for v in head[3:])
    values = tokens.where("pos >= 6").select((F.col("pos") - 6).alias("pos"), F.col("v").cast("double").alias("rho"))
    return density.from_values(values, ext, order), ext, box
