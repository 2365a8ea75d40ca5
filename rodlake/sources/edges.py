"""Tables of numbers in text: one header line, columns between blanks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, path: str, names: list[str], columns: list[int] | None = None, header: int = 1) -> DataFrame:
    """Columns ``columns`` (default: the first) as doubles named ``names``. Lines that start with # and the first ``header`` lines go."""
    columns = columns or list(range(len(names)))
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", r"\r?\n")).alias("pos", "line")).where((F.col("pos") >= header) & (F.trim("line") != "") & ~F.trim("line").startswith("#"))
    parts = F.split(F.trim("line"), r"\s+")
    return lines.select(*[F.element_at(parts, c + 1).cast("double").alias(n) for n, c in zip(names, columns)])


def read_network(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(segments, contacts) of segment.La.dat, internal.DS.dat, source.DS.dat and sink.DS.dat."""
    segments = read(spark, f"{folder}/segment.La.dat", ["ni", "nj", "len_over_a", "a"]).withColumn("ni", F.col("ni").cast("long")).withColumn("nj", F.col("nj").cast("long"))
    inner = read(spark, f"{folder}/internal.DS.dat", ["ni", "nj", "d", "s"]).select(F.lit("internal").alias("role"), F.col("ni").cast("long").alias("ni"), F.col("nj").cast("long").alias("nj"), "d", "s")
    for role in ("source", "sink"):
        one = read(spark, f"{folder}/{role}.DS.dat", ["nj", "d", "s"], [1, 2, 3])
        inner = inner.unionByName(one.select(F.lit(role).alias("role"), F.lit(None).cast("long").alias("ni"), F.col("nj").cast("long").alias("nj"), "d", "s"))
    return segments, inner
