"""Text files read by tasks side by side, with the numbers of their lines and words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..plans.tables import keep


def _counted(spark: SparkSession, path: str, size: Column) -> DataFrame:
    """(value, before): lines of one file, with the sum of ``size`` over all lines before each.

    Spark reads the file in blocks; sizes are summed per block, added up over the blocks (a row
    each on the driver) and along each block.
    """
    lines = keep(spark.read.text(path).select("value", F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at")).withColumn("n", size.cast("long")), "lines")
    now, firsts = 0, []
    for r in lines.groupBy("block").agg(F.sum("n").alias("n")).orderBy("block").collect():
        firsts.append((r.block, now))
        now += r.n
    starts = spark.createDataFrame(firsts, "block long, first long")
    w = Window.partitionBy("block").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    return lines.join(F.broadcast(starts), "block").select("value", (F.col("first") + F.coalesce(F.sum("n").over(w), F.lit(0))).alias("before"))


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(pos, line), pos from 0."""
    return _counted(spark, path, F.lit(1)).select(F.col("before").alias("pos"), F.col("value").alias("line"))


def words(spark: SparkSession, path: str) -> DataFrame:
    """(pos, v): the words of the file, pos from 0, whatever lines they are on."""
    parts = F.filter(F.split("value", r"\s+"), lambda x: x != "")
    each = _counted(spark, path, F.size(parts)).select("before", F.posexplode(parts).alias("k", "v"))
    return each.select((F.col("before") + F.col("k")).alias("pos"), "v")
