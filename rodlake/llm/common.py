"""Shared plumbing: broadcast checks, salted joins, exact distributed ranks, Arrow helpers."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..plans.tables import discard, scratch
from ..plans.tables import keep as save

__all__ = ["HOT", "aside", "crowded", "discard", "floored", "lookup", "matrix", "ranked", "salted", "same_length", "save", "scored", "scratch", "table", "within"]


#: Rows of one key that a task joins; more are dealt over several tasks.
HOT = 1_000
#: Parts over which rows without a key are dealt.
SPREAD = 4_096


def within(df: DataFrame, bound: int) -> bool:
    """Whether df has at most ``bound`` rows: the check that stands before every broadcast."""
    return df.limit(bound + 1).count() <= bound


def lookup(df: DataFrame, bound: int) -> DataFrame:
    """df with a broadcast hint if it has at most ``bound`` rows; else as it is, for a shuffled join."""
    return F.broadcast(df) if within(df, bound) else df


def crowded(df: DataFrame, key: str, per: int) -> DataFrame | None:
    """(key, _parts) of the keys with more than ``per`` rows, dealt over so many parts of about ``per`` rows; None if there is no such key."""
    found = save(df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > per).select(key, F.ceil(F.col("n") / per).cast("int").alias("_parts")), "crowded")
    return found if found.limit(1).count() else None


def salted(many: DataFrame, few: DataFrame, key: str, crowd: DataFrame | None, by: Column, how: str = "inner") -> DataFrame:
    """``many`` joined to ``few`` on ``key`` ("inner" or "left"): rows of crowded keys are dealt over parts by a hash of ``by``, the other side is repeated in each.

    Null keys match nothing; of a left join they are dealt over SPREAD parts.
    """
    if crowd is None and how == "inner":
        return many.join(few, key)
    if crowd is None:
        crowd = many.select(key).limit(0).withColumn("_parts", F.lit(1))
    crowd, one = lookup(crowd.where(F.col(key).isNotNull()), 200_000), F.coalesce("_parts", F.lit(1))
    parts = F.when(F.col(key).isNull(), F.lit(SPREAD)).otherwise(one)
    left = many.join(crowd, key, "left").withColumn("_part", F.pmod(F.xxhash64(by, F.lit("part")), parts).cast("int")).drop("_parts")
    right = few.join(crowd, key, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), one - 1))).drop("_parts")
    return left.join(right, [key, "_part"], how).drop("_part")


def ranked(df: DataFrame, key: str, order: list, salt, rows_hint: int, rank: str = "rank") -> DataFrame:
    """Exact gapless 0-based rank within ``key`` without gathering a key in one task.

    Rows of a key are dealt over buckets by ``salt`` (a hash), about 100 to a bucket;
    each bucket is ranked by itself and shifted by the counts of the buckets before it.
    Buckets lie in runs of about the square root of their number: counts add up
    within a run and over the runs, so no window holds more rows than that.
    """
    buckets = max(64, rows_hint // 100)
    run = max(1, int(buckets**0.5))
    df = df.withColumn("_b", F.pmod(salt, F.lit(buckets)).cast("int"))
    counts = save(df.groupBy(key, "_b").agg(F.count(F.lit(1)).alias("_n")).withColumn("_run", F.floor(F.col("_b") / run)), "rank-counts")
    within_run = Window.partitionBy(key, "_run").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    runs = counts.groupBy(key, "_run").agg(F.sum("_n").alias("_n"))
    over_runs = Window.partitionBy(key).orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    runs = lookup(save(runs.select(key, "_run", F.coalesce(F.sum("_n").over(over_runs), F.lit(0)).alias("_start")), "rank-runs"), 500_000)
    shift = counts.withColumn("_before", F.coalesce(F.sum("_n").over(within_run), F.lit(0))).join(runs, [key, "_run"])
    shift = save(shift.select(key, "_b", (F.col("_start") + F.col("_before")).alias("_shift")), "rank")
    discard(counts)
    shift = lookup(shift, 500_000)
    out = df.withColumn("_r", F.row_number().over(Window.partitionBy(key, "_b").orderBy(*order)) - 1)
    out = out.join(shift, [key, "_b"])
    return out.withColumn(rank, (F.col("_r") + F.col("_shift")).cast("long")).drop("_b", "_r", "_shift")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scored(df: DataFrame, keep: list[str], text, score: Callable[[pa.Array], pa.Array], kind: str) -> DataFrame:
    """The columns ``keep`` of ``df`` and the fields of the struct that ``score`` makes of batches of ``text``.

    Only the text goes to the Python worker and only the struct comes back; the other
    columns stay in the JVM. It is computed once, also where several of its fields are
    read or filtered.
    """

    def run(texts: pa.Array) -> pa.Array:
        return score(texts)

    given = df.select(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)], text.alias("t"))
    out = given.withColumn("s", F.arrow_udf(run, kind).asNondeterministic()(F.col("t")))
    return out.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], "s.*")


def aside(df: DataFrame) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """``df`` with columns c0, c1, ..., so that no name clashes with one of ours, and what gives them their names back."""
    names = df.columns
    return df.toDF(*[f"c{i}" for i in range(len(names))]), lambda out: out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)])


def floored(embedding: Column, scale: int, bound: int) -> Column:
    """The components times ``scale``, rounded down, as longs; null for vectors that are null or empty, or hold a component that is null, not finite or beyond ``bound`` after scaling."""
    x = embedding.cast("array<double>")
    sound = x.isNotNull() & (F.size(x) > 0) & F.forall(x, lambda v: v.isNotNull() & (F.abs(v) <= F.lit(bound / scale)))
    return F.when(F.coalesce(sound, F.lit(False)), F.transform(x, lambda v: F.floor(v * F.lit(float(scale))).cast("long")))


def same_length(df: DataFrame, column: str) -> tuple[DataFrame, int]:
    """The rows whose list has the most frequent length (of equally frequent ones the longest), and that length; 0 if there is no row."""
    top = df.groupBy(F.size(column).alias("dims")).count().orderBy(F.desc("count"), F.desc("dims")).first()
    return (df.where(F.size(column) == top.dims), top.dims) if top else (df, 0)


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    """(rows, dims) of a list column whose lists all have that length."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
