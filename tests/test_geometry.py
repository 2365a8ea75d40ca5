"""Contacts of hand-made rods, grids, and what must hold for any."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from rodlake.functions import capsule
from rodlake.functions.grid import Grid
from rodlake.operators import rods, spatial, stats

X, Y, Z = (1.0, 0.0, 0.0), (0.0, 1.0, 0.0), (0.0, 0.0, 1.0)
CASES = [
    ("crossed", (0, 0, 0), X, (0, 0, 0.3), Y, 0.3, (0, 0)),
    ("tee", (0, 0, 0), X, (0.2, 0.8, 0), Y, 0.3, (0.2, -0.5)),
    ("past the end", (0, 0, 0), X, (0.9, 0, 0.3), Y, 0.5, (0.5, 0)),
    ("cap slack", (0, 0, 0), X, (0.55, 0, 0.3), Y, 0.3, (0.55, 0)),
    ("collinear", (0, 0, 0), X, (1.5, 0, 0), X, 0.5, (0.5, -0.5)),
]


def frame(spark, rows):
    return spark.createDataFrame([(i, *map(float, r), *map(float, c), float(l), float(a)) for i, r, c, l, a in rows], "rod_id long, x double, y double, z double, cx double, cy double, cz double, l double, a double")


@pytest.mark.parametrize("name,r1,c1,r2,c2,d,t", CASES, ids=[c[0] for c in CASES])
def test_closest_approach(spark, name, r1, c1, r2, c2, d, t):
    b = [q - p for p, q in zip(r1, r2)]
    row = dict(zip("bx by bz c1x c1y c1z c2x c2y c2z".split(), [*map(float, b), *c1, *c2])) | {"l1": 1.0, "l2": 1.0, "a1": 0.1, "a2": 0.1}
    got = capsule.closest_approach(spark.createDataFrame([row])).first()
    assert math.isclose(got.d, d, abs_tol=1e-9)
    assert np.allclose((got.t1, got.t2), t, atol=1e-9)


def test_wrap(spark):
    df = frame(spark, [(1, (0.1, 5, 5), Y, 1, 0.1), (2, (9.9, 5, 5), Z, 1, 0.1)])
    got = spatial.contacts(df, (10.0, 10.0, 10.0), 0.1).first()
    assert math.isclose(got.d, 0.2, abs_tol=1e-9)


def test_grid_does_not_matter(spark, tables):
    df = rods.derived(spark.read.parquet(f"{tables}/part.parquet"), "p_partkey", 0.2, 0.01)
    found = {tuple(sorted((r.i, r.j))) for r in spatial.contacts(df, (1.0, 1.0, 1.0), 0.05).collect()}
    for n in (1, 2, 3):
        again = spatial.contacts(df, (1.0, 1.0, 1.0), 0.05, grid=Grid((1.0, 1.0, 1.0), (n, n, n))).collect()
        assert len(again) == len(found) and {tuple(sorted((r.i, r.j))) for r in again} == found
    both = spatial.contacts(df, (1.0, 1.0, 1.0), 0.05, ordered=True)
    assert both.count() == 2 * len(found)
    moved = df.withColumn("x", (F.col("x") + 1.3) % 1)
    assert {tuple(sorted((r.i, r.j))) for r in spatial.contacts(moved, (1.0, 1.0, 1.0), 0.05).collect()} == found


def test_greedy_insert_is_sequential(spark, tables):
    from rodlake.plans.tables import keep

    df = rods.derived(spark.read.parquet(f"{tables}/part.parquet"), "p_partkey", 0.2, 0.02)
    hit = {(min(r.i, r.j), max(r.i, r.j)) for r in spatial.contacts(df, (1.0, 1.0, 1.0), 0.0).collect()}
    stay = []
    for i in sorted(r.rod_id for r in df.collect()):
        if not any((j, i) in hit for j in stay):
            stay.append(i)
    got = sorted(r.rod_id for r in spatial.greedy_insert(df, (1.0, 1.0, 1.0), keep).collect())
    assert got == stay and len(stay) < df.count()


def test_empty_and_single(spark):
    none = frame(spark, [(1, (0, 0, 0), X, 1, 0.1)]).where("rod_id < 0")
    assert spatial.contacts(none, (1.0, 1.0, 1.0), 0.1).count() == 0
    one = frame(spark, [(1, (0.5, 0.5, 0.5), X, 0.1, 0.01)])
    assert stats.contacts_per_rod(one, (1.0, 1.0, 1.0), 0.1).collect() == [(1, 0)]
    assert rods.live(one.withColumn("l", F.lit(0.0))).count() == 0


def test_merge_join_and_pushdown(spark, tables):
    df = rods.derived(spark.read.parquet(f"{tables}/orders.parquet"), "o_orderkey", 0.05, 0.002)
    plan = spatial.contacts(df, (1.0, 1.0, 1.0), 0.003)._jdf.queryExecution().toString()
    assert "SortMergeJoin" in plan and "BroadcastNestedLoopJoin" not in plan and "CartesianProduct" not in plan
    assert "ReadSchema: struct<o_orderkey:bigint>" in plan


def test_van_der_waals_segment_tends_to_half_a_line(spark):
    row = spark.range(1).select(capsule.line_segment(F.lit(2.0), F.lit(math.pi / 2), F.lit(1e4)).alias("s"), capsule.line_line(F.lit(2.0), F.lit(math.pi / 2)).alias("l"), capsule.line_tube(F.lit(500.0), F.lit(math.pi / 2), 1e-3).alias("t")).first()
    assert math.isclose(row.s, row.l / 2, rel_tol=1e-5)
    assert math.isfinite(row.t)


def test_ellipse_kit(spark):
    a, b = 2.0, 1.0
    long, short = capsule.ellipse_axes(F.lit(1 / a**2), F.lit(0.0), F.lit(1 / b**2))
    p = [(F.lit(a * math.cos(t)), F.lit(b * math.sin(t))) for t in (0.1, 0.9, 2.0)]
    fit = capsule.ellipse_through(p)
    r = spark.range(1).select(long.alias("u"), short.alias("v"), *[c.alias(n) for c, n in zip(fit, "abc")], capsule.ellipse_sector(F.lit(a), F.lit(b), F.lit(math.pi)).alias("half"), capsule.ellipse_half_cut(F.lit(a), F.lit(b), F.lit(a)).alias("all"), capsule.conic_area(F.lit(0.25), F.lit(0.0), F.lit(1.0)).alias("area")).first()
    assert np.allclose((r.u, r.v), (2, 1)) and np.allclose((r.a, r.b, r.c), (0.25, 0, 1), atol=1e-9)
    assert np.allclose((r.half, r.all, r.area), (math.pi, 2 * math.pi, 2 * math.pi))
