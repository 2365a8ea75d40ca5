"""Pairs met cell by cell in tasks: the same pairs as by joins, and nothing but entries and counts is shuffled."""

import math
import os

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rodlake import registry
from rodlake.functions import capsule
from rodlake.functions.grid import Grid
from rodlake.operators import cells, network, rods, spatial, stats
from rodlake.plans.tables import keep, shared_dir
from rodlake.sinks import text

BOX = (1.0, 1.0, 1.0)


@pytest.fixture(scope="module")
def mixed(spark, tables):
    """Rods of several lengths and radii, some parallel, some one behind the other, some copies of one place."""
    some = rods.derived(spark.read.parquet(f"{tables}/orders.parquet").where("o_orderkey < 900"), "o_orderkey", 0.1, 0.004)
    k = F.col("rod_id")
    some = some.withColumn("l", F.when(k % 5 == 0, 0.2).otherwise(F.col("l"))).withColumn("a", F.when(k % 3 == 0, 0.012).otherwise(F.col("a")))
    twin = some.where(k % 9 == 0).withColumn("rod_id", k + 10_000).withColumn("x", F.col("x") + 0.01 * F.col("cy")).withColumn("z", F.col("z") + 0.09 * F.col("cz"))
    same = some.where(k % 50 == 0).withColumn("rod_id", k + 20_000)
    return keep(some.union(twin).union(same))


def _close(df, columns):
    return sorted((r.i, r.j, *(r[c] for c in columns)) for r in df.select("i", "j", *columns).collect())


@pytest.mark.parametrize("periodic", [(True, True, True), (True, True, False)])
def test_the_same_pairs(spark, mixed, periodic):
    columns = ["bx", "u1", "u2", "t1", "t2", "d", "du", "cc", "a2", "unclamped"]
    for theta, where in ((("contact", 0.01, 1.0), capsule.intersects(0.01)), (("touch", 0.01), F.col("unclamped") & (F.col("du") - F.col("a1") - F.col("a2") < 0.01))):
        got = spatial.in_cells(mixed, BOX, theta, ["i", "j", *columns], periodic)
        want = spatial.spatial_join(mixed, BOX, 0.01, where=where, periodic=periodic, way="axis")
        want = _close(want, columns)
        assert len(want) > 300 and _close(got, columns) == want


def test_crowded_cells_are_dealt(spark, mixed, monkeypatch):
    monkeypatch.setattr(cells, "MOST", 50)
    want = {(min(a, b), max(a, b)) for a, b in _close(spatial.spatial_join(mixed, BOX, 0.01, where=capsule.intersects(0.01), way="1"), [])}
    got = _close(spatial.contacts(mixed, BOX, 0.01, columns=["i", "j"]), [])
    assert len(got) == len(want) and set(got) == want


def test_counts_leave_the_cells(spark, mixed):
    found = spatial.contacts(mixed, BOX, 0.01, columns=["i", "j"])
    want = {r.rod_id: r.n for r in found.select(F.explode(F.array("i", "j")).alias("rod_id")).groupBy("rod_id").agg(F.count(F.lit(1)).alias("n")).collect()}
    got = spatial.degrees(mixed, BOX, 0.01)
    assert {r.rod_id: r.n for r in got.collect()} == want
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "cell1" not in plan  # no join of pairs
    assert stats.pair_count(mixed.limit(0), BOX, 0.01).first()["pairs"] == 0


@pytest.mark.parametrize("name", ["contact_distance_surface", "contacts_by_role", "contact_degrees"])
def test_contacts_are_not_written(spark, tables, name):
    """Queries of one pass over the contacts write no table of them."""
    at = shared_dir(spark).removeprefix("file://") + "/rodlake"
    before = set(os.listdir(at)) if os.path.isdir(at) else set()
    assert registry.QUERIES[name](spark, tables).count()
    assert not [f for f in (set(os.listdir(at)) if os.path.isdir(at) else set()) - before if f.startswith("net-")]


@pytest.mark.parametrize("most", [50, 32_768])
def test_screened_in_the_cell(spark, mixed, monkeypatch, most):
    """The contacts that a join with all virtual rods finds, also where a cell is dealt; and no table of all contacts is written."""
    monkeypatch.setattr(cells, "MOST", most)
    wide = keep(network.with_electrodes(mixed.withColumn("a", F.col("a") / 2), BOX, 2, 0.03))
    found = keep(network.contacts(wide, BOX, 2, 0.03))
    want = {(r.i, r.j) for r in network.screened(found, wide, BOX, 2).collect()}
    got = network.with_hidden(wide, BOX, 2, 0.03)
    assert len(want) > 20 and {(r.i, r.j) for r in got.where("hidden").collect()} == want and got.count() == found.count()
    at = shared_dir(spark).removeprefix("file://") + "/rodlake"
    before = set(os.listdir(at))
    network.open_contacts(wide, BOX, 2, 0.03)
    assert [f.rsplit("-", 1)[0] for f in set(os.listdir(at)) - before] == ["net-open"]


def test_nothing_hangs_loose(spark, tables):
    """Rods that all have two contacts stay, and no table of contacts is written."""
    dense = keep(rods.derived(spark.read.parquet(f"{tables}/part.parquet"), "p_partkey", 0.2, 0.04))
    at = shared_dir(spark).removeprefix("file://") + "/rodlake"
    before = set(os.listdir(at))
    got = network.pruned(dense, BOX, 2, 0.03)
    assert got.where("role = 'internal'").count() == dense.count()
    assert [f.rsplit("-", 1)[0] for f in set(os.listdir(at)) - before] == ["prune-rods"]


@pytest.mark.parametrize("most", [50, 32_768])
def test_nodes_are_numbered_in_their_cells(spark, mixed, monkeypatch, most):
    """The nodes that sorting all contacts gives, also where a cell is dealt; what is written are runs of nodes, not contacts."""
    monkeypatch.setattr(cells, "MOST", most)
    wide = keep(network.with_electrodes(mixed.withColumn("a", F.col("a") / 2), BOX, 2, 0.03))
    found = network.open_contacts(wide, BOX, 2, 0.03)
    old = keep(network.renumbered(network.nodes(found)))
    at = shared_dir(spark).removeprefix("file://") + "/rodlake"
    before = set(os.listdir(at))
    here = network.places(wide, BOX, 2, 0.03)
    new = keep(here.nodes(), "mine")
    assert {f.rsplit("-", 1)[0] for f in set(os.listdir(at)) - before} == {"net-places", "mine"}
    columns = ["node_id", "rod", "t", "ci", "cj", "side", "new_id"]
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert old.count() > 500 and rows(new.select(*columns)) == rows(old.select(*columns))
    assert rows(network.segments(new)) == rows(network.segments(old)) and rows(network.redundant(new)) == rows(network.redundant(old))
    near = lambda df: sorted((r.node_id, r.rod, round(r.t, 9), r.merged) for r in df.collect())
    assert near(here.merged()) == near(network.merged(old))
    tied = lambda df: sorted((r.role, r.ni or -1, r.nj, r.d, r.s) for r in df.collect())
    assert tied(here.node_contacts()) == tied(network.node_contacts(found, old))


@pytest.mark.parametrize("most", [40, 131_072])
def test_distances_are_summed_in_the_tasks(spark, mixed, monkeypatch, most):
    """Pairs of centres by distance as the join gives them, copies and places at the edge of a bin included, also where a cell is dealt; no pair is a row."""
    monkeypatch.setattr(cells, "CENTRES", most)
    monkeypatch.setattr(cells, "TILE", (16, 32))
    ends = spark.range(30).select((F.col("id") + 50_000).alias("rod_id"), (F.col("id") / 32.0).alias("x"), F.lit(0.5).alias("y"), F.lit(0.25).alias("z"), *[F.col("id").cast("double").alias(c) for c in ("cx", "cy", "cz", "l", "a")])
    some = keep(mixed.select("rod_id", "x", "y", "z", "cx", "cy", "cz", "l", "a").union(ends))
    r, width = F.col("r"), 0.25 / 8
    want = spatial.centre_pairs(some, BOX, 0.25).groupBy(stats.bin_of(r, 0.0, width, 8).alias("bin")).agg(F.count(F.lit(1)), F.round(F.sum("r"), 8), F.round(F.sum(r * r), 8))
    got = stats.radial_distribution(some, BOX, 0.25, 8)
    assert sorted(map(tuple, got.select("bin", "n", F.round("total", 8), F.round("squares", 8)).collect())) == sorted(map(tuple, want.collect()))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "cell1" not in plan


@pytest.mark.parametrize("most", [cells.MOST, 40])
def test_elimination_in_the_cell_meets_no_pairs(spark, mixed, monkeypatch, most):
    """Rods go without a join of the pairs, also in crowded cells and by another order than that of ids."""
    grid = Grid(BOX, (2, 2, 2))
    some = keep(mixed.withColumn("turn", -F.col("rod_id") % 1000 * 100_000 - F.col("rod_id")))
    seat = {r.rod_id: (r.turn, r.cell) for r in some.select("rod_id", "turn", grid.join_id(F.col("x"), F.col("y"), F.col("z")).alias("cell")).collect()}
    hits = _close(spatial.spatial_join(some, BOX, 0.002, where=capsule.intersects(0.002), way="1"), [])
    monkeypatch.setattr(cells, "MOST", most)
    monkeypatch.setattr(capsule, "closest_approach", None)
    for seq, at in (("rod_id", lambda k: k), ("turn", lambda k: seat[k][0])):
        gone = {min(p, key=at) for p in hits if seat[p[0]][1] == seat[p[1]][1]}
        assert len(gone) > 50
        assert {r.rod_id for r in spatial.eliminate_same_cell(some, BOX, grid, seq, 0.002).collect()} == set(seat) - gone


@pytest.mark.parametrize("seq", ["rod_id", "turn"])
def test_insertion_writes_few_pairs(spark, mixed, monkeypatch, seq):
    """Rods inserted part by part: the same as one by one, and of most refused rods no pair is written."""
    some = keep(mixed.withColumn("turn", F.col("rod_id") * 7919 % 100_003))
    turn = {r.rod_id: r[1] for r in some.select("rod_id", F.col(seq).alias("at")).collect()}
    near = {}
    for p in _close(spatial.spatial_join(some, BOX, 0.03, where=capsule.intersects(0.03), way="1"), []):
        first, later = sorted(p, key=turn.get)
        near.setdefault(later, []).append(first)
    want = set()
    for k in sorted(turn, key=turn.get):
        if not want.intersection(near.get(k, ())):
            want.add(k)
    wrote = []

    def held(df):
        out = keep(df)
        if "first" in df.columns:
            wrote.append(out.count())
        return out

    monkeypatch.setattr(spatial, "PART", 100, raising=False)
    got = spatial.greedy_insert(some, BOX, held, 0.03, seq=seq).collect()
    assert {r.rod_id for r in got} == want and len(got) == len(want) and set(got[0].asDict()) == set(some.columns)
    assert sum(wrote) < sum(map(len, near.values()))


@pytest.mark.parametrize("theta", [("contact", 0.01, 1.0), ("touch", 0.01)])
def test_counted_pairs_skip_double_precision(spark, mixed, monkeypatch, theta):
    """Pairs that are only counted: the same as with their columns, and many of them without double precision."""
    most, one = spatial.cell_grid(mixed, BOX, theta, [])[1], spatial.extent(mixed, BOX)
    grid = spatial.AxisGrid.of(BOX, 0.1, (True, True, True), most / 2, one, one)
    entries = grid.entered(mixed).toPandas().assign(p=0, q=0, own=0)
    exact, found, met = cells.closest, {True: [], False: []}, {True: 0, False: 0}

    def closest(value, one, *rest):
        met[plain] += len(one)
        return exact(value, one, *rest)

    monkeypatch.setattr(cells, "closest", closest)
    monkeypatch.setattr(cells, "SURE", 20, raising=False)
    for _, some in entries.groupby("cell"):
        group = pa.Table.from_pandas(some[["cell", "p", "q", "own", "rod_id", *spatial.FIELDS]], preserve_index=False)
        ids = group.column("rod_id").to_numpy()
        for plain in (True, False):
            for out in cells._pairs(group, grid, BOX, most, theta, [] if plain else ["d"], ()):
                found[plain] += [tuple(sorted(x)) for x in zip(ids[out[""][1]].tolist(), ids[out[""][2]].tolist())]
    assert len(found[False]) > 300 and sorted(found[True]) == sorted(found[False])
    assert met[True] < 0.8 * met[False]


def test_third_rods_are_told_by_products(monkeypatch):
    """In a dense cell the third rods that brute force finds, with fewer closest approaches in double precision than pairs."""
    rng = np.random.default_rng(5)
    n, grid = 400, spatial.AxisGrid((1.0, 1.0, 1.0), (5, 5, 5), (0, 0, 0), (True, True, True), 0.04)
    c = rng.normal(size=(n, 3))
    c /= np.linalg.norm(c, axis=1)[:, None]
    c[1::20] = c[::20]  # parallel ones
    value = {v: x for v, x in zip("xyz", rng.uniform(-0.05, 0.25, (3, n)) % 1.0)} | {"c" + v: x for v, x in zip("xyz", c.T)} | {"l": rng.choice([0.1, 0.16], n), "a": rng.choice([0.004, 0.006], n)}
    group = pa.table({"cell": np.zeros(n, np.int64), **{k: np.zeros(n, np.int32) for k in ("p", "q", "own")}, "rod_id": np.arange(n), **value})
    tried, closest = [], cells.closest
    monkeypatch.setattr(cells, "closest", lambda v, one, *rest: tried.append(len(one)) or closest(v, one, *rest))
    monkeypatch.setattr(cells, "CHUNK", 10**9)  # the pairs' own approaches at once, and first
    found = list(cells._pairs(group, grid, BOX, 0.024 + 2e-6, ("contact", 0.012, 1.0), ["i", "j", "hidden"], ()))
    pairs = sum(len(f["i"]) for f in found)
    assert pairs > 300 and sum(tried[1:]) < pairs
    for f in found:
        for i, j, hidden in zip(f["i"], f["j"], f["hidden"]):
            v = {k: x[0] for k, x in closest(value, np.array([i]), np.array([j]), BOX, grid.periodic).items()}
            a = min(v["a1"], v["a2"])
            w = np.array([v["b" + x] + v["t2"] * v["c2" + x] - v["t1"] * v["c1" + x] for x in "xyz"])
            mid = np.array([v[x + "1"] + v["t1"] * v["c1" + x] for x in "xyz"]) + w / 2
            both = {k: np.append(x, y) for (k, x), y in zip(value.items(), [*mid, *(w / v["d"]), v["d"], a])}
            third = np.setdiff1d(np.arange(n), [i, j])
            u = closest(both, third, np.full(n - 2, n), BOX, grid.periodic)
            want = v["d"] / 2 > a + capsule.EPS and ((u["d"] < u["a1"] + u["a2"] + capsule.EPS) & (u["l2"] / 2 - abs(u["u2"]) > u["a2"] + capsule.EPS)).any()
            assert hidden == want


def test_areas_and_energies_are_summed_in_the_cells(spark, mixed):
    """The sums of the pairs' columns; pairs do not leave the tasks."""
    pairs = spatial.spatial_join(mixed, BOX, 0.02, where=F.col("unclamped") & (F.col("du") - F.col("a1") - F.col("a2") < 0.02), way="axis")
    sums = [F.sum(e).alias(n) for n, e in (("parallel", capsule.excluded_parallel()), ("skew", capsule.excluded_skew()), ("naive", capsule.excluded_naive(0.02)))]
    e, close = F.col("e"), F.col("du") - F.col("a1") - F.col("a2") <= stats.LEAST_GAP
    law = pairs.select(capsule.pair_energy(0.02).alias("e"), close.alias("close"))
    bad = e.isNull() | F.isnan("e")
    want = {**pairs.agg(F.count(F.lit(1)).alias("pairs"), *sums).first().asDict(), **law.agg(F.count_if("close").alias("close"), F.count_if(~F.col("close") & bad).alias("undefined"), F.sum(F.when(~F.col("close") & ~bad, e)).alias("energy")).first().asDict()}
    assert want["pairs"] > 300 and want["close"] and want["parallel"] > 0
    for found in (stats.excluded_areas(mixed, BOX, 0.02), stats.vdw_energy(mixed, BOX, 0.02)):
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert "MapInArrow" in plan and "cc#" not in plan
        row = found.first().asDict()
        assert all(abs(row[c] - want[c]) <= 1e-9 * abs(want[c]) for c in row if c in want)


def test_contacts_are_listed_from_both_rods(spark, mixed):
    """As by Spark's rounding and a join; neither follows the tasks."""
    found = spatial.listed(mixed, BOX, 0.01, both=True)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.lstrip().startswith("MapInArrow")
    want = [(r.i, r.j, r.d) for r in spatial.contacts(mixed, BOX, 0.01, columns=["i", "j", "d"]).select("i", "j", F.round("d", 9).alias("d")).collect()]
    assert sorted((r.i, r.j, r.d) for r in found.collect()) == sorted([*want, *((j, i, d) for i, j, d in want)])
    x = [0.0149999995, 0.0000000005, 0.0100000015, 0.0123456789, 0.0, 1.0000000005, 12345.6789012345, 0.01234567849999999, 3.5e9 + 0.25, -0.0000000005, -1.25]
    assert cells.rounded(np.array(x), 9).tolist() == [r[0] for r in spark.createDataFrame([(v,) for v in x], "x double").select(F.round("x", 9)).collect()]


def test_sparse_file_is_packed(spark, tables):
    at = shared_dir(spark).removeprefix("file://") + "/rodlake"
    before = set(os.listdir(at)) if os.path.isdir(at) else set()
    assert registry.QUERIES["io_sparse"](spark, tables.replace("sf0.001", "sf0.01")).count() == 1986  # the SQL's rows
    (folder,) = [f for f in set(os.listdir(at)) - before if f.startswith("sparse-")]
    assert all(f.endswith(".csv.gz") for f in os.listdir(f"{at}/{folder}") if f.startswith("part-"))


def test_third_rods_in_single_precision():
    """Which virtual rods others cross, as the closest approach of each pair tells it: parallel and perpendicular axes, ends, a pair's own rods; few pairs are left to double precision."""
    rng = np.random.default_rng(3)
    n, k = 300, 1200
    way = rng.normal(size=(n + k, 3))
    way[:40] = way[n : n + 40] + 1e-4 * rng.normal(size=(40, 3))
    way[40:60] = way[n]
    way[60:200] = way[n + 60 : n + 200] + 0.15 * rng.normal(size=(140, 3)) * np.linalg.norm(way[n + 60 : n + 200], axis=1)[:, None]
    way /= np.linalg.norm(way, axis=1)[:, None]
    at = 0.03 * rng.random((n + k, 3)) + [0.98, 0.5, 0.5]
    at[:, 0] %= 1.0
    a = np.where(np.arange(n) % 3 == 0, 0.002, 0.004)
    make = lambda s, **more: {**{x: at[s, i] for i, x in enumerate("xyz")}, **{"c" + x: way[s, i] for i, x in enumerate("xyz")}, **more}
    value = make(slice(0, n), l=np.where(np.arange(n) % 2, 0.1, 0.01), a=a)
    one, two = rng.integers(0, n, (2, k))
    radius = np.minimum(a[one], a[two])
    virtual = make(slice(n, n + k), l=2 * radius + rng.choice([2e-5, 1e-4, 1e-3, 5e-3, 1e-2], k), a=radius, one=one, two=two)
    both = {c: np.concatenate([value[c], virtual[c]]) for c in value}
    i, j = (x.ravel() for x in np.meshgrid(np.arange(n), np.arange(k), indexing="ij"))
    u = cells.closest(both, i, n + j, BOX, (True,) * 3, False)
    hit = (u["d"] < u["a1"] + u["a2"] + capsule.EPS) & (u["l2"] / 2 - np.abs(u["u2"]) > u["a2"] + capsule.EPS) & (i != one[j]) & (i != two[j])
    want = np.zeros(k, bool)
    want[j[hit]] = True
    seen, f = [], cells.closest
    cells.closest = lambda *args: seen.append(len(args[1])) or f(*args)
    try:
        got = cells._hidden(value, virtual, BOX, (True,) * 3)
    finally:
        cells.closest = f
    assert 100 < want.sum() < k - 100 and (got == want).all() and sum(seen) < 0.01 * n * k
    rods_ = np.arange(n)
    sure, open_ = cells._crossed(at[n:], way[n:], virtual["l"] / 2 - radius - capsule.EPS, radius, (radius + 0.004 + capsule.EPS) ** 2 + (virtual["l"] / 2 - radius) ** 2, at[rods_], way[rods_], value["l"] / 2 + a + capsule.EPS, a)
    assert sure.sum() > 1000 and open_.mean() < 0.2
    # beyond a rod's end, nearly in line with it, where the end of the virtual rod is the nearest
    value = {c: np.array(v) for c, v in {"x": [0.5, 0.1, 0.1], "y": [0.5] * 3, "z": [0.5] * 3, "cx": [1.0] * 3, "cy": [0.0] * 3, "cz": [0.0] * 3, "l": [0.16] * 3, "a": [0.006] * 3}.items()}
    virtual = {c: np.array([v]) for c, v in {"x": 0.6027, "y": 0.5, "z": 0.5, "cx": 0.988, "cy": math.sqrt(1 - 0.988**2), "cz": 0.0, "l": 0.0224, "a": 0.006, "one": 1, "two": 2}.items()}
    assert cells._hidden(value, virtual, BOX, (True,) * 3).tolist() == [True]


@pytest.mark.parametrize("rows", [20, 4_096])
def test_snapping_meets_the_last_rods_first(spark, mixed, monkeypatch, rows):
    """The old rod that a join of all pairs names, also where a cell is dealt; no pair is a row."""
    monkeypatch.setattr(cells, "SNAP_ROWS", rows)
    young, old = mixed.where("rod_id % 2 = 1"), mixed.where("rod_id % 2 = 0")
    r = F.sqrt(F.col("bx") * F.col("bx") + F.col("by") * F.col("by") + F.col("bz") * F.col("bz"))
    near = (r < F.greatest("l1", "l2") / 2.0) & (F.abs(F.col("cc")) >= math.cos(0.7)) & (F.col("d") <= 0.03)
    pairs = spatial.spatial_join(young, BOX, 0.03, other=old, where=near)
    columns = ["bx", "by", "bz", "c2x", "a2", "u1", "u2", "cc"]
    want = {}
    for p in pairs.select("i", "j", *columns).collect():
        want[p.i] = max(want.get(p.i, (-1,)), (p.j, *p[2:]))
    found = cells.snaps(young, old, BOX, 0.03, math.cos(0.7), 0.1)
    assert len(want) > 30 and {p.i: tuple(p)[1:] for p in found.select("i", "j", *columns).collect()} == want
    assert "Join" not in spatial.clusterise(young, old, BOX, 0.03, 0.7)._jdf.queryExecution().optimizedPlan().toString().replace("Join LeftOuter", "", 1)


@pytest.mark.parametrize("most", [60, 32_768])
def test_two_contacts_are_enough(spark, mixed, tables, monkeypatch, most):
    """Of rods with two contacts those are told that have them in sight, and no other; pruning then counts no degrees, and is the same where rods hang loose."""
    monkeypatch.setattr(cells, "MOST", most)
    monkeypatch.setattr(cells, "FIRST", 16)
    wraps = (True, True, False)
    want = {r.rod_id for r in spatial.degrees(mixed, BOX, 0.01, wraps).where("n >= 2").collect()}
    got = {r.rod_id for r in spatial.with_two(mixed, BOX, 0.01, wraps, F.lit(True)).collect()}
    assert 10 < len(got) <= len(want) < mixed.count() and got <= want and (got == want or most < 100)
    some = spatial.with_two(mixed, BOX, 0.01, wraps, F.col("rod_id") % 2 == 0)
    assert {r.rod_id for r in some.collect()} <= {i for i in want if i % 2 == 0}
    if most > 100:
        loose = sorted(map(tuple, network.pruned(mixed, BOX, 2, 0.01).select("rod_id", "role").collect()))
        monkeypatch.setattr(network, "MANY", 0)
        assert sorted(map(tuple, network.pruned(mixed, BOX, 2, 0.01).select("rod_id", "role").collect())) == loose
        monkeypatch.setattr(spatial, "degrees", None)
        dense = keep(rods.derived(spark.read.parquet(f"{tables}/part.parquet"), "p_partkey", 0.2, 0.04))
        assert network.pruned(dense, BOX, 2, 0.03).where("role = 'internal'").count() == dense.count()


def test_contacts_are_written_packed(spark, tables, tmp_path):
    """The lines of each role, packed, in little over half the bytes of random digits; the session's setting is as it was."""
    df = spark.range(2000).select(F.col("id").alias("i"), (F.col("id") * 7).alias("j"), F.when(F.col("id") % 3 == 0, "sink").otherwise("internal").alias("role"), F.sqrt("id").alias("d"), F.log1p("id").alias("s")).repartition(2)
    for kind in ("none", "gzip"):
        text.coo(df, f"{tmp_path}/{kind}", compression=kind)
    size = lambda kind: sum(f.stat().st_size for f in (tmp_path / kind).rglob("part-*"))
    assert 1.8 * size("gzip") < size("none") and len(list((tmp_path / "gzip").rglob("part-*.txt.gz"))) == 4
    rows = lambda kind: sorted(map(tuple, spark.read.text(f"{tmp_path}/{kind}").select("role", "value").collect()))
    assert rows("gzip") == rows("none") and len(rows("gzip")) == 2000 and spark.conf.get(text.WRITERS, "0") == "0"
    at = shared_dir(spark).removeprefix("file://") + "/rodlake"
    before = set(os.listdir(at))
    assert registry.QUERIES["io_contacts"](spark, tables).count()
    made = [f for f in set(os.listdir(at)) - before if f.startswith("coo-")]
    assert len(made) == 1 and not [f for _, _, names in os.walk(f"{at}/{made[0]}") for f in names if f.endswith(".txt")]
