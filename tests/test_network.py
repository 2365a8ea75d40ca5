"""Networks, impedance, generation, meshes, pictures and files."""

import itertools
import math
import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from rodlake import registry
from rodlake.functions import fields, vec
from rodlake.functions.grid import Grid
from rodlake.operators import density, generate, kirchhoff, network, orient, raster, rods, spatial
from rodlake.plans.tables import keep
from rodlake.sinks import ranges, text
from rodlake.sources import edges as edge_files
from rodlake.sources import meshes, params, state
from rodlake.sources import ranges as read_ranges

BOX = (1.0, 1.0, 1.0)


@pytest.fixture(scope="module")
def some(spark, tables):
    return keep(rods.derived(spark.read.parquet(f"{tables}/part.parquet"), "p_partkey", 0.2, 0.01))


def circuit(spark, rows):
    return spark.createDataFrame(rows, "kind string, ni long, nj long, g double, c double")


def test_series_and_parallel(spark):
    # source -1- 0 -1- 1 -1- sink, and a second middle branch; a loose end carries nothing
    line = [("source", None, 0, 1.0, 0.0), ("internal", 0, 1, 1.0, 0.0), ("sink", None, 1, 1.0, 0.0), ("internal", 1, 7, 5.0, 0.0), ("internal", 8, 9, 5.0, 0.0)]
    for extra, ohms in (([], 3.0), ([("segment", 0, 1, 1.0, 0.0)], 2.5)):
        df = circuit(spark, line + extra)
        got = kirchhoff.impedance_sweep(df, [1.0], 1.0).first()
        assert math.isclose(got.re / fields.R0, ohms, rel_tol=1e-9) and got.rms < 1e-9
        z, rms = kirchhoff.conjugate_gradients(df, 1.0, 1.0)
        assert math.isclose(z.real / fields.R0, ohms, rel_tol=1e-7) and rms < 1e-8


def test_complex_solvers_agree(spark):
    rng = np.random.default_rng(3)
    rows = [("internal", int(a), int(b), float(g), float(c)) for a, b, g, c in zip(rng.integers(0, 25, 70), rng.integers(0, 25, 70), rng.random(70), rng.random(70)) if a != b]
    rows += [("source", None, 0, 1.0, 0.5), ("sink", None, 24, 1.0, 0.5)]
    df = circuit(spark, rows)
    f = fields.W0 / 2 / math.pi
    one = kirchhoff.impedance_sweep(df, [f], 1.0).first()
    z, _ = kirchhoff.conjugate_gradients(df, f, 1.0)
    assert abs(complex(one.re, one.im) - z) < 1e-6 * abs(z) and one.im != 0


def test_network_counts(spark, some):
    net = network.network(some, BOX, 2, 0.03)
    table, one = net["nodes"], net["merged"]
    dropped = network.redundant(network.nodes(net["contacts"])).count()
    assert one.count() == table.count() - dropped
    assert net["segments"].where("ni >= nj").count() == 0
    assert net["node_contacts"].count() == net["contacts"].count()
    assert net["node_contacts"].where("role = 'internal' and ni is null").count() == 0


def test_pruning_is_a_fixpoint(spark, some):
    left = keep(network.pruned(some, BOX, 2, 0.02))
    pairs = spatial.contacts(left, BOX, 0.02, periodic=(True, True, False), reach=0.25)
    degree = {r.rod_id: r.n for r in pairs.select(F.explode(F.array("i", "j")).alias("rod_id")).groupBy("rod_id").agg(F.count(F.lit(1)).alias("n")).collect()}
    inner = [r.rod_id for r in left.where("role = 'internal'").collect()]
    assert all(degree.get(i, 0) >= 2 for i in inner)


def test_population_is_free_of_intersections(spark):
    df = generate.populate(spark, BOX, 0.2, 0.01, 60, seed=4)
    assert df.count() >= 59 and spatial.contacts(df, BOX, 0.0).where("d < a1 + a2").count() == 0
    seen = []
    generate.populate(spark, BOX, 0.2, 0.01, 40, seed=5, at=(0.1,), on_state=lambda f, s: seen.append((f, s.count())), cluster=(0.05, 0.3), align_every=1)
    assert seen and seen[0][0] == 0.1


def test_orientation_laws(spark):
    wide = generate.candidates(spark, 0, 4000, BOX, 0.1, 0.01)
    s = wide.agg(F.avg((3 * F.col("cz") * F.col("cz") - 1) / 2)).first()[0]
    assert abs(s) < 0.03
    tight = generate.candidates(spark, 0, 2000, BOX, 0.1, 0.01, model=generate.Model(theta=0.0, theta_sd=0.1, phi_sd=None))
    assert tight.agg(F.avg("cz")).first()[0] > 0.97
    turned = generate.candidates(spark, 0, 2000, BOX, 0.1, 0.01, model=generate.Model(theta_sd=0.05, mu=0.4, xi=0.6))
    axis = orient.principal(orient.moments(turned, Grid(BOX, (1, 1, 1)))).first()
    assert axis.l1 > 0.9 and abs(math.hypot(axis.px, axis.py, axis.pz) - 1) < 1e-9
    x = spark.range(1).select(generate.erfinv(F.lit(0.5)).alias("e"), fields.chatterjee(F.lit(0.9), 0.1, 2.0).alias("c")).first()
    assert math.isclose(math.erf(x.e), 0.5, abs_tol=1e-6) and math.isfinite(x.c)


def test_unit_frames(spark):
    v = vec.to_frame((F.lit(0.0), F.lit(0.0), F.lit(1.0)), F.lit(0.3), F.lit(0.5))
    m = ((F.lit(2.0), F.lit(0.0), F.lit(0.0)), (F.lit(0.0), F.lit(3.0), F.lit(0.0)), (F.lit(0.0), F.lit(0.0), F.lit(0.0)))
    r = spark.range(1).select(vec.norm(v).alias("n"), vec.rank3(m).alias("k"), vec.trace(m).alias("t"), vec.mat_mat(m, m)[1][1].alias("q"), vec.point_line_distance((F.lit(1.0), F.lit(2.0), F.lit(5.0)), (F.lit(0.0),) * 3, (F.lit(0.0), F.lit(0.0), F.lit(1.0))).alias("d")).first()
    assert math.isclose(r.n, 1) and r.k == 2 and r.t == 5 and r.q == 9 and math.isclose(r.d, math.sqrt(5))


def test_kd_leaves(spark, some):
    grid = Grid(BOX, (8, 8, 8))
    leaves = generate.kd_partition(some, grid, 20).collect()
    assert sum(r.n for r in leaves) == 200 and sum((r.x1 - r.x0) * (r.y1 - r.y0) * (r.z1 - r.z0) for r in leaves) == 512
    assert all(r.n <= 20 or (r.x1 - r.x0) * (r.y1 - r.y0) * (r.z1 - r.z0) == 1 for r in leaves)


def test_kd_partition_matches_brute_force(spark, tables):
    grid, most = Grid(BOX, (16, 16, 16)), 64
    df = registry.part(spark, tables).union(registry.part(spark, tables).withColumn("x", F.col("x") * F.col("x")))
    at = [tuple(int(math.floor(r[v] * 16)) % 16 for v in "xyz") for r in df.select("x", "y", "z").collect()]

    def leaves(box, rods):
        if len(rods) <= most or max(b - a for a, b in box) <= 1:
            return [(*box, len(rods))]
        cuts = []
        for axis, (a, b) in enumerate(box):
            cuts += [(abs(len(rods) - 2 * sum(r[axis] <= c for r in rods)), axis, c + 1) for c in {r[axis] for r in rods} if c + 1 < b]
            cuts += [(len(rods), axis, (a + b) // 2)] if b - a > 1 else []
        _, axis, cut = min(cuts)
        low, high = list(box), list(box)
        low[axis], high[axis] = (box[axis][0], cut), (cut, box[axis][1])
        return leaves(tuple(low), [r for r in rods if r[axis] < cut]) + leaves(tuple(high), [r for r in rods if r[axis] >= cut])

    got = [((r.x0, r.x1), (r.y0, r.y1), (r.z0, r.z1), r.n) for r in generate.kd_partition(df, grid, most).collect()]
    assert sorted(got) == sorted(leaves(((0, 16),) * 3, at))


def test_sweep_matches_dense_solver(spark, tables):
    """Every frequency of the sweep of the registered network, against a dense solve of the whole system."""
    edges = registry._admittances(spark, tables)
    rows = edges.collect()
    ids = {n: k for k, n in enumerate(sorted({n for r in rows for n in (r.ni, r.nj) if n is not None}))}
    got = registry.QUERIES["impedance_sweep"](spark, tables).collect()
    assert len(got) == 9
    for g in got:
        w = 2 * math.pi * g.frequency / fields.W0
        m, b = np.zeros((len(ids), len(ids)), complex), np.zeros(len(ids), complex)
        for r in rows:
            y, j = r.g + 1j * w * r.c, ids[r.nj]
            m[j, j] += y
            if r.ni is None:
                b[j] += y * (r.kind == "source")
            else:
                i = ids[r.ni]
                m[i, i] += y
                m[i, j] -= y
                m[j, i] -= y
        x = np.linalg.lstsq(m, b, rcond=None)[0]  # parts without an electrode leave the system singular
        current = ((1 - x) * b).sum()
        if abs(current) < 1e-9:
            assert not math.isfinite(g.re) or abs(complex(g.re, g.im)) > 1e9
        else:
            z = fields.R0 * 1e-6 / current
            assert abs(complex(g.re, g.im) - z) < 1e-6 * abs(z)


def test_solvers_raise_unsettled(spark):
    rows = [("internal", i, i + 1, 1.0 + i % 7, 0.0) for i in range(40)] + [("source", None, 0, 1.0, 0.0), ("sink", None, 40, 1.0, 0.0)]
    with pytest.raises(RuntimeError):
        kirchhoff.conjugate_gradients(circuit(spark, rows), 1.0, 1.0, rounds=3)


def test_patches_cover_the_sweep(spark):
    df = circuit(spark, [("source", None, 0, 1.0, 0.0), ("internal", 0, 1, 1.0, 0.0), ("sink", None, 1, 1.0, 0.0)])
    seen = []
    for k in range(3):
        kirchhoff.solve_patch(df, 4.0, k, 3, 1.0, lambda z: seen.extend(r.frequency for r in z.collect()))
    assert np.allclose(sorted(seen), kirchhoff.frequencies(4.0))


def test_reduction_keeps_the_current(spark):
    """Ladders, grids and random networks with parallel, zero and complex links: reduced to any degree, the current between the electrodes is the dense one's."""
    rng = np.random.default_rng(5)
    grid = [("internal", 8 * r + c, 8 * r + c + d, 1.0 + (r * c) % 3, 0.3 * c) for r in range(8) for c in range(8) for d in (1, 8) if (d == 1 and c < 7) or (d == 8 and r < 7)]
    some = [("internal", int(a), int(b), float(g), 0.0) for a, b, g in zip(rng.integers(0, 64, 90), rng.integers(0, 64, 90), rng.random(90)) if a != b]
    ends = [("source", None, k, 2.0, 0.1) for k in (0, 8)] + [("sink", None, 63, 1.5, 0.0), ("sink", None, 62, 0.0, 0.0), ("internal", 70, 71, 1.0, 0.0), ("internal", 5, 5, 9.0, 0.0)]
    sweep = [0.0, fields.W0 / 2 / math.pi]
    for rows in (grid + ends, some + ends, ends):
        y, n = np.zeros((2, 80, 80), complex), 72
        for kind, i, j, g, c in rows:
            a = {"source": 72, "sink": 73}.get(kind, i)
            if a != j:
                y[:, a, j] += [g, g + 1j * c]
                y[:, j, a] += [g, g + 1j * c]
        for star in (2, 6):
            core = kirchhoff.reduced(kirchhoff.links(circuit(spark, rows), sweep), star).toPandas()
            inner = core[core.a >= 0]
            degree = np.unique(np.concatenate([core[core.k == 0].a, core[core.k == 0].b]), return_counts=True)
            assert all(c > star for node, c in zip(*degree) if node >= 0) and (inner.a < inner.b).all()
            for k in range(2):
                m = np.diag(y[k].sum(axis=1)) - y[k]
                x = np.linalg.lstsq(m[:n, :n], y[k][:n, 72], rcond=None)[0]
                want = ((1 - x) * y[k][72, :n]).sum()
                one = core[core.k == k]
                assert abs(kirchhoff.direct_current(one.a.to_numpy(), one.b.to_numpy(), one.re.to_numpy() + 1j * one.im.to_numpy())[0] - want) < 1e-9


def test_sweep_beyond_direct(spark, monkeypatch):
    rng = np.random.default_rng(6)
    rows = [("internal", int(a), int(b), float(g), 0.2) for a, b, g in zip(rng.integers(0, 40, 400), rng.integers(0, 40, 400), rng.random(400) + 0.1) if a != b]
    df = circuit(spark, rows + [("source", None, 0, 1.0, 0.0), ("sink", None, 1, 1.0, 0.0)])
    one = kirchhoff.impedance_sweep(df, [1e9], 1.0).first()
    monkeypatch.setattr(kirchhoff, "DIRECT", 1)
    two = kirchhoff.impedance_sweep(df, [1e9], 1.0).first()
    assert abs(complex(one.re, one.im) - complex(two.re, two.im)) < 1e-6 * abs(complex(one.re, one.im))


def plain_hanging(n, fixed, edges):
    near = {k: set() for k in range(n)}
    for i, j in edges:
        near[i].add(j)
        near[j].add(i)
    gone, queue = set(), [k for k in range(n) if len(near[k]) < 2 and k not in fixed]
    while queue:
        k = queue.pop()
        if k in gone:
            continue
        gone.add(k)
        for m in near.pop(k):
            near[m].discard(k)
            if len(near[m]) < 2 and m not in fixed and m not in gone:
                queue.append(m)
    return sorted(gone)


def hang(spark, n, fixed, edges):
    nodes = spark.createDataFrame([(k, k in fixed) for k in range(n)], "rod_id long, fixed boolean")
    out, rounds = network.hanging(nodes, spark.createDataFrame(sorted({(min(e), max(e)) for e in edges}), "i long, j long"))
    return sorted(r.rod_id for r in out.collect()), rounds


def test_a_long_chain_goes_in_one_round(spark, monkeypatch):
    doublings = []
    monkeypatch.setattr(network, "_ends", lambda arcs, rounds, f=network._ends: doublings.append(1) or f(arcs, rounds))
    edges = [(k, k + 1) for k in range(5000)] + [(0, 5001), (5001, 5002), (5002, 0)]  # a chain that hangs from a ring
    got, rounds = hang(spark, 5003, set(), edges)
    assert got == list(range(1, 5001)) and rounds == 1 and len(doublings) == 1
    assert hang(spark, 300, {0, 299}, [(k, k + 1) for k in range(299)]) == ([], 0)  # held at both ends


def test_hanging_trees_rings_and_fixed_ends(spark):
    rng = np.random.default_rng(11)
    for n, m, f in ((120, 110, 6), (150, 170, 4), (60, 40, 60), (90, 88, 0)):
        edges = {tuple(sorted(rng.choice(n, 2, replace=False).tolist())) for _ in range(m)}
        fixed = set(rng.choice(n, f, replace=False).tolist())
        assert hang(spark, n, fixed, edges)[0] == plain_hanging(n, fixed, edges)
    tree = [(k, (k - 1) // 2) for k in range(1, 127)]
    assert hang(spark, 127, set(), tree)[0] == list(range(127))
    assert hang(spark, 3, set(), [])[0] == [0, 1, 2]


def test_axes_of_symmetric_matrices(spark):
    """Against LAPACK: distinct, equal and nearly equal roots, singular and zero matrices, any scale."""
    rng, some = np.random.default_rng(1), [np.zeros((3, 3)), np.diag([1.0, 2, 3]), np.diag([0, 0, 5.0])]
    kinds = [rng.normal(size=3), (1, 0, 0), (1, 1, 0.3), (1, 1 - 1e-9, 0.3), (1, 0.3, 0.3 + 1e-12), (1, 1, 1), (-2, 0.1, 0.1 + 1e-7), (1e-9, 1e-12, 0)]
    for k in range(80):
        q, _ = np.linalg.qr(rng.normal(size=(3, 3)))
        some.append((q * kinds[k % len(kinds)]) @ q.T)
    some = [(m + m.T) / 2 for m in some]
    rows = [(k, *(float(m[at]) for at in ((0, 0), (1, 1), (2, 2), (0, 1), (0, 2), (1, 2)))) for k, m in enumerate(some)]
    df = spark.createDataFrame(rows + [(-1, None, 1.0, 1.0, 0.0, 0.0, 0.0)], "id long, xx double, yy double, zz double, xy double, xz double, yz double")
    got = {r.id: r.axes for r in vec.symmetric_axes(df, ("xx", "yy", "zz", "xy", "xz", "yz")).collect()}
    assert got.pop(-1)[0].w is None
    for k, m in enumerate(some):
        w, v = np.array([a.w for a in got[k]]), np.array([[a.x, a.y, a.z] for a in got[k]]).T
        size = np.abs(m).max() or 1.0
        assert np.abs(np.sort(w) - np.linalg.eigvalsh(m)).max() < 1e-14 * size and np.all(np.diff(np.abs(w)) <= 1e-15)
        assert np.abs(m @ v - v * w).max() < 1e-14 * size and np.abs(v.T @ v - np.eye(3)).max() < 1e-14


WAYS = ["1", "2", "3", "4", "axis"]


def ends(t):
    return sorted((min(r.i, r.j), max(r.i, r.j), round(r.d, 9)) for r in t.collect())


@pytest.mark.parametrize("lengths", [(0.6, 0.02, 0.1), (0.0, 0.3, 1.3)])
def test_ways_of_the_join_agree(spark, tables, lengths):
    """Equal, unequal and no lengths; rods as long as the box; of one table, ordered, of two tables, and with an axis that ends."""
    some, every, rest = lengths
    df = keep(registry.part(spark, tables).withColumn("l", F.when(F.col("rod_id") % 50 == 0, some).when(F.col("rod_id") % 3 == 0, every).otherwise(rest)).withColumn("a", F.lit(0.01) + F.col("rod_id") % 3 * 0.005))
    one = ends(spatial.contacts(df, BOX, 0.02, reach=spatial.reach_of(df, 0.02)))
    assert one and len(set(one)) == len(one)
    old, young = df.where("rod_id % 2 = 0"), df.where("rod_id % 2 = 1")
    open_ = dict(periodic=(True, False, True))
    layered = df.withColumn("y", F.col("y") * 2.5 - 0.7)  # places before and behind the box
    apart = ends(spatial.contacts(young, BOX, 0.02, other=old, reach=spatial.reach_of(df, 0.02)))
    loose = ends(spatial.contacts(layered, BOX, 0.02, reach=spatial.reach_of(df, 0.02), **open_))
    for way in WAYS:
        assert ends(spatial.contacts(df, BOX, 0.02, way=way)) == one, way
    for way in ("2", "axis"):
        assert ends(spatial.contacts(young, BOX, 0.02, other=old, way=way)) == apart, way
        assert ends(spatial.contacts(layered, BOX, 0.02, way=way, **open_)) == loose, way
    assert ends(spatial.contacts(df, BOX, 0.02, ordered=True, way="axis")) == sorted(one * 2)


def test_ways_follow_the_loads(spark, monkeypatch):
    """Long thin rods meet along their axes, short ones in a crowd in cells below the reach; a table without rods gives none."""
    went = []
    for name in ("axis_pairs", "pairs"):
        monkeypatch.setattr(spatial, name, lambda *a, f=getattr(spatial, name), n=name, **k: went.append((n, a[7] if n == "pairs" else None)) or f(*a, **k))
    place = lambda n, wide: [(i, *(0.3 + wide * ((i * m) % 997) / 997 for m in (101, 211, 307))) for i in range(n)]
    frame = lambda rows, length, radius: spark.createDataFrame([(*r, 0.0, 0.6, 0.8, length, radius) for r in rows], "rod_id long, x double, y double, z double, cx double, cy double, cz double, l double, a double")
    spatial.contacts(frame(place(900, 0.6), 0.5, 1e-4), BOX, 1e-4)
    assert went.pop()[0] == "axis_pairs"
    spatial.contacts(frame(place(900, 0.02), 0.0, 2e-3), BOX, 0.0, way=None)
    assert went and spatial.contacts(frame([], 1.0, 1.0), BOX, 0.1).count() == 0


def test_axis_cells_hold_every_pair_once(spark):
    """A pair enters the geometry once a common cell, and leaves it once; crossed, parallel, touching end to end, at faces of cells."""
    rows = [(0, 0.5, 0.5, 0.5, 1.0, 0.0, 0.0), (1, 0.5, 0.5, 0.51, 0.0, 1.0, 0.0), (2, 0.5, 0.505, 0.5, 1.0, 0.0, 0.0), (3, 0.81, 0.5, 0.5, 1.0, 0.0, 0.0), (4, 0.0, 0.5, 0.0, 0.0, 0.0, 1.0), (5, 0.995, 0.5, 0.01, 0.0, 1.0, 0.0)]
    df = spark.createDataFrame([(*r, 0.3, 0.004) for r in rows], "rod_id long, x double, y double, z double, cx double, cy double, cz double, l double, a double")
    want = ends(spatial.contacts(df, BOX, 0.01, way="1"))
    assert ends(spatial.contacts(df, BOX, 0.01, way="axis")) == want and {(i, j) for i, j, _ in want} >= {(0, 1), (0, 2), (4, 5)}
    e = spatial.extent(df, BOX)
    grid = spatial.AxisGrid.of(BOX, 0.05, (True, True, True), 0.01, e, e)
    cells = grid.entered(df)
    assert cells.count() == cells.select("rod_id", "cell").distinct().count() < 6 * 200


def test_strides_are_trimmed():
    grid = Grid.for_reach(BOX, 0.1, order=2)
    assert grid.ext == (20, 20, 20) and len(grid.strides(2, 0.1)) == 125 and len(grid.halves(2, 0.1)) == 63
    fine = Grid.for_reach(BOX, 0.1, order=4)
    assert len(fine.strides(4, 0.1)) < 729 and (4, 4, 4) not in fine.strides(4, 0.1) and (4, 1, 1) in fine.strides(4, 0.1)
    assert Grid.for_reach(BOX, 0.4, order=2).halves(2, 0.4) == Grid(BOX, (5, 5, 5)).halves(2, 0.4)
    assert Grid.for_reach(BOX, 0.9, order=2).halves(2, 0.9) is None


def test_vectors(spark):
    v = lambda *x: tuple(F.lit(float(c)) for c in x)
    m = (v(0, 2, 1), v(4, 1, 1), v(2, 3, 5))
    row = vec.eliminated(spark.range(1), m).select("triangle", vec.angle_between(v(1, 0, 0), v(1, 1e-9, 0)).alias("tiny"), vec.angle_between(v(1, 0, 0), v(-1, 0, 0)).alias("half")).first()
    u = np.array(row.triangle)
    a = np.array([[0, 2, 1], [4, 1, 1], [2, 3, 5.0]])
    assert np.allclose(u, np.triu(u)) and math.isclose(abs(np.prod(np.diag(u))), abs(np.linalg.det(a)))
    assert math.isclose(row.tiny, 1e-9, rel_tol=1e-6) and math.isclose(row.half, math.pi)


def test_more_writers(spark, some, tmp_path):
    df = spark.createDataFrame([(0, 0, 1), (0, 1, 2), (1, 0, 3), (1, 1, 4)], "a int, b int, n int")
    text.gnuplot_matrix(df, "a", "b", "n", f"{tmp_path}/m")
    assert open(f"{tmp_path}/m").read() == "1\t2\n3\t4\n"
    mesh = density.constant(spark, (2, 2, 2)).select("i", "j", "k", F.lit(1.0).alias("vx"), F.lit(2.0).alias("vy"), F.lit(3.0).alias("vz"))
    text.vtk_field(mesh, f"{tmp_path}/f.vtk", (2, 2, 2), BOX)
    assert open(f"{tmp_path}/f.vtk").read().count("1.0 2.0 3.0") == 8
    counts = spark.createDataFrame([(1, 5)], "cell_id long, n long")
    assert text.occupancy(counts, 3, f"{tmp_path}/o") == 5 and open(f"{tmp_path}/o").read() == "0 0\n1 5\n2 0\n"
    assert params.read_input(["INC_LEN_MED 2", "REDUCE_FLAG 1"]).length == 2.0


def test_mesh_files(spark, some, tmp_path):
    mesh = density.deposit(some, (3, 4, 5), BOX)
    assert math.isclose(mesh.agg(F.sum("rho")).first()[0], 200)
    for order in "CF":
        text.mesh_text(mesh, f"{tmp_path}/mesh{order}", (3, 4, 5), BOX, order)
        back, ext, box = meshes.read(spark, f"{tmp_path}/mesh{order}", order)
        assert ext == (3, 4, 5) and box == BOX
        assert density.difference(mesh, back).agg(F.max(F.abs("rho"))).first()[0] < 1e-9
    text.vtk_mesh(mesh, f"{tmp_path}/mesh.vtk", ext, box)
    assert density.appended(mesh, ext).count() == 4 * 5 * 6
    flat = density.cell_integrals(density.constant(spark, (2, 2, 2)), (2, 2, 2), BOX, Grid(BOX, (2, 2, 2)), 3)
    assert all(math.isclose(r.rho, 0.5) for r in flat.collect()) and [r.quota for r in density.quotas(flat, 80).collect()] == [10] * 8
    balls = density.agglomerates(spark, 0.02, 0.06, 0.3)
    assert balls.count() > 3


def _trilinear(place, ext, box):
    """Nodes around a place, with their weights."""
    at = [v / b * n - 0.5 for v, b, n in zip(place, box, ext)]
    for up in itertools.product((0, 1), repeat=3):
        node = tuple((math.floor(a) + u) % n for a, u, n in zip(at, up, ext))
        yield node, math.prod((a - math.floor(a)) if u else 1 - (a - math.floor(a)) for a, u in zip(at, up))


def test_meshes_by_tiles_and_axes_against_brute_force(spark):
    """Several tiles along an axis, one that is cut off, an axis of one node, missing and null nodes, repeated points."""
    ext, box = (19, 8, 1), (1.0, 2.0, 0.5)
    draw = random.Random(5)
    places = [(n % 90, draw.random(), draw.random() * 2, draw.random() / 2) for n in range(100)] + [(100, 0.0, 0.0, 0.0), (101, 0.999, 1.999, 0.499)]
    places += places[:1]
    points = spark.createDataFrame(places, "rod_id long, x double, y double, z double")
    none = spark.createDataFrame([(102, None, 0.1, 0.1)], "rod_id long, x double, y double, z double")
    held = {(i, j, 0): draw.random() for i in range(19) for j in range(8) if (i, j) != (3, 3)}
    want = {}
    for p in places:
        for node, w in _trilinear(p[1:], ext, box):
            want[node] = want.get(node, 0.0) + w
    got = {(r.i, r.j, r.k): r.rho for r in density.deposit(points.union(none), ext, box).collect()}
    assert got.keys() == want.keys() and all(math.isclose(got[n], want[n], abs_tol=1e-12) for n in want)
    rows = [(*n, v) for n, v in held.items()] + [(3, 3, 0, None)]
    for mesh in (rows, rows[:60], []):
        known = {r[:3]: r[3] or 0.0 for r in mesh}
        table = spark.createDataFrame(mesh, "i int, j int, k int, rho double")
        got = density.sample(points.union(none).withColumn("rho", F.lit("x")), table, ext, box)
        assert got.columns == ["rod_id", "x", "y", "z", "rho"]
        found = sorted((r.rod_id, r.x or 0.0, r.rho) for r in got.collect())
        wish = sorted((p[0], p[1], sum(w * known.get(n, 0.0) for n, w in _trilinear(p[1:], ext, box))) for p in places) + [(102, 0.0, 0.0)]
        assert len(found) == len(wish) and all(a[:2] == b[:2] and math.isclose(a[2], b[2], abs_tol=1e-12) for a, b in zip(found, wish))
    grid, whole = Grid(box, (3, 5, 2)), {**held, (3, 3, 0): 0.0}
    got = {r.cell_id: r.rho for r in density.cell_integrals(spark.createDataFrame([(*n, v) for n, v in whole.items()], "i int, j int, k int, rho double"), ext, box, grid, 4).collect()}
    assert len(got) == 30
    for cell, rho in got.items():
        c = (cell % 3, cell // 3 % 5, cell // 15)
        spots = [tuple((a + (s + 0.5) / 4) * (b / e) for a, s, b, e in zip(c, at, box, grid.ext)) for at in itertools.product(range(4), repeat=3)]
        assert math.isclose(rho, sum(w * whole[n] for p in spots for n, w in _trilinear(p, ext, box)) / 64, abs_tol=1e-12)


def test_agglomerates_reach_the_volume(spark):
    """64 draws hold about 0.005 of the volume asked for here."""
    few = density.agglomerates(spark, 0.02, 0.03, 0.3, candidates=64).orderBy("id").collect()
    many = density.agglomerates(spark, 0.02, 0.03, 0.3, candidates=4096).orderBy("id").collect()
    volume = sum(4 / 3 * math.pi * b.w**3 for b in few)
    assert volume >= 0.02 * 1.05 and [b.id for b in few] == [b.id for b in many]


def test_agglomerate_mesh_takes_every_rod(spark, tables):
    balls = registry.part(spark, tables).select("rod_id", "x", "y", "z").collect()
    assert len(balls) > 100
    w = np.array([0.05 + b.rod_id % 7 / 50 for b in balls])
    at = np.array([(b.x, b.y, b.z) for b in balls])
    got = registry.QUERIES["agglomerate_mesh"](spark, tables).collect()
    assert len(got) == 512
    for g in got:
        d = np.sqrt(((at - (np.array([g.i, g.j, g.k]) + 1) / 8) ** 2).sum(1))
        want = max(0.0, (1 / (1 + np.exp(-40 * (d + w))) - 1 / (1 + np.exp(-40 * (d - w)))).max())
        assert abs(g.rho - want) < 1e-8


def test_rod_files(spark, some, tmp_path):
    grid = Grid(BOX, (3, 3, 3))
    state.write(some, grid, f"{tmp_path}/state.bin", 0.2, 0.01)
    back = state.read(spark, f"{tmp_path}/state.bin")
    assert back.count() == 200 and state.header(spark, f"{tmp_path}/state.bin")["rods"] == 200
    assert back.select("cell_id").exceptAll(rods.stamped(some, grid).select("cell_id")).count() == 0
    assert math.isclose(back.agg(F.sum("x")).first()[0], some.agg(F.sum("x")).first()[0], rel_tol=1e-6)
    text.vtk_rods(some, f"{tmp_path}/a.vtk")
    text.vtk_directions(some, f"{tmp_path}/b.vtk")
    text.lammps(some, f"{tmp_path}/c.lmp", BOX)
    assert len(open(f"{tmp_path}/c.lmp").read().splitlines()) == 15 + 400
    text.state_text(some, f"{tmp_path}/d")
    text.columns(some, f"{tmp_path}/e", "rod_id", "x", header="id x")
    assert edge_files.read(spark, f"{tmp_path}/e", ["id", "x"], header=0).count() == 200
    text.sparse(some, f"{tmp_path}/f", "rod_id", "rod_id", "x", "y")
    text.vtk_leaves(generate.kd_partition(some, grid, 20), f"{tmp_path}/g.vtk", (1 / 3,) * 3)
    assert text.total_of(some, "rod_id") == sum(range(200))


def test_histogram_texts(spark):
    df = spark.createDataFrame([(0, 0, 1), (0, 1, 2), (1, 0, 3), (1, 1, 4)], "a int, b int, n int")
    assert text.mathematica_matrix(df, "a", "b", "n") == "rho = {{1, 2},\n{3, 4}}"
    assert text.mathematica_list(df.where("a = 0"), "b", "n") == "gamma={1, 2}"


def test_network_files(spark, tmp_path):
    for name, body in (("segment.La.dat", "# i j la a\n0 1 3.0 0.004\n"), ("internal.DS.dat", "# i j d s\n1 2 0.012 1e-4\n"), ("source.DS.dat", "# f j d s\n-1 0 0.011 1e-4\n"), ("sink.DS.dat", "# f j d s\n-2 2 0.011 1e-4\n")):
        (tmp_path / name).write_text(body)
    seg, con = edge_files.read_network(spark, str(tmp_path))
    got = kirchhoff.impedance_sweep(kirchhoff.admittances(seg, con), [1e6], 1e-6)
    assert got.count() == 1
    text.impedance(got, f"{tmp_path}/z.dat")
    text.coo(con, f"{tmp_path}/coo")
    assert spark.read.text(f"{tmp_path}/coo/role=internal").count() == 1


def test_parameters():
    with pytest.warns(UserWarning):
        p = params.parse(["VOLUME_PERCENT 0.5", "DEF_THETA_DEV 0", "DEF_PHI_DEV 90", "SPAT_DISTR_FILE NONE 10 10 10 4 4 4", "VOLUME_PERCENT_LIST 2 0.1 0.2", "INC_LEN_DEV 3", "SOMETHING 1"])
    assert p.fraction == 0.005 and p.theta_sd is None and math.isclose(p.phi_sd, math.pi / 2) and p.mesh == (4, 4, 4) and p.fractions == (0.001, 0.002) and p.unknown == ("SOMETHING",)


def test_setup_file(spark, tmp_path):
    (tmp_path / "setup").write_text("box\n1.0, 1.0, 1.0\n8 8 8\n5.0\nagglomerates\n20.0 0.1 0.3 40.0 1.0\n1.0d-6 10 1.8 20\n")
    s = params.read_setup(spark, str(tmp_path / "setup"))
    assert s["grid"] == (8, 8, 8) and s["fraction"] == 0.05 and s["sigma_m"] == 1e-6 and s["threshold"] == 0.2


def test_picture(spark, some, tmp_path):
    one = some.where("rod_id = 5").withColumn("x", F.lit(0.5)).withColumn("y", F.lit(0.51)).withColumn("cx", F.lit(1.0)).withColumn("cy", F.lit(0.0)).withColumn("cz", F.lit(0.0))
    got = {(r.px, r.py) for r in raster.counts(one, BOX, (10, 10)).collect()}
    assert got == {(3, 5), (4, 5), (5, 5), (6, 5)}
    grey = raster.shaded(raster.counts(some, BOX, (16, 16)), (16, 16))
    total = grey.agg(F.sum("v")).first()[0]
    assert math.isclose(raster.blurred(grey, (16, 16), 1 / 16, 0.1).agg(F.sum("v")).first()[0], total, rel_tol=1e-9)
    text.tiff(raster.picture(some, BOX, (16, 16), 0.1), f"{tmp_path}/p.tif", (16, 16))
    data = open(f"{tmp_path}/p.tif", "rb").read()
    assert struct.unpack_from("<2sH", data) == (b"II", 42) and len(data) == 8 + 2 + 9 * 12 + 4 + 256


def test_state_in_ranges(spark, some, tmp_path, monkeypatch):
    """Written and read by several tasks: the layout byte by byte, the same rods from ranges and from the whole file; what 16 bits don't hold raises."""
    grid, path = Grid(BOX, (4, 4, 4)), f"{tmp_path}/s.bin"
    monkeypatch.setattr(state, "ROWS", 20)
    state.write(some.repartition(5), grid, path, 0.2, 0.01)
    want = sorted((r.cell_id, r.rod_id, *(np.float32(r[f]) for f in state.FIELDS)) for r in rods.stamped(some, grid).collect())
    data = open(path, "rb").read()
    occ = np.bincount([w[0] for w in want], minlength=64)
    at = struct.calcsize(state.HEAD)
    assert len(data) == at + 64 * 6 + 36 * 200
    assert (np.frombuffer(data, "<i2", 64, at) == occ).all() and (np.frombuffer(data, "<i4", 64, at + 128) == np.cumsum(occ)).all()
    body = np.frombuffer(data, "<f4", 9 * 200, at + 384).reshape(9, 200)
    assert (body == np.array([[*w[2:], w[0]] for w in want], np.float32).T).all()
    key = lambda df: sorted((r.rod_id, r.cell_id, *(r[f] for f in state.FIELDS)) for r in df.collect())
    back = state.read(spark, path)
    assert back.rdd.getNumPartitions() > 1 and key(back) == [(k, w[0], *map(float, w[2:])) for k, w in enumerate(want)]
    with monkeypatch.context() as m:
        m.setattr(state.ranges, "reachable", lambda p: False)
        assert key(state.read(spark, path)) == key(back)
        with pytest.raises(ValueError):
            state.write(some, grid, path, 0.2, 0.01)
    monkeypatch.setattr(state, "MOST", int(occ.max()) - 1)
    with pytest.raises(ValueError):
        state.write(some, grid, path, 0.2, 0.01)
    state.write(some.limit(0), grid, path, 0.2, 0.01)
    assert state.read(spark, path).count() == 0


def test_text_in_ranges(spark, some, tmp_path, monkeypatch):
    """Side by side and through one handle: the same bytes, whatever the partitions, with texts of several bytes a character; lines and words keep their numbers."""
    df = some.repartition(7)
    writers = {
        "rods.vtk": lambda p: text.vtk_rods(df, p), "ort.vtk": lambda p: text.vtk_directions(df, p), "rods.lmp": lambda p: text.lammps(df, p, BOX),
        "mesh.dat": lambda p: text.mesh_text(density.constant(spark, (3, 4, 5)), p, (3, 4, 5), BOX), "none.vtk": lambda p: text.vtk_directions(df.limit(0), p),
        "grey.tif": lambda p: text.tiff(spark.range(30).selectExpr("cast(id % 6 as int) as px", "cast(id div 6 as int) as py", "id * 11.7d as v"), p, (6, 7)),
    }
    for name, write in writers.items():
        write(f"{tmp_path}/{name}")
        with monkeypatch.context() as m:
            m.setattr(ranges, "reachable", lambda p: False)
            write(f"{tmp_path}/one-{name}")
        assert open(f"{tmp_path}/{name}", "rb").read() == open(f"{tmp_path}/one-{name}", "rb").read(), name
    odd = spark.createDataFrame([(i, "é漢 " * (i % 4) + str(i)) for i in range(500)], "k long, t string").repartition(6)
    ranges.save_sections(odd, "k", f"{tmp_path}/odd.txt", "first line", F.col("t"), "between", F.concat(F.lit("k "), F.col("k").cast("string")))
    want = ["first line", *("é漢 " * (i % 4) + str(i) for i in range(500)), "between", *(f"k {i}" for i in range(500))]
    assert open(f"{tmp_path}/odd.txt").read() == "\n".join(want) + "\n"
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        got = sorted((r.pos, r.line) for r in read_ranges.lines(spark, f"{tmp_path}/odd.txt").collect())
        assert got == list(enumerate(want))
        assert [r.v for r in read_ranges.words(spark, f"{tmp_path}/odd.txt").orderBy("pos").collect()] == " ".join(want).split()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_paths_without_a_scheme_on_a_cluster(spark, some, tmp_path, monkeypatch):
    """``spark.checkpoint.dir`` may be a plain path: where Spark takes it for ``file:``, tasks write ranges of it under any master."""
    monkeypatch.setattr(type(spark.sparkContext), "master", "spark://one:7077", raising=False)
    monkeypatch.setattr(spark.sparkContext, "master", "spark://one:7077", raising=False)
    assert ranges.reachable(f"{tmp_path}/s.bin") and ranges.reachable(f"file://{tmp_path}/s.bin") and not ranges.reachable("viewfs://store/s.bin")
    state.write(some, Grid(BOX, (4, 4, 4)), f"{tmp_path}/s.bin", 0.2, 0.01)
    assert state.read(spark, f"{tmp_path}/s.bin").count() == 200


def test_sequence_of_64_steps(spark, tables):
    """Every key starts a sequence of 64 states; that of the key 1 is the generator's own."""
    got = registry.QUERIES["lcg_sequence"](spark, tables)
    want, s = [], 1
    for n in range(64):
        want.append((n, s))
        s = (1664525 * s + 1013904223) % 2**32
    assert [(r.n, r.s) for r in got.where("seed = 1").orderBy("n").collect()] == want
    assert got.count() == 64 * spark.read.parquet(f"{tables}/part.parquet").count()


def test_blur_reaches_all_taps(spark):
    """Narrow and wide pictures, more taps than pixels, a missing pixel: against a dense wrapped sum."""
    rng = np.random.default_rng(9)
    for size, sigma in (((1280, 3), 0.03), ((5, 4), 0.9)):
        w, h = size
        grid = rng.random((h, w))
        grid[0, 1] = 0.0
        rows = [(x, y, float(grid[y, x])) for y in range(h) for x in range(w) if (x, y) != (1, 0)]
        reach = math.ceil(3 * sigma * w)
        taps = np.exp(-((np.arange(-reach, reach + 1) / w) ** 2) / 2 / sigma**2)
        taps /= taps.sum()
        want = sum(t * np.roll(grid, k, axis=1) for k, t in zip(range(-reach, reach + 1), taps))
        want = sum(t * np.roll(want, k, axis=0) for k, t in zip(range(-reach, reach + 1), taps))
        got = np.zeros((h, w))
        for r in raster.blurred(spark.createDataFrame(rows, "px int, py int, v double"), size, 1 / w, sigma).collect():
            got[r.py, r.px] = r.v
        assert np.abs(got - want).max() < 1e-12


def test_parallel_rods_apart_have_no_strip(spark):
    row = lambda x: (0.0, 0.0, 0.0, x, 0.021, 0.0)
    df = spark.createDataFrame([(x, *row(x)[3:], *(1.0, 0.0, 0.0) * 2, 1.0, 1.0, 0.01, 0.01) for x in (0.4, 1.005)], "k double, bx double, by double, bz double, c1x double, c1y double, c1z double, c2x double, c2y double, c2z double, l1 double, l2 double, a1 double, a2 double")
    from rodlake.functions import capsule

    got = {r.k: r for r in capsule.contact_area(capsule.closest_approach(df), 0.01).collect()}
    assert got[0.4].s > 0.6 * 2 * 0.001 and got[1.005].s < 0.6 * 2 * 0.001
