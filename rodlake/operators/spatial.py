"""Spatial joins of rods over the cell grid.

Candidates come from an equi-join on one LONG cell key. Either rods are entered by their
centres, and the cells within reach meet by strides, each pair of cells once; or rods are
entered in every cell along their axes and meet in the cell of their closest approach.
The distances of centres and of the axes as lines are tested in the join condition, so
that few pairs reach the geometry. Rows are narrow; sort-merge is asked for, since a
broadcast would grow with the rods.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import capsule
from ..functions.grid import Grid
from ..functions.vec import cross, dot, let, min_image
from ..plans.tables import discard
from ..plans.tables import keep as table
from . import cells as by_cell

FIELDS = ["x", "y", "z", "cx", "cy", "cz", "l", "a"]


def reach_of(rods: DataFrame, limit: float, other: DataFrame | None = None) -> float:
    """How far centres of rods within ``limit`` of each other can be apart.

    Half of both lengths, both radii and the limit; or, as a place may lie a radius
    behind an end, the diagonal over the drawn-out halves and the distance of the axes.
    """
    one, two = (tuple(v or 0.0 for v in d.agg(F.max("l"), F.max("a")).first()) for d in (rods, rods if other is None else other))
    return _reach(one, two, limit)


def _reach(one: tuple[float, float], two: tuple[float, float], limit: float) -> float:
    half, radii = (one[0] + two[0]) / 2, one[1] + two[1]
    return max(half + radii + limit, math.hypot(half + radii, radii + limit)) + 2 * capsule.EPS


@dataclass(frozen=True)
class Extent:
    """Of a table of rods: rods, longest, mean length, thickest, rods per volume where the rods are, lowest and highest centre of each axis."""

    rods: int
    length: float
    mean: float
    radius: float
    density: float
    low: tuple[float, ...]
    high: tuple[float, ...]


#: Cells a side in which loads are counted.
LOADS = 16


def extent(rods: DataFrame, box: tuple[float, float, float], periodic: tuple[bool, bool, bool] = (True, True, True)) -> Extent:
    """One aggregate over the loads of coarse cells: a rod sees n - 1 others in its cell, on the mean over rods, which tells crowded tables from even ones."""
    cell = Grid(box, (LOADS,) * 3, periodic).join_id(F.col("x"), F.col("y"), F.col("z"))
    ends = [f(v).alias(f"{n}{v}") for v in "xyz" for n, f in (("low", F.min), ("high", F.max))]
    each = rods.groupBy(cell).agg(F.count(F.lit(1)).alias("n"), F.sum("l").alias("s"), F.max("l").alias("l"), F.max("a").alias("a"), *ends)
    top = [f(f"{n}{v}") for v in "xyz" for n, f in (("low", F.min), ("high", F.max))]
    n, met, s, length, radius, *ends = (v or 0 for v in each.agg(F.sum("n"), F.sum(F.col("n") * (F.col("n") - 1.0)), F.sum("s"), F.max("l"), F.max("a"), *top).first())
    return Extent(n, float(length), s / max(1, n), float(radius), met / max(1, n) / math.prod(box) * LOADS**3, tuple(ends[::2]), tuple(ends[1::2]))


#: What an entry of a rod in a cell costs, in tests of a pair (measured): one of a centre, and one along an axis, which is computed cell by cell and may repeat a pair's geometry.
ENTRY, AXIS_ENTRY = 10.0, 30.0
#: Largest order of a grid: cells of a quarter of the reach.
ORDERS = 4


def centre_cost(one: Extent, two: Extent, reach: float, order: int, halved: bool) -> float:
    """Work of a join of centres on cells of ``reach / order``: entries of all strides, and pairs that meet."""
    met = len(Grid((1e9, 1e9, 1e9), (10**9,) * 3).strides(order)) / (2 if halved else 1)
    return ENTRY * (one.rods * met + two.rods) + one.rods * met * two.density * (reach / order) ** 3


def axis_cost(one: Extent, two: Extent, most: float, width: float, halved: bool) -> float:
    """Work of a join of axes on cells of ``width``; a rod's entries are its widened axis, swept by a cell, over the cell."""
    wide = width + most
    first, second = ((wide**3 + 1.5 * (e.mean + 2 * e.radius) * wide**2) / width**3 for e in (one, two))
    return AXIS_ENTRY * (one.rods * first + two.rods * second) + one.rods * first * second * two.density * width**3 / (2 if halved else 1)


@dataclass(frozen=True)
class AxisGrid:
    """Cells in which rods are entered along their axes. An axis that wraps has n cells of width box / n; else cells are numbered from ``first`` on, beyond the box too."""

    box: tuple[float, float, float]
    ext: tuple[int, int, int]
    first: tuple[int, int, int]
    periodic: tuple[bool, bool, bool]
    half: float

    @staticmethod
    def of(box: tuple[float, float, float], width: float, periodic: tuple[bool, bool, bool], half: float, one: Extent, two: Extent) -> "AxisGrid":
        """Cells of about ``width``. An axis that wraps has a single cell if a rod and its margins might reach around it."""
        ext, first = [], []
        span = max(e.length + 2 * e.radius for e in (one, two)) + 2 * half + 4 * capsule.EPS
        for i, (n, wraps) in enumerate(zip(box, periodic)):
            low, high = min(one.low[i], two.low[i]) - span, max(one.high[i], two.high[i]) + span
            count = max(1, min(1_000_000, math.floor(n / width)))
            if wraps and span + n / count >= n:
                count = 1
            ext.append(count if wraps else math.ceil((high - low) / (n / count)) + 2)
            first.append(0 if wraps else math.floor(low / (n / count)) - 1)
            if not wraps:
                # the width stays that of the box
                box = (*box[:i], n / count * ext[i], *box[i + 1 :])
        return AxisGrid(tuple(box), tuple(ext), tuple(first), periodic, half)

    def width(self, i: int) -> float:
        return self.box[i] / self.ext[i]

    def number(self, x: Column, i: int) -> Column:
        g = F.floor(x / self.width(i))
        return F.pmod(g, F.lit(self.ext[i])) if self.periodic[i] else g - self.first[i]

    def cell(self, x: Column, y: Column, z: Column) -> Column:
        return self._id([self.number(v, i) for i, v in enumerate((x, y, z))])

    def _id(self, g: list[Column]) -> Column:
        return (g[0] + g[1] * self.ext[0] + g[2] * (self.ext[0] * self.ext[1])).cast("long")

    def entered(self, rods: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
        """rod_id, FIELDS, ``keep`` and cell: a row for each cell within ``half`` of the axis, drawn out by the radius.

        Slab by slab: the cells along x, of each the piece of the axis that may touch it, that
        piece's cells along y, and so on.
        """
        df = let(rods.select("rod_id", *FIELDS, *keep), _o=F.col("l") / 2.0 + F.col("a") + 2 * capsule.EPS, _s=F.lit(0.0), _e=F.lit(1.0))
        for i, v in enumerate("xyz"):
            start, along, h, w = F.col(v) - F.col("c" + v) * F.col("_o"), 2.0 * F.col("c" + v) * F.col("_o"), self.half + 2 * capsule.EPS, self.width(i)
            if self.periodic[i] and self.ext[i] == 1:
                df = df.withColumn(f"_g{v}", F.lit(0).cast("long"))
                continue
            df = let(df, _p=start, _v=along)
            p, q = F.col("_p") + F.col("_v") * F.col("_s"), F.col("_p") + F.col("_v") * F.col("_e")
            df = df.withColumn(f"_g{v}", F.explode(F.sequence(F.floor((F.least(p, q) - h) / w), F.floor((F.greatest(p, q) + h) / w))))
            s, e = ((F.col(f"_g{v}") * w - h - F.col("_p")) / F.col("_v"), ((F.col(f"_g{v}") + 1) * w + h - F.col("_p")) / F.col("_v"))
            flat = F.abs(F.col("_v")) < 1e-12
            if i < 2:
                df = let(df, _s=F.when(flat, F.col("_s")).otherwise(F.greatest(F.col("_s"), F.least(s, e))), _e=F.when(flat, F.col("_e")).otherwise(F.least(F.col("_e"), F.greatest(s, e))))
        g = [F.pmod(F.col(f"_g{v}"), F.lit(n)) if wraps else F.col(f"_g{v}") - at for v, n, wraps, at in zip("xyz", self.ext, self.periodic, self.first)]
        return df.select("rod_id", *FIELDS, *keep, self._id(g).alias("cell"))


def _named(df: DataFrame, end: int, keep: tuple[str, ...], *more: Column) -> DataFrame:
    return df.select(F.col("rod_id").alias("ij"[end - 1]), *[F.col(f).alias(f"{f}{end}") for f in FIELDS], *[F.col(k).alias(f"{k}{end}") for k in keep], *more)


def _met(a: DataFrame, b: DataFrame, on: Column, box: tuple[float, float, float], periodic: tuple[bool, bool, bool], reach: float, most: float | None, tail: list[str]) -> DataFrame:
    """a and b joined; centres within ``reach``, and with ``most`` the lines of the axes within that, which a few products tell."""
    gap = {v: F.col(v + "2") - F.col(v + "1") for v in "xyz"}
    gap = {v: min_image(g, F.lit(float(n))) if p else g for (v, g), n, p in zip(gap.items(), box, periodic)}
    on = on & (gap["x"] * gap["x"] + gap["y"] * gap["y"] + gap["z"] * gap["z"] <= reach * reach)
    if most is not None:
        n = cross(tuple(F.col(f"c{v}1") for v in "xyz"), tuple(F.col(f"c{v}2") for v in "xyz"))
        apart = dot(tuple(gap.values()), n)
        on = on & (apart * apart <= dot(n, n) * (most * most) + 1e-12)
    joined = a.hint("merge").join(b, on)
    return joined.select("i", "j", "x1", "y1", "z1", *[gap[v].alias("b" + v) for v in "xyz"], *[F.col(f"c{v}1").alias(f"c1{v}") for v in "xyz"], "l1", "a1", *[F.col(f"c{v}2").alias(f"c2{v}") for v in "xyz"], "l2", "a2", *tail)


def axis_pairs(rods: DataFrame, grid: AxisGrid, box: tuple[float, float, float], reach: float, most: float, other: DataFrame | None = None, ordered: bool = False, keep: tuple[str, ...] = (), keep_other: tuple[str, ...] = ()) -> DataFrame:
    """Columns of ``pairs`` and cell: pairs of rods that are entered in one cell, once for each such cell.

    The middle of a pair's closest approach lies within half the distance of both axes, so in a
    cell of both: ``reference`` keeps the row of that cell.
    """
    a = _named(grid.entered(rods, keep), 1, keep, F.col("cell").alias("cell1"))
    theirs = keep if other is None else keep_other
    b = _named(grid.entered(rods if other is None else other, theirs), 2, theirs, F.col("cell").alias("cell2"))
    on = F.col("cell1") == F.col("cell2")
    if other is None:
        on = on & (F.col("i") != F.col("j") if ordered else F.col("i") < F.col("j"))
    return _met(a, b, on, box, grid.periodic, reach, most, [*(k + "1" for k in keep), *(k + "2" for k in theirs), "cell1"])


def reference(found: DataFrame, grid: AxisGrid) -> DataFrame:
    """Of the rows of a pair with its closest approach, the one in the cell of the middle."""
    middle = [F.col(v + "1") + (F.col("t1") * F.col("c1" + v) + F.col("b" + v) + F.col("t2") * F.col("c2" + v)) / 2.0 for v in "xyz"]
    return found.where(grid.cell(*middle) == F.col("cell1")).drop("cell1")


def pairs(rods: DataFrame, grid: Grid, reach: float, other: DataFrame | None = None, ordered: bool = False, keep: tuple[str, ...] = (), keep_other: tuple[str, ...] = (), order: int = 1, most: float | None = None) -> DataFrame:
    """Pairs of rods whose centres are within ``reach`` under the nearest image.

    Columns: i, j, x1.., b (bx..), c1x.., l1, a1, c2x.., l2, a2, and ``keep`` with endings 1
    and 2. Of one table: each pair once (i and j in the order of their cells), or twice
    if ``ordered``. With ``other``: rods as i, other as j, all pairs. Cells must be at least
    ``reach / order`` wide. ``most``: pairs whose axes, as lines, are farther apart may be left out.
    """
    halves = grid.halves(order, reach) if other is None and not ordered else None
    strides = halves or grid.strides(order, reach)
    left = F.array(*[F.struct(*[F.lit(v).cast("int").alias(n) for v, n in zip(s, ("sx", "sy", "sz"))]) for s in strides])
    a = rods.select("rod_id", *FIELDS, *keep, *[grid.axis(F.col(v), i).alias(f"g{v}") for i, v in enumerate("xyz")])
    a = a.select("rod_id", *FIELDS, *keep, "gx", "gy", "gz", F.explode(left).alias("s"))
    at, ok = [], F.lit(True)
    for v, n, p in zip("xyz", grid.ext, grid.periodic):
        c = F.col(f"g{v}") + F.col(f"s.s{v}")
        at.append(F.pmod(c, F.lit(n)) if p else c)
        if not p:
            ok = ok & (c >= 0) & (c < n)
    own = (F.col("s.sx") == 0) & (F.col("s.sy") == 0) & (F.col("s.sz") == 0)
    a = _named(a.where(ok), 1, keep, own.alias("own"), grid.compose(*at).alias("cell1"))
    theirs = keep if other is None else keep_other
    b = _named(rods if other is None else other, 2, theirs, grid.join_id(F.col("x"), F.col("y"), F.col("z")).alias("cell2"))
    on = F.col("cell1") == F.col("cell2")
    if other is None:
        on = on & (F.col("i") != F.col("j") if ordered else ~F.col("own") | (F.col("i") < F.col("j")) if halves else F.col("i") < F.col("j"))
    return _met(a, b, on, grid.box, grid.periodic, reach, most, [*(k + "1" for k in keep), *(k + "2" for k in theirs)])


def spatial_join(rods: DataFrame, box: tuple[float, float, float], limit: float, other: DataFrame | None = None, ordered: bool = False, periodic: tuple[bool, bool, bool] = (True, True, True), then: Callable[[DataFrame], DataFrame] = capsule.closest_approach, where: Column | None = None, keep: tuple[str, ...] = (), keep_other: tuple[str, ...] = (), reach: float | None = None, grid: Grid | None = None, way: str | None = None) -> DataFrame:
    """The cell-interaction join: candidate pairs, ``then`` (a pair expression), ``where`` (the theta condition).

    Two indexes give the same rows: cells of centres, on a grid of order 1 to ORDERS, and cells along
    axes, whose width follows radii and limit, not lengths. The cheaper one is taken by the
    loads of coarse cells; ``way`` ("axis", or the order as a digit) sets it. The axes need a ``where`` that
    holds only for closest approaches (d) of at most both radii and ``limit``; without one, or
    with ``reach``, ``grid`` or another ``then``, the centres meet.
    """
    if reach is not None or grid is not None:
        reach = reach if reach is not None else reach_of(rods, limit, other)
        out = then(pairs(rods, grid or Grid.for_reach(box, reach, periodic), reach, other, ordered, keep, keep_other))
        return out if where is None else out.where(where)
    one = extent(rods, box, periodic)
    two = one if other is None else extent(other, box, periodic)
    most = one.radius + two.radius + limit + 2 * capsule.EPS
    reach, halved, exact = _reach((one.length, one.radius), (two.length, two.radius), limit), other is None and not ordered, then is capsule.closest_approach and where is not None
    costs = {str(k): centre_cost(one, two, reach, k, halved) for k in range(1, ORDERS + 1)}
    widths = [most * 2 ** (k / 2) for k in range(-2, 24)] if exact else []
    if widths:
        width = min(widths, key=lambda w: axis_cost(one, two, most, w, halved))
        costs["axis"] = axis_cost(one, two, most, width, halved)
    way = way or min(costs, key=costs.get)
    if way == "axis":
        cells = AxisGrid.of(box, width, periodic, most / 2, one, two)
        out = reference(then(axis_pairs(rods, cells, box, reach, most, other, ordered, keep, keep_other)), cells)
    else:
        cells = Grid.for_reach(box, reach, periodic, int(way))
        out = then(pairs(rods, cells, reach, other, ordered, keep, keep_other, int(way), most if exact else None))
    return out if where is None else out.where(where)


#: Columns of a pair with its closest approach, without those kept of the rods.
PAIR = ["i", "j", "x1", "y1", "z1", "bx", "by", "bz", "c1x", "c1y", "c1z", "l1", "a1", "c2x", "c2y", "c2z", "l2", "a2", "cc", "u1", "u2", "t1", "t2", "d", "du", "unclamped"]


def cell_grid(rods: DataFrame, box: tuple[float, float, float], theta: tuple, columns: list[str], periodic: tuple[bool, bool, bool] = (True, True, True), ends: bool = False, tests: float = math.inf) -> tuple[AxisGrid, float, float] | None:
    """Cells of the width that costs least for ``cells.near`` (with at most ``tests`` an entry), how far axes of pairs can be apart, and nanoseconds; None where a rod with its margins might reach around the box, or without rods."""
    one = extent(rods, box, periodic)
    most = 2 * one.radius + theta[1] + 2 * capsule.EPS if theta[0] == "touch" else 2 * one.radius * max(1.0, theta[2]) + theta[1] + 2 * capsule.EPS
    if not one.rods or most <= 0:
        return None
    half = (most if ends else most / 2) + (2 * one.radius + 2 * capsule.EPS if "hidden" in columns else 0.0)
    best = None
    for width in (most * 2 ** (k / 4) for k in range(-4, 60)):
        grid = AxisGrid.of(box, width, periodic, half, one, one)
        if all(n > 1 or not p for n, p in zip(grid.ext, periodic)):
            spent = by_cell.cost(one, 2 * half, max(grid.width(i) for i in range(3)), tests)
            if best is None or spent < best[0]:
                best = spent, grid
    return best and (best[1], most, best[0])


def in_cells(rods: DataFrame, box: tuple[float, float, float], theta: tuple, columns: list[str], periodic: tuple[bool, bool, bool] = (True, True, True), keep: tuple[str, ...] = (), reduce: Callable[..., dict] | None = None, schema: str | None = None) -> DataFrame | None:
    """``cells.near`` with cells of the width that costs least; None where ``cell_grid`` has none."""
    found = cell_grid(rods, box, theta, columns, periodic)
    return found and by_cell.near(rods, found[0], box, found[1], found[2] / 1e9, theta, columns, keep, reduce, schema)


#: Rods up to which ``contacts`` joins, as Python workers would cost more than the pairs.
FEW = 2_000


def contacts(rods: DataFrame, box: tuple[float, float, float], limit: float, periodic: tuple[bool, bool, bool] = (True, True, True), keep: tuple[str, ...] = (), columns: list[str] | None = None, **options) -> DataFrame:
    """Pairs of rods whose surfaces are within ``limit``, with ``columns`` of them, if given."""
    if not options and rods.limit(FEW + 1).count() > FEW:
        found = in_cells(rods, box, ("contact", limit, 1.0), [*(columns or PAIR), *(k + e for e in "12" for k in keep)], periodic, keep)
        if found is not None:
            return found
    found = spatial_join(rods, box, limit, where=capsule.intersects(limit), periodic=periodic, keep=keep, **options)
    return found if columns is None else found.select(*columns, *(k + e for e in "12" for k in keep))


def listed(rods: DataFrame, box: tuple[float, float, float], limit: float, both: bool = False, digits: int = 9) -> DataFrame:
    """(i, j, d) of ``contacts`` with i < j, d rounded in the cells; ``both``: from either of their rods."""
    found = in_cells(rods, box, ("contact", limit, 1.0), ["i", "j", "d"], reduce=by_cell.listed(both, digits), schema="i long, j long, d double")
    if found is not None:
        return found
    found = contacts(rods, box, limit, columns=["i", "j", "d"]).select(F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"), F.round("d", digits).alias("d"))
    turned = F.explode(F.array(F.struct("i", "j"), F.struct(F.col("j").alias("i"), F.col("i").alias("j"))))
    return found.select(turned.alias("p"), "d").select("p.i", "p.j", "d") if both else found


def degrees(rods: DataFrame, box: tuple[float, float, float], limit: float, periodic: tuple[bool, bool, bool] = (True, True, True)) -> DataFrame:
    """(rod_id, n) of the rods with contacts, counted in the cells."""
    each = in_cells(rods, box, ("contact", limit, 1.0), [], periodic, reduce=by_cell.degrees, schema="rod_id long, n long")
    if each is None:
        each = contacts(rods, box, limit, periodic, columns=["i", "j"]).select(F.explode(F.array("i", "j")).alias("rod_id"), F.lit(1).alias("n"))
    return each.groupBy("rod_id").agg(F.sum("n").alias("n"))


def with_two(rods: DataFrame, box: tuple[float, float, float], limit: float, periodic: tuple[bool, bool, bool], asked: Column) -> DataFrame | None:
    """(rod_id) of rods, of those ``asked``, that are sure to have two contacts (``cells.twice``); None where the box is too small for its cells."""
    theta = ("contact", limit, 1.0)
    found = cell_grid(rods, box, theta, [], periodic, tests=by_cell.TESTS)
    if found is None:
        return None
    each = by_cell.twice(rods.select("rod_id", *FIELDS, asked.alias("asked")), found[0], box, found[1], found[2] / 1e9, theta)
    return each.groupBy("rod_id").agg(F.sum("n").alias("n")).where("n >= 2").select("rod_id")


def centre_pairs(rods: DataFrame, box: tuple[float, float, float], radius: float) -> DataFrame:
    """(i, j, r): each pair of centres at most ``radius`` apart, under the nearest image."""
    r = F.sqrt(F.col("bx") * F.col("bx") + F.col("by") * F.col("by") + F.col("bz") * F.col("bz"))
    return spatial_join(rods, box, 0.0, reach=radius, then=lambda p: p.select("i", "j", r.alias("r")))


# ---- elimination ------------------------------------------------------------------------------------------------


# Ids of rods that go are written before the rods meet them: joined to its own inputs, the plan
# of the geometry takes the optimizer minutes.


def _struck(rods: DataFrame, box: tuple[float, float, float], separation: float, soft: float, sorted_ids: bool = False) -> DataFrame | None:
    """(rod_id), written, of the rods that ``cells.struck`` finds; None where the box is too small for its cells."""
    theta = ("contact", separation, soft)
    found = cell_grid(rods, box, theta, [], tests=by_cell.TESTS)
    return found and table(by_cell.struck(rods, found[0], box, found[1], found[2] / 1e9, theta, sorted_ids).distinct(), "dead")


def eliminate_same_cell(rods: DataFrame, box: tuple[float, float, float], grid: Grid, seq: str = "rod_id", separation: float = 0.0, soft: float = 1.0) -> DataFrame:
    """Rods that intersect no later rod (by ``seq``) of their own cell, all tested against the same snapshot."""
    cell = grid.join_id(F.col("x"), F.col("y"), F.col("z"))
    dead = _struck(rods.select("rod_id", *FIELDS, F.col(seq).alias("rank"), cell.alias("share")), box, separation, soft)
    if dead is not None:
        return rods.join(dead, "rod_id", "left_anti")
    a = rods.select("rod_id", *FIELDS, F.col(seq).alias("seq"), cell.alias("cell"))
    left = a.select(F.col("rod_id").alias("i"), *[F.col(f).alias(f + "1") for f in FIELDS], F.col("seq").alias("s1"), F.col("cell").alias("k1"))
    right = a.select(F.col("rod_id").alias("j"), *[F.col(f).alias(f + "2") for f in FIELDS], F.col("seq").alias("s2"), F.col("cell").alias("k2"))
    gap = [min_image(F.col(v + "2") - F.col(v + "1"), F.lit(float(n))) for v, n in zip("xyz", box)]
    reach = reach_of(rods, separation) + max(0.0, soft - 1) * 2 * (rods.agg(F.max("a")).first()[0] or 0.0)
    p = left.hint("merge").join(right, (F.col("k1") == F.col("k2")) & (F.col("s2") > F.col("s1")) & (gap[0] * gap[0] + gap[1] * gap[1] + gap[2] * gap[2] <= reach * reach))
    p = p.select("i", "j", *[min_image(F.col(v + "2") - F.col(v + "1"), F.lit(float(n))).alias("b" + v) for v, n in zip("xyz", box)], *[F.col(f"c{v}{k}").alias(f"c{k}{v}") for k in (1, 2) for v in "xyz"], "l1", "a1", "l2", "a2")
    dead = table(capsule.closest_approach(p).where(capsule.intersects(separation, soft)).select(F.col("i").alias("rod_id")).distinct(), "dead")
    return rods.join(dead, "rod_id", "left_anti")


def eliminate_against(rods: DataFrame, old: DataFrame, box: tuple[float, float, float], separation: float = 0.0, soft: float = 1.0) -> DataFrame:
    """Rods that intersect no rod of ``old``."""
    hit = spatial_join(rods, box, separation, other=old, where=capsule.intersects(separation, soft))
    return rods.join(table(hit.select(F.col("i").alias("rod_id")).distinct(), "dead"), "rod_id", "left_anti")


#: Rods of the first part of an insertion, and how much larger the whole is after each further one.
PART, GROWTH = 65_536, 8


def greedy_insert(rods: DataFrame, box: tuple[float, float, float], keep: Callable[[DataFrame], DataFrame], separation: float = 0.0, soft: float = 1.0, seq: str = "rod_id", rounds: int = 200, then: Callable[[DataFrame], DataFrame] = capsule.closest_approach) -> DataFrame:
    """The rods that stay if they are inserted in the order of ``seq`` and each is refused if it intersects one that stayed.

    Found without an order of execution. Rods come in parts of the order, each a few times what came before. Of a part go
    first those that intersect a rod that stayed before (``cells.struck``); what is left has few partners in
    its part, however many all rods have, so pairs written follow the rods. They are settled by ``_refused``.
    """
    n, some = rods.count(), then is capsule.closest_approach
    parts = 1 if n <= PART or not some else 1 + math.ceil(math.log(n / PART, GROWTH))
    if parts == 1:
        gone = _refused(rods, box, keep, separation, soft, seq, rounds, then)
        return rods if gone is None else rods.join(gone, "rod_id", "left_anti")
    shares = [PART * GROWTH**k / n for k in range(parts - 1)]
    bounds = rods.agg(F.percentile_approx(seq, shares, 10_000)).first()[0]
    stayed, low = None, None
    for high in [*bounds, None]:
        part = rods if low is None else rods.where(F.col(seq) > F.lit(low)) if high is not None else rods.where(F.coalesce(F.col(seq) > F.lit(low), F.lit(True)))
        part = part if high is None else part.where(F.col(seq) <= F.lit(high))
        low = high
        dead = None
        if stayed is not None:
            both = part.select("rod_id", *FIELDS, F.lit(0).cast("long").alias("rank")).union(stayed.select("rod_id", *FIELDS, F.lit(1).cast("long").alias("rank")))
            dead = _struck(both.withColumn("share", F.lit(0).cast("long")), box, separation, soft, True)
            if dead is None:
                dead = table(spatial_join(part, box, separation, other=stayed, where=capsule.intersects(separation, soft)).select(F.col("i").alias("rod_id")).distinct(), "dead")
            part = part.join(dead, "rod_id", "left_anti")
        fresh = keep(part.select("rod_id", *FIELDS, *({seq} - {"rod_id", *FIELDS})))
        discard(dead)
        gone = _refused(fresh, box, keep, separation, soft, seq, rounds, then)
        more = (fresh if gone is None else fresh.join(gone, "rod_id", "left_anti")).select("rod_id", *FIELDS)
        before, stayed = stayed, keep(more if stayed is None else stayed.union(more))
        discard(before, fresh, gone)
    return rods.join(stayed.select("rod_id"), "rod_id", "left_semi")


def _refused(rods: DataFrame, box: tuple[float, float, float], keep: Callable[[DataFrame], DataFrame], separation: float, soft: float, seq: str, rounds: int, then: Callable[[DataFrame], DataFrame]) -> DataFrame | None:
    """(rod_id) of the rods that do not stay; None if there are none.

    In each round a rod stays if none of its undecided partners comes before it, and goes if a partner stayed. ``keep``
    writes a table and reads it back, which keeps the lineage short.
    """
    hit = spatial_join(rods, box, separation, then=then, where=capsule.intersects(separation, soft), keep=(seq,))
    edges = keep(hit.select(F.when(F.col(seq + "1") < F.col(seq + "2"), F.col("i")).otherwise(F.col("j")).alias("first"), F.when(F.col(seq + "1") < F.col(seq + "2"), F.col("j")).otherwise(F.col("i")).alias("later")))
    gone, open_ = None, edges
    for _ in range(rounds):
        if not open_.limit(1).count():
            break
        waits = open_.select("later").distinct()
        stays = open_.select(F.col("first").alias("later")).distinct().join(waits, "later", "left_anti").withColumnRenamed("later", "first")
        out = keep(open_.join(stays, "first").select("later").distinct())
        left = open_.join(stays, "first", "left_anti").join(out, "later", "left_anti")
        before, open_ = open_, keep(left.join(out.withColumnRenamed("later", "first"), "first", "left_anti"))
        if gone is None:
            gone = out
        else:
            was, gone = gone, keep(gone.union(out))
            discard(was, out)
        discard(before)
    else:
        raise RuntimeError("insertion did not settle")
    if gone is None:
        return None
    out = gone.withColumnRenamed("later", "rod_id")
    out._rodlake_path = getattr(gone, "_rodlake_path", None)
    return out


def clusterise(rods: DataFrame, old: DataFrame, box: tuple[float, float, float], distance: float, angle: float, separation: float = 0.0) -> DataFrame:
    """Snap each new rod to an old one that is close and nearly parallel: parallel to it, and just touching.

    Of several old rods the one with the largest id counts. Others stay as they are.
    """
    found = by_cell.snaps(rods.select("rod_id", *FIELDS), old.select("rod_id", *FIELDS), box, distance, math.cos(angle), max(v or 0.0 for d in (rods, old) for v in d.agg(F.max("l")).first()) / 2)
    if found is None:
        r = F.sqrt(F.col("bx") * F.col("bx") + F.col("by") * F.col("by") + F.col("bz") * F.col("bz"))
        near = (r < F.greatest("l1", "l2") / 2.0) & (F.abs(F.col("cc")) >= math.cos(angle)) & (F.col("d") <= distance)
        p = spatial_join(rods, box, distance, other=old, where=near)
        found = p.groupBy("i").agg(F.max_by(F.struct("bx", "by", "bz", "c2x", "c2y", "c2z", "a2", "u1", "u2", "cc"), "j").alias("m")).select("i", "m.*")
    best = table(found, "snap")
    df = rods.join(best.withColumnRenamed("i", "rod_id"), "rod_id", "left")
    # from the old rod's foot of the common perpendicular to the new one's, without the part along the old axis
    off = {v: F.col(f"c{v}") * F.col("u1") - F.col(f"b{v}") - F.col(f"c2{v}") * F.col("u2") for v in "xyz"}
    df = let(df, **{f"o{v}": e for v, e in off.items()})
    df = let(df, along=F.col("ox") * F.col("c2x") + F.col("oy") * F.col("c2y") + F.col("oz") * F.col("c2z"))
    df = let(df, **{f"w{v}": F.col(f"o{v}") - F.col(f"c2{v}") * F.col("along") for v in "xyz"})
    df = let(df, wide=F.sqrt(F.col("wx") * F.col("wx") + F.col("wy") * F.col("wy") + F.col("wz") * F.col("wz")))
    gap = F.col("a") + F.col("a2") + separation
    new = {}
    for v, n in zip("xyz", box):
        at = F.col(v) + F.col(f"b{v}") + F.col(f"c2{v}") * F.col("u2") + F.col(f"w{v}") / F.col("wide") * gap - F.col(f"c2{v}") * (F.col("cc") * F.col("u1"))
        new[v] = F.when(F.col("wide") > 0, at - n * F.floor(at / n)).otherwise(F.col(v))
        new[f"c{v}"] = F.when(F.col("wide") > 0, F.col(f"c2{v}")).otherwise(F.col(f"c{v}"))
    return df.select(*[new.get(c, F.col(c)).alias(c) for c in rods.columns])
