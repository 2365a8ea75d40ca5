"""The periodic cell grid: ids, coordinates, neighbours, images, electrode layers."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Grid:
    """Cells of a box. ``periodic`` tells the axes that wrap. Cell id = ix + iy*nx + iz*nx*ny."""

    box: tuple[float, float, float]
    ext: tuple[int, int, int]
    periodic: tuple[bool, bool, bool] = (True, True, True)

    @staticmethod
    def for_reach(box: tuple[float, float, float], reach: float, periodic: tuple[bool, bool, bool] = (True, True, True), order: int = 1) -> "Grid":
        """The finest grid whose cells are at least ``reach / order`` wide, so that the ``strides`` of that order hold every neighbour."""
        return Grid(box, tuple(max(1, min(2_000_000, math.floor(n * order / reach))) for n in box), periodic)

    @property
    def cells(self) -> int:
        return self.ext[0] * self.ext[1] * self.ext[2]

    def axis(self, x: Column, i: int) -> Column:
        """Cell number along axis i. A periodic axis wraps; else places outside belong to the outermost cell."""
        n = F.floor(x / self.box[i] * self.ext[i])
        return F.pmod(n, F.lit(self.ext[i])) if self.periodic[i] else F.greatest(F.lit(0), F.least(n, F.lit(self.ext[i] - 1)))

    def join_id(self, x: Column, y: Column, z: Column) -> Column:
        return self.compose(self.axis(x, 0), self.axis(y, 1), self.axis(z, 2))

    def compose(self, ix: Column, iy: Column, iz: Column) -> Column:
        return (ix + iy * self.ext[0] + iz * (self.ext[0] * self.ext[1])).cast("long")

    def split(self, cell: Column) -> tuple[Column, Column, Column]:
        nx, ny, _ = self.ext
        return (cell % nx).cast("int"), (F.floor(cell / nx) % ny).cast("int"), F.floor(cell / (nx * ny)).cast("int")

    def moved(self, cell: Column, stride: tuple[int, int, int]) -> Column:
        """The neighbour at a stride; null beyond an axis that does not wrap."""
        at, ok = [], F.lit(True)
        for c, s, n, p in zip(self.split(cell), stride, self.ext, self.periodic):
            at.append(F.pmod(c + s, F.lit(n)) if p else c + s)
            if not p:
                ok = ok & (c + s >= 0) & (c + s < n)
        return F.when(ok, self.compose(*at))

    def shift(self, cell: Column, stride: tuple[int, int, int]) -> tuple[Column, Column, Column]:
        """What to add to a neighbour's coordinates to bring it beside the cell, along each axis."""
        out = []
        for c, s, n, length, p in zip(self.split(cell), stride, self.ext, self.box, self.periodic):
            out.append(F.floor((c + s) / n) * length if p else F.lit(0.0))
        return tuple(out)

    def inside(self, cell: Column, x: Column, y: Column, z: Column, margin: float = 1e-6) -> Column:
        """Whether a place lies in the cell, with a margin."""
        ok = F.lit(True)
        for c, v, n, length in zip(self.split(cell), (x, y, z), self.ext, self.box):
            e = length / n
            ok = ok & (v >= c * e - margin) & (v <= (c + 1) * e + margin)
        return ok

    def strides(self, order: int = 1, reach: float | None = None) -> list[tuple[int, int, int]]:
        """Distinct strides to cells within ``order`` along each axis; fewer where an axis that wraps has under 2 * order + 1 cells.

        Cells whose nearest corners are farther apart than ``reach`` (order cells of the
        widest axis, if not given) hold no neighbour and are left out.
        """
        edge = [length / n for length, n in zip(self.box, self.ext)]
        reach = order * min(edge) if reach is None else reach

        def one(n: int, p: bool) -> list[int]:
            if p and n < 2 * order + 1:
                return list(range(n))
            return [s for s in range(-order, order + 1) if p or abs(s) < n]

        def near(s: int, i: int) -> float:
            least = min(abs(s), self.ext[i] - abs(s)) if self.periodic[i] else abs(s)
            return max(0, least - 1) * edge[i]

        every = [(i, j, k) for k in one(self.ext[2], self.periodic[2]) for j in one(self.ext[1], self.periodic[1]) for i in one(self.ext[0], self.periodic[0])]
        return [s for s in every if math.sqrt(sum(near(v, i) ** 2 for i, v in enumerate(s))) <= reach * (1 + 1e-9)]

    def halves(self, order: int = 1, reach: float | None = None) -> list[tuple[int, int, int]] | None:
        """About half of the strides such that each unordered pair of cells is met once; None if an axis that wraps has under 2 * order + 1 cells."""
        if any(n < 2 * order + 1 and p for n, p in zip(self.ext, self.periodic)):
            return None
        return [s for s in self.strides(order, reach) if (s[2], s[1], s[0]) >= (0, 0, 0)]

    def padded(self, axis: int, layers: int) -> "Grid":
        """The grid with ``layers`` more cells at both ends of an axis, which no longer wraps."""
        grow = lambda v, i, e: v + 2 * layers * e if i == axis else v
        return Grid(
            tuple(grow(n, i, n / self.ext[i]) for i, n in enumerate(self.box)),
            tuple(grow(n, i, 1) for i, n in enumerate(self.ext)),
            tuple(p and i != axis for i, p in enumerate(self.periodic)),
        )

    def padded_id(self, cell: Column, axis: int, layers: int) -> Column:
        """The id in the padded grid of a cell of this one."""
        at = [c + layers if i == axis else c for i, c in enumerate(self.split(cell))]
        return self.padded(axis, layers).compose(*at)


def electrode(coordinate: Column, length: float) -> Column:
    """Role of a place along the axis between the electrodes: source before 0, sink from ``length``, else internal."""
    return F.when(coordinate < 0, "source").when(coordinate >= length, "sink").otherwise("internal")
