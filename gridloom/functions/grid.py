"""Boxes and regular grids: plain values on the driver, literals in plans."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

EARTH_RADIUS = 6378137.0


@dataclass(frozen=True)
class Box:
    """An axis-aligned box; boxes that touch intersect."""

    xmin: float
    ymin: float
    xmax: float
    ymax: float

    @property
    def empty(self) -> bool:
        return not (self.xmin < self.xmax and self.ymin < self.ymax)

    def intersects(self, other: Box) -> bool:
        return self.xmin <= other.xmax and other.xmin <= self.xmax and self.ymin <= other.ymax and other.ymin <= self.ymax

    def contains(self, other: Box) -> bool:
        return self.xmin <= other.xmin and self.ymin <= other.ymin and self.xmax >= other.xmax and self.ymax >= other.ymax

    def intersection(self, other: Box) -> Box:
        if not self.intersects(other):
            return Box(0.0, 0.0, 0.0, 0.0)
        return Box(max(self.xmin, other.xmin), max(self.ymin, other.ymin), min(self.xmax, other.xmax), min(self.ymax, other.ymax))

    def union(self, other: Box) -> Box:
        if self.empty:
            return other
        if other.empty:
            return self
        return Box(min(self.xmin, other.xmin), min(self.ymin, other.ymin), max(self.xmax, other.xmax), max(self.ymax, other.ymax))


class IncompatibleGrids(ValueError):
    """Two grids have no common refinement within tolerance."""


def _whole(x: float, tol: float) -> bool:
    return abs(x - round(x)) <= tol


@dataclass(frozen=True)
class Grid:
    """A regular grid; row 0 is the top row, cell = row * cols + col."""

    xmin: float
    ymin: float
    xmax: float
    ymax: float
    dx: float
    dy: float

    @classmethod
    def of_shape(cls, extent: Box, rows: int, cols: int) -> Grid:
        return cls(extent.xmin, extent.ymin, extent.xmax, extent.ymax, (extent.xmax - extent.xmin) / cols, (extent.ymax - extent.ymin) / rows)

    @classmethod
    def from_geotransform(cls, gt: tuple[float, ...], rows: int, cols: int) -> Grid:
        """North-up affine transform of six numbers."""
        if gt[2] or gt[4]:
            raise ValueError("Rotated rasters are not supported.")
        dx, dy = abs(gt[1]), abs(gt[5])
        return cls(gt[0], gt[3] - rows * dy, gt[0] + cols * dx, gt[3], dx, dy)

    @property
    def box(self) -> Box:
        return Box(self.xmin, self.ymin, self.xmax, self.ymax)

    @property
    def rows(self) -> int:
        return round((self.ymax - self.ymin) / self.dy)

    @property
    def cols(self) -> int:
        return round((self.xmax - self.xmin) / self.dx)

    @property
    def size(self) -> int:
        return self.rows * self.cols

    def column(self, x: float) -> int:
        """Column of a point; a point on an edge is in the right cell, but for the last edge."""
        if not self.xmin <= x <= self.xmax:
            raise IndexError("x outside the grid")
        return min(int(math.floor((x - self.xmin) / self.dx)), self.cols - 1)

    def row(self, y: float) -> int:
        """Row of a point; a point on an edge is in the lower cell, but for the last edge."""
        if not self.ymin <= y <= self.ymax:
            raise IndexError("y outside the grid")
        return min(int(math.floor((self.ymax - y) / self.dy)), self.rows - 1)

    def cell(self, x: float, y: float) -> int:
        return self.row(y) * self.cols + self.column(x)

    def x_of(self, col: int) -> float:
        return self.xmin + (col + 0.5) * self.dx

    def y_of(self, row: int) -> float:
        return self.ymax - (row + 0.5) * self.dy

    def window(self, row: int, col: int, rows: int, cols: int) -> Grid:
        top, left = self.ymax - row * self.dy, self.xmin + col * self.dx
        return Grid(left, top - rows * self.dy, left + cols * self.dx, top, self.dx, self.dy)

    def crop(self, box: Box) -> Grid:
        """The cells that a box touches."""
        b = self.box.intersection(box)
        if b.empty:
            return self.window(0, 0, 0, 0)
        r0, c0 = self.row(b.ymax), self.column(b.xmin)
        r1 = max(r0, min(self.rows, math.ceil((self.ymax - b.ymin) / self.dy)) - 1)
        c1 = max(c0, min(self.cols, math.ceil((b.xmax - self.xmin) / self.dx)) - 1)
        return self.window(r0, c0, r1 - r0 + 1, c1 - c0 + 1)

    def offset(self, other: Grid) -> tuple[int, int]:
        """Rows and columns of this grid from ``other``'s top left to its own."""
        return round((other.ymax - self.ymax) / self.dy), round((self.xmin - other.xmin) / self.dx)

    def compatible(self, other: Grid, tol: float = 1e-6) -> bool:
        """Whether cell sizes are whole multiples and origins whole cells apart, within tolerance."""
        if self.box.empty or other.box.empty:
            return True
        checks = ((self.dx, other.dx, self.xmin - other.xmin), (self.dy, other.dy, self.ymax - other.ymax))
        return all(_whole(max(a, b) / min(a, b), min(a, b) * tol) and _whole(abs(d) / min(a, b), min(a, b) * tol) for a, b, d in checks)

    def common(self, other: Grid, tol: float = 1e-6) -> Grid:
        """The finest of both cell sizes over both extents."""
        return self._joined(other, self.box.union(other.box), tol)

    def overlap(self, other: Grid, tol: float = 1e-6) -> Grid:
        """The finest of both cell sizes over the shared extent."""
        return self._joined(other, self.box.intersection(other.box), tol)

    def _joined(self, other: Grid, box: Box, tol: float) -> Grid:
        if not self.compatible(other, tol):
            raise IncompatibleGrids("Incompatible extents.")
        if other.box.empty:
            return self
        if self.box.empty:
            return other
        dx, dy = min(self.dx, other.dx), min(self.dy, other.dy)
        cols, rows = round((box.xmax - box.xmin) / dx), round((box.ymax - box.ymin) / dy)
        return Grid(box.xmin, min(box.ymin, box.ymax - rows * dy), max(box.xmax, box.xmin + cols * dx), box.ymax, dx, dy)

    def ratio(self, finer: Grid) -> tuple[int, int]:
        """Rows and columns of ``finer`` in a cell of this grid."""
        return round(self.dy / finer.dy), round(self.dx / finer.dx)

    def subdivide(self, max_cells: int) -> Iterator[Grid]:
        """Blocks of at most ``max_cells`` cells, whole rows if a row fits."""
        cols = min(self.cols, max_cells)
        rows = max(1, max_cells // max(1, cols)) if cols == self.cols else 1
        for r in range(0, self.rows, rows):
            for c in range(0, self.cols, cols):
                yield self.window(r, c, min(rows, self.rows - r), min(cols, self.cols - c))


def common_grid(grids: list[Grid], tol: float = 1e-6) -> Grid:
    """Common refinement of several grids."""
    out = grids[0]
    for g in grids[1:]:
        out = out.common(g, tol)
    return out
