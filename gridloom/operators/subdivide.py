"""Polygons cut by a grid: a geometry for each covered cell.

A box of cells with the rings in it is halved across its longer side by half-plane
clipping until it is one cell, or until what is left in it is one rectangle along the
axes, whose cells need no clipping. So a ring of n points that meets k cells costs
about n log k, and the cells inside it little more than their text. Large boxes are
dealt to other tasks on the way.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.functions.grid import Grid
from gridloom.shared import cut, drop_cut
from gridloom.sources.geometry import GeometryError, decode, signed_area

Ring = list[tuple[float, float]]


def clip(ring: Ring, axis: int, at: float, keep_above: bool) -> Ring:
    """The part of a ring (without its closing point) on one side of an axis-parallel line."""
    along = [p[axis] for p in ring]
    if not ring or (min(along) >= at if keep_above else max(along) <= at):
        return ring
    if max(along) < at if keep_above else min(along) > at:
        return []
    out: Ring = []
    for a, b in zip(ring, ring[1:] + ring[:1]):
        inside, then = (a[axis] >= at, b[axis] >= at) if keep_above else (a[axis] <= at, b[axis] <= at)
        if inside:
            out.append(a)
        if inside != then and a[axis] != b[axis]:
            t = (at - a[axis]) / (b[axis] - a[axis])
            other = a[1 - axis] + t * (b[1 - axis] - a[1 - axis])
            out.append((at, other) if axis == 0 else (other, at))
    return out


def bands(ring: Ring, axis: int, first: int, last: int, edge: Callable[[int], float]) -> Iterator[tuple[int, Ring]]:
    """The parts of a ring between the lines ``edge(k)`` and ``edge(k + 1)``, for each k of ``first..last``; lines may go up or down."""
    if len(ring) < 3 or first > last:
        return
    if first == last:
        yield first, ring
        return
    middle = (first + last + 1) // 2
    up = edge(last + 1) > edge(first)
    yield from bands(clip(ring, axis, edge(middle), not up), axis, first, middle - 1, edge)
    yield from bands(clip(ring, axis, edge(middle), up), axis, middle, last, edge)


def _text(ring: Ring) -> str:
    return "(" + ", ".join(f"{x!r} {y!r}" for x, y in [*ring, ring[0]]) + ")"


@dataclass
class Work:
    """Rings (part, number in the part, points) within a box of cells: first and last row and column."""

    r0: int
    r1: int
    c0: int
    c1: int
    rings: list[tuple[int, int, Ring]]

    @property
    def cells(self) -> int:
        return (self.r1 - self.r0 + 1) * (self.c1 - self.c0 + 1)


def whole(value: bytes | str, grid: Grid) -> Work | None:
    """A polygon with the box of cells that it may cover; none off the grid."""
    rings, xs, ys = [], [], []
    for k, (kind, parts) in enumerate(decode(value)):
        if kind != "P":
            raise GeometryError("Unsupported geometry type.")
        for i, ring in enumerate(parts):
            ring = ring[:-1] if ring[0] == ring[-1] else ring
            rings.append((k, i, ring))
            xs += [p[0] for p in ring]
            ys += [p[1] for p in ring]
    if not rings:
        return None
    c0, c1 = max(0, int((min(xs) - grid.xmin) // grid.dx)), min(grid.cols - 1, int((max(xs) - grid.xmin) // grid.dx))
    r0, r1 = max(0, int((grid.ymax - max(ys)) // grid.dy)), min(grid.rows - 1, int((grid.ymax - min(ys)) // grid.dy))
    if c0 > c1 or r0 > r1:
        return None
    x_of, y_of = _lines(grid)
    cut_off = lambda ring: clip(clip(clip(clip(ring, 0, x_of(c0), True), 0, x_of(c1 + 1), False), 1, y_of(r1 + 1), True), 1, y_of(r0), False)
    return Work(r0, r1, c0, c1, _rings((k, i, cut_off(ring)) for k, i, ring in rings))


def _lines(grid: Grid) -> tuple[Callable[[int], float], Callable[[int], float]]:
    return (lambda k: grid.xmin + k * grid.dx), (lambda k: grid.ymax - k * grid.dy)


def _rings(rings) -> list[tuple[int, int, Ring]]:
    return [(k, i, ring) for k, i, ring in rings if len(ring) >= 3]


def halves(work: Work, grid: Grid) -> list[Work]:
    """The two halves of a box of several cells across its longer side, without those that no ring meets."""
    x_of, y_of = _lines(grid)
    if work.c1 - work.c0 >= work.r1 - work.r0:
        m = (work.c0 + work.c1 + 1) // 2
        out = [Work(work.r0, work.r1, *cols, _rings((k, i, clip(ring, 0, x_of(m), above)) for k, i, ring in work.rings)) for cols, above in (((work.c0, m - 1), False), ((m, work.c1), True))]
    else:
        m = (work.r0 + work.r1 + 1) // 2
        out = [Work(*rows, work.c0, work.c1, _rings((k, i, clip(ring, 1, y_of(m), above)) for k, i, ring in work.rings)) for rows, above in (((work.r0, m - 1), True), ((m, work.r1), False))]
    return [w for w in out if w.rings]


def smaller(work: Work, grid: Grid, most: int) -> Iterator[Work]:
    """A box in boxes of at most ``most`` cells."""
    todo = [work]
    while todo:
        w = todo.pop()
        if w.cells <= most:
            yield w
        else:
            todo += reversed(halves(w, grid))


def rectangle(ring: Ring) -> tuple[float, float, float, float] | None:
    """``xmin, ymin, xmax, ymax`` if a ring bounds a rectangle along the axes, whatever points lie on its sides."""
    if len(ring) > 4:
        kept: Ring = []
        for p in ring:
            while kept and (kept[-1] == p or len(kept) > 1 and any(kept[-2][k] == kept[-1][k] == p[k] for k in (0, 1))):
                kept.pop()
            kept.append(p)
        while len(kept) > 4 and any(kept[-1][k] == kept[0][k] == kept[1][k] for k in (0, 1)):
            kept.pop(0)
        while len(kept) > 4 and any(kept[-2][k] == kept[-1][k] == kept[0][k] for k in (0, 1)):
            kept.pop()
        ring = kept
    if len(ring) != 4:
        return None
    (ax, ay), (bx, by), (cx, cy), (dx, dy) = ring
    if not (ax == bx and by == cy and cx == dx and dy == ay or ay == by and bx == cx and cy == dy and dx == ax):
        return None
    return min(ax, cx), min(ay, cy), max(ax, cx), max(ay, cy)


def _of_rectangle(work: Work, box: tuple[float, float, float, float], left: bool, grid: Grid) -> Iterator[tuple[int, int, float, str]]:
    """The cells of a box that a rectangle covers in part; ``left``: it is counter-clockwise."""
    x_of, y_of = _lines(grid)
    least = 1e-9 * grid.dx * grid.dy
    columns = [(c, b - a, repr(a), repr(b)) for c in range(work.c0, work.c1 + 1) for a, b in [(max(box[0], x_of(c)), min(box[2], x_of(c + 1)))] if a < b]
    for r in range(work.r0, work.r1 + 1):
        low, high = max(box[1], y_of(r + 1)), min(box[3], y_of(r))
        down, up = repr(low), repr(high)
        for c, width, a, b in columns:
            if (area := width * (high - low)) > least:
                p, q = (f"{b} {down}", f"{a} {up}") if left else (f"{a} {up}", f"{b} {down}")
                yield r, c, area, f"POLYGON (({a} {down}, {p}, {b} {up}, {q}, {a} {down}))"


def cells(work: Work, grid: Grid) -> Iterator[tuple[int, int, float, str]]:
    """``row, col, area, WKT`` for each cell that the rings cover in part; one cell at a time."""
    todo = [work]
    while todo:
        w = todo.pop()
        if not w.rings:
            continue
        boxes = [rectangle(ring) for _, _, ring in w.rings]
        if len(boxes) == 1 and boxes[0]:
            if not w.rings[0][1]:
                yield from _of_rectangle(w, boxes[0], signed_area(w.rings[0][2]) > 0, grid)
            continue
        if boxes[0] and len(set(boxes)) == 1 and sum(-1 if i else 1 for _, i, _ in w.rings) <= 0:
            continue  # a hole takes all
        if w.cells > 1:
            todo += reversed(halves(w, grid))
            continue
        polygons: dict[int, list[Ring]] = {}
        area = 0.0
        for k, i, piece in w.rings:
            if (own := abs(signed_area(piece))) > 1e-12 * grid.dx * grid.dy:
                area += own * (-1 if i else 1)
                polygons.setdefault(k, []).append(piece)
        if area > 1e-9 * grid.dx * grid.dy:
            bodies = ["(" + ", ".join(_text(p) for p in rings) + ")" for rings in polygons.values()]
            yield w.r0, w.c0, area, f"POLYGON {bodies[0]}" if len(bodies) == 1 else "MULTIPOLYGON (" + ", ".join(bodies) + ")"


def pieces(value: bytes | str, grid: Grid) -> Iterator[tuple[int, int, float, str]]:
    """``row, col, area, WKT`` for each cell that a polygon covers in part."""
    work = whole(value, grid)
    if work:
        yield from cells(work, grid)


_RINGS = "array<struct<part:int,ring:int,points:array<double>>>"
_WORK = f"r0 int, r1 int, c0 int, c1 int, rings {_RINGS}"
_WORK_TYPES = [pa.int32()] * 4 + [pa.list_(pa.struct([("part", pa.int32()), ("ring", pa.int32()), ("points", pa.list_(pa.float64()))]))]
#: Cells of a box that a task cuts, boxes that a round makes of one, rows (or points of rings) of a batch.
MOST_CELLS, HALVED, ROWS, POINTS = 1 << 16, 16, 1000, 50_000


def _row(w: Work) -> tuple:
    return w.r0, w.r1, w.c0, w.c1, [{"part": k, "ring": i, "points": [x for p in ring for x in p]} for k, i, ring in w.rings]


def _work(row: list) -> Work:
    return Work(*row[:4], [(x["part"], x["ring"], list(zip(x["points"][0::2], x["points"][1::2]))) for x in row[4]])


def _points(row: tuple) -> int:
    """The size of a row of work: its rings' numbers."""
    return 1 + sum(len(x["points"]) for x in row[4])


def _mapped(key: str, types: list[pa.DataType], names: list[str], of: Callable[[list], Iterator[tuple]], most: int, size: Callable[[tuple], int] = lambda row: 1):
    """A step that makes rows ``names`` of each row, with its key before them, in batches that end once they have the size ``most``."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            held, of_row, has = [], [], 0

            def out() -> pa.RecordBatch:
                ids = batch.column(0).take(pa.array(of_row))
                return pa.RecordBatch.from_arrays([ids, *[pa.array(c, t) for c, t in zip(zip(*held), types)]], names=[key, *names])

            for i in range(batch.num_rows):
                for row in of([batch.column(j)[i].as_py() for j in range(1, batch.num_columns)]):
                    held.append(row)
                    of_row.append(i)
                    has += size(row)
                    if has >= most:
                        yield out()
                        held, of_row, has = [], [], 0
            if held:
                yield out()

    return run


def subdivide(features: DataFrame, grid: Grid, key: str, geometry: str = "geometry", most_cells: int = MOST_CELLS) -> DataFrame:
    """``key, row, col, area, geometry`` (WKT) for each cell of each polygon.

    A polygon over more than ``most_cells`` cells is cut into :data:`HALVED`
    boxes, which are dealt to tasks and cut again, round by round, until all are
    small; then each is cut into its cells, which leave the task as they are made.
    """
    kind = f"`{key}` {features.schema[key].dataType.simpleString()}"

    def small(row: list) -> Iterator[tuple]:
        work = whole(row[0], grid) if row[0] is not None else None
        if work and work.cells <= most_cells:
            yield from cells(work, grid)

    def large(row: list) -> Iterator[tuple]:
        work = whole(row[0], grid) if row[0] is not None else None
        if work and work.cells > most_cells and work.rings:
            yield _row(work)

    def again(row: list) -> Iterator[tuple]:
        work = _work(row)
        yield from map(_row, smaller(work, grid, max(most_cells, -(-work.cells // HALVED))))

    def last(row: list) -> Iterator[tuple]:
        yield from cells(_work(row), grid)

    names, types = ["r0", "r1", "c0", "c1", "rings"], [pa.int32(), pa.int32(), pa.float64(), pa.string()]
    # a small file, which is one partition, may hold polygons for hours of work
    spark = features.sparkSession
    dealt = max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))  # type: ignore[arg-type]
    given, to_cells = features.select(key, F.col(geometry)).repartition(dealt), f"{kind}, row int, col int, area double, geometry string"
    made = lambda of: _mapped(key, types, ["row", "col", "area", "geometry"], of, ROWS)
    boxes = lambda of: _mapped(key, _WORK_TYPES, names, of, POINTS, _points)
    work = cut(given.mapInArrow(boxes(large), f"{kind}, {_WORK}"), "sub-boxes")
    out = given.mapInArrow(made(small), to_cells)
    most, tasks = _measure(work)
    while most > most_cells:
        new = cut(work.repartition(tasks, *names[:4]).mapInArrow(boxes(again), f"{kind}, {_WORK}"), "sub-boxes")
        drop_cut(work)
        work = new
        most, tasks = _measure(work)
    return out.unionByName(work.repartition(tasks, *names[:4]).mapInArrow(made(last), to_cells)) if most else out


def _measure(work: DataFrame) -> tuple[int, int]:
    """Cells of the largest box, and tasks for all boxes by their cells, of which their bytes say little: several for each core, and one for each :data:`MOST_CELLS`."""
    size = (F.col("r1") - F.col("r0") + 1).cast("long") * (F.col("c1") - F.col("c0") + 1)
    boxes, most, total = work.agg(F.count("*"), F.max(size), F.sum(size)).first()  # type: ignore[misc]
    cores = work.sparkSession.sparkContext.defaultParallelism
    return most or 0, max(1, min(boxes, 10_000, max(4 * cores, (total or 0) // MOST_CELLS)))
