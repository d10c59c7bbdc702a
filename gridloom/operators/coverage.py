"""The coverage join: which share of each grid cell a polygon covers, or how long a line runs in it.

Green's theorem in relational form, DataFrame operations only. An edge piece
inside a cell adds ``dv * (right side - mean u)`` to that cell and ``dv`` to
all cells to its right, so along a row a running sum of ``dv`` gives the
coverage: boundary cells from their own pieces, the runs between them from the
sum alone, without looking at any geometry. Partial sums combine before the
shuffle, which goes by feature and row, so one huge polygon still spreads over
its rows. A feature that is one rectangle along the axes (kind ``R``) needs none
of this: its coverage is the product of two overlaps.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions.grid import Grid

#: Coverage below this is rounding, and this close to one is one.
GHOST = 1e-9


def _int(c: Column) -> Column:
    return c.cast("int")


def _in_grid(edges: DataFrame, grid: Grid) -> DataFrame:
    """Edges in units of cells, down and right from the top left corner; those far away are dropped."""
    u = lambda x: (F.col(x) - F.lit(grid.xmin)) / F.lit(grid.dx)
    v = lambda y: (F.lit(grid.ymax) - F.col(y)) / F.lit(grid.dy)
    e = edges.select("fid", "sg", u("x0").alias("u0"), v("y0").alias("v0"), u("x1").alias("u1"), v("y1").alias("v1"))
    return e.where((F.greatest("v0", "v1") >= 0) & (F.least("v0", "v1") <= grid.rows) & (F.least("u0", "u1") <= grid.cols))


def _between(x: Column, low: Column, high: Column) -> Column:
    return F.least(F.greatest(x, low), high)


def _sweep(edges: DataFrame, grid: Grid) -> DataFrame:
    """Polygon edges -> ``fid, row, col, own, turn, run, next`` for every cell that an edge meets.

    ``run`` covers the cells from ``col`` on up to ``next``, the next cell that
    an edge of the feature meets in this row.
    """
    nr, nc = grid.rows, grid.cols
    e = _in_grid(edges, grid).where("v0 <> v1")
    e = e.withColumns({"ra": _int(F.greatest(F.floor(F.least("v0", "v1")), F.lit(0))), "rb": _int(F.least(F.ceil(F.greatest("v0", "v1")) - 1, F.lit(nr - 1)))})
    e = e.where("ra <= rb").select("*", F.explode(F.sequence("ra", "rb")).alias("row"))
    e = e.withColumns({"va": _between(F.col("v0"), F.col("row"), F.col("row") + 1), "vb": _between(F.col("v1"), F.col("row"), F.col("row") + 1)})
    slope = (F.col("u1") - F.col("u0")) / (F.col("v1") - F.col("v0"))
    e = e.select("fid", "sg", "row", "va", "vb", (F.col("u0") + (F.col("va") - F.col("v0")) * slope).alias("ua"), (F.col("u0") + (F.col("vb") - F.col("v0")) * slope).alias("ub"))
    # what lies left of the grid is gathered in column -1, what lies right of it covers nothing
    low = F.floor(F.least("ua", "ub"))
    e = e.withColumns({"ca": _int(F.greatest(low, F.lit(-1))), "cb": _int(F.least(F.greatest(F.ceil(F.greatest("ua", "ub")) - 1, low, F.lit(-1)), F.lit(nc - 1)))})
    e = e.where("ca <= cb").select("*", F.explode(F.sequence("ca", "cb")).alias("col"))
    part = lambda x: F.when(F.col("col") == -1, F.least(F.col(x), F.lit(0.0))).otherwise(_between(F.col(x), F.col("col"), F.col("col") + 1))
    e = e.withColumns({"pa": part("ua"), "pb": part("ub")})
    dv = F.col("sg") * F.when(F.col("ua") == F.col("ub"), F.col("vb") - F.col("va")).otherwise((F.col("pb") - F.col("pa")) * (F.col("vb") - F.col("va")) / F.nullif(F.col("ub") - F.col("ua"), F.lit(0.0)))
    e = e.select("fid", "row", "col", "pa", "pb", dv.alias("dv"))
    own = F.when(F.col("col") >= 0, F.col("dv") * (F.col("col") + 1 - (F.col("pa") + F.col("pb")) / 2)).otherwise(F.lit(0.0))
    sums = e.groupBy("fid", "row", "col").agg(F.sum(own).alias("own"), F.sum("dv").alias("turn"))
    along = Window.partitionBy("fid", "row").orderBy("col")
    return sums.select("fid", "row", "col", "own", "turn", F.sum("turn").over(along).alias("run"), F.coalesce(F.lead("col").over(along), F.lit(nc)).alias("next"))


def polygon_runs(edges: DataFrame, grid: Grid) -> DataFrame:
    """Polygon edges -> ``fid, row, first, last, cov``: a run of one cell for each that an edge meets, and the runs between them; ``cov`` is a double."""
    inner = F.when((F.abs("run") > GHOST) & (F.col("col") + 1 < F.col("next")), F.struct((F.col("col") + 1).alias("first"), (F.col("next") - 1).alias("last"), F.col("run").alias("cov")))
    own = F.struct(F.col("col").alias("first"), F.col("col").alias("last"), (F.col("own") + F.col("run") - F.col("turn")).alias("cov"))
    runs = _sweep(edges, grid).select("fid", "row", F.explode(F.array(own, inner)).alias("r")).where("r is not null").select("fid", "row", "r.first", "r.last", "r.cov")
    cov = F.when(F.abs(F.col("cov") - 1) < GHOST, F.lit(1.0)).otherwise(F.col("cov"))
    return runs.where((F.col("first") >= 0) & (F.abs("cov") > GHOST)).select("fid", "row", "first", "last", cov.alias("cov"))


def cells_of_runs(runs: DataFrame) -> DataFrame:
    """Runs -> ``fid, row, col, cov``, a row for each cell."""
    return runs.select("fid", "row", F.explode(F.sequence("first", "last")).alias("col"), "cov")


def polygon_coverage(edges: DataFrame, grid: Grid) -> DataFrame:
    """Polygon edges -> ``fid, row, col, cov`` for every cell covered in part or whole; ``cov`` is a double."""
    return cells_of_runs(polygon_runs(edges, grid))


def _boxes(boxes: DataFrame, grid: Grid) -> DataFrame:
    """Rectangles (corners as the ends of an edge) in units of cells, cut off at the grid, a row for each row of cells: its overlap ``h``, columns ``c0`` to ``c1``."""
    u = lambda x: F.least(F.greatest((F.col(x) - F.lit(grid.xmin)) / F.lit(grid.dx), F.lit(0.0)), F.lit(float(grid.cols)))
    v = lambda y: F.least(F.greatest((F.lit(grid.ymax) - F.col(y)) / F.lit(grid.dy), F.lit(0.0)), F.lit(float(grid.rows)))
    b = boxes.select("fid", u("x0").alias("u0"), u("x1").alias("u1"), v("y1").alias("v0"), v("y0").alias("v1")).where("u0 < u1 and v0 < v1")
    b = b.select("*", _int(F.floor("u0")).alias("c0"), _int(F.ceil("u1") - 1).alias("c1"), F.explode(F.sequence(_int(F.floor("v0")), _int(F.ceil("v1") - 1))).alias("row"))
    return b.withColumn("h", F.least(F.col("v1"), F.col("row") + 1) - F.greatest("v0", "row"))


def rectangle_runs(boxes: DataFrame, grid: Grid) -> DataFrame:
    """Rectangles along the axes -> ``fid, row, first, last, cov``: the overlap of rows times that of columns, without edges, sums or a shuffle."""
    run = lambda a, b, part: F.struct(a.alias("first"), b.alias("last"), (part * F.col("h")).alias("cov"))
    c0, c1 = F.col("c0"), F.col("c1")
    inner = F.when(c1 > c0 + 1, run(c0 + 1, c1 - 1, F.lit(1.0)))
    several = F.array(run(c0, c0, c0 + 1 - F.col("u0")), inner, run(c1, c1, F.col("u1") - c1))
    runs = _boxes(boxes, grid).select("fid", "row", F.explode(F.when(c0 == c1, F.array(run(c0, c0, F.col("u1") - F.col("u0")))).otherwise(several)).alias("r"))
    cov = F.when(F.abs(F.col("r.cov") - 1) < GHOST, F.lit(1.0)).otherwise(F.col("r.cov"))
    return runs.where(F.col("r.cov") > GHOST).select("fid", "row", "r.first", "r.last", cov.alias("cov"))


def line_coverage(edges: DataFrame, grid: Grid, least: float = GHOST) -> DataFrame:
    """Line edges -> ``fid, row, col, cov`` with the length of the line in each cell, in map units."""
    nr, nc = grid.rows, grid.cols
    e = _in_grid(edges, grid)
    low = F.floor(F.least("v0", "v1"))
    e = e.withColumns({"ra": _int(F.greatest(low, F.lit(0))), "rb": _int(F.least(F.greatest(F.ceil(F.greatest("v0", "v1")) - 1, low), F.lit(nr - 1)))})
    # a line along the bottom edge belongs to the last row
    e = e.withColumn("ra", F.when((F.col("ra") == nr) & (F.least("v0", "v1") == nr), F.lit(nr - 1)).otherwise(F.col("ra")))
    e = e.where("ra <= rb").select("*", F.explode(F.sequence("ra", "rb")).alias("row"))
    va, vb = (_between(F.col(v), F.col("row"), F.col("row") + 1) for v in ("v0", "v1"))
    slope = (F.col("u1") - F.col("u0")) / F.nullif(F.col("v1") - F.col("v0"), F.lit(0.0))
    flat = F.col("v0") == F.col("v1")
    e = e.select("fid", "row", va.alias("va"), vb.alias("vb"), F.when(flat, F.col("u0")).otherwise(F.col("u0") + (va - F.col("v0")) * slope).alias("ua"), F.when(flat, F.col("u1")).otherwise(F.col("u0") + (vb - F.col("v0")) * slope).alias("ub"))
    low = F.floor(F.least("ua", "ub"))
    e = e.withColumns({"ca": _int(F.greatest(low, F.lit(0))), "cb": _int(F.least(F.greatest(F.ceil(F.greatest("ua", "ub")) - 1, low), F.lit(nc - 1)))})
    e = e.withColumn("ca", F.when((F.col("ca") == nc) & (F.least("ua", "ub") == nc), F.lit(nc - 1)).otherwise(F.col("ca")))
    e = e.where("ca <= cb").select("*", F.explode(F.sequence("ca", "cb")).alias("col"))
    du = _between(F.col("ub"), F.col("col"), F.col("col") + 1) - _between(F.col("ua"), F.col("col"), F.col("col") + 1)
    upright = F.col("ua") == F.col("ub")
    dv = F.when(upright, F.col("vb") - F.col("va")).otherwise(du * (F.col("vb") - F.col("va")) / F.nullif(F.col("ub") - F.col("ua"), F.lit(0.0)))
    x, y = F.when(upright, F.lit(0.0)).otherwise(du) * F.lit(grid.dx), dv * F.lit(grid.dy)
    e = e.select("fid", "row", "col", F.sqrt(x * x + y * y).alias("len"))
    return e.groupBy("fid", "row", "col").agg(F.sum("len").alias("cov")).where(F.col("cov") > least)


def coverage_runs(edges: DataFrame, grid: Grid, kinds: str = "PL", present: set[str] | None = None) -> DataFrame:
    """Coverage of polygon and line features as runs ``fid, row, first, last, cov``; ``cov`` in single precision, as a float column.

    ``present`` are the kinds of edges that there are, where that is known; the
    plan has no branch for others.
    """
    of = {"P": polygon_runs, "R": rectangle_runs, "L": lambda e, g: line_coverage(e, g).select("fid", "row", F.col("col").alias("first"), F.col("col").alias("last"), "cov")}
    wanted = [k for k in "PRL" if k.replace("R", "P") in kinds]
    parts = [of[k](edges.where(F.col("kind") == k), grid) for k in wanted if present is None or k in present] or [polygon_runs(edges.where("kind = 'P'"), grid)]
    return reduce(DataFrame.unionByName, parts).select("fid", "row", "first", "last", F.col("cov").cast("float").alias("cov"))


def coverage(edges: DataFrame, grid: Grid, kinds: str = "PL", present: set[str] | None = None) -> DataFrame:
    """Coverage of polygon and line features by cells; ``cov`` in single precision, as a float column."""
    return cells_of_runs(coverage_runs(edges, grid, kinds, present))


def touched(edges: DataFrame, grid: Grid, kinds: str = "PL") -> DataFrame:
    """``fid, row, first, last``: the cells of a grid that features meet: those of their edges, however little they cover, and the runs inside polygons."""
    parts = []
    if "P" in kinds:
        inner = F.when(F.abs("run") > GHOST, F.col("next") - 1).otherwise(F.col("col"))
        swept = _sweep(edges.where("kind = 'P'"), grid).select("fid", "row", F.greatest(F.col("col"), F.lit(0)).alias("first"), inner.alias("last"))
        parts.append(swept.where("last >= first"))
        parts.append(_boxes(edges.where("kind = 'R'"), grid).select("fid", "row", F.col("c0").alias("first"), F.col("c1").alias("last")))
    if "L" in kinds:
        parts.append(line_coverage(edges.where("kind = 'L'"), grid, 0.0).select("fid", "row", F.col("col").alias("first"), F.col("col").alias("last")))
    return reduce(DataFrame.unionByName, parts)
