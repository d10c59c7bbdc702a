"""Rasters as DataFrames of cells: ``row, col, value``; every kind of missing value is null."""

from __future__ import annotations

import os
from collections.abc import Iterable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions.descriptors import INTEGER_RANGE, band_names, unique_raster_names
from gridloom.functions.grid import Box, Grid
from gridloom.operators.coverage import touched

#: Spark type of the cells, and of scalar results, for each cell type.
CELL_TYPES = {"int8": ("int", "int"), "uint8": ("int", "int"), "int16": ("int", "int"), "uint16": ("int", "int"), "int32": ("int", "int"), "uint32": ("bigint", "bigint"), "int64": ("bigint", "bigint"), "uint64": ("decimal(20,0)", "bigint"), "float32": ("float", "double"), "float64": ("double", "double")}
_OF_SPARK = {"tinyint": "int8", "smallint": "int16", "int": "int32", "bigint": "int64", "float": "float32", "double": "float64"}


@dataclass(frozen=True)
class Raster:
    """One band: a name, a grid, a cell type and its cells (no row for a missing cell is needed).

    With ``tiles`` the cells have columns ``tile_row`` and ``tile_col``, the
    numbers of square tiles of so many cells a side.
    """

    name: str
    grid: Grid
    dtype: str
    cells: DataFrame
    srs: str | None = None
    tiles: int | None = None
    #: Cells, where a source knows their count and Spark can't.
    n_cells: int | None = None

    def __post_init__(self):
        if self.dtype not in CELL_TYPES:
            raise ValueError(f"Unknown cell type: {self.dtype}")

    @property
    def result_type(self) -> str:
        return CELL_TYPES[self.dtype][1]

    def named(self, name: str) -> Raster:
        return replace(self, name=name)

    def window(self, box: Box) -> Raster:
        """The same raster with only the cells that a box touches; the filter reaches the scan."""
        g = self.grid.crop(box)
        r, c = g.offset(self.grid)
        return replace(self, cells=self.cells.where(F.col("row").between(r, r + g.rows - 1) & F.col("col").between(c, c + g.cols - 1)))

    def tile_cover(self, edges: DataFrame, kinds: str = "PL") -> DataFrame:
        """``fid, tile_row, tile_col``: the tiles that a feature's edges run through, and those inside it.

        The tiles are the cells of a coarser grid, so the sweep that finds
        covered cells finds them too, from the outline alone: parts of a
        feature that are far apart, or a hollow one's inside, call for no tile
        between them.
        """
        g, t = self.grid, self.tiles
        down, across = -(-g.rows // t), -(-g.cols // t)
        of_tiles = Grid(g.xmin, g.ymax - down * t * g.dy, g.xmin + across * t * g.dx, g.ymax, t * g.dx, t * g.dy)
        spans = touched(edges, of_tiles, kinds)
        return spans.select("fid", F.col("row").alias("tile_row"), F.explode(F.sequence("first", "last")).alias("tile_col")).distinct()

    def read_near(self, edges: DataFrame, kinds: str = "PL") -> Raster:
        """The same raster with only the tiles that features meet; as it is without tiles.

        The wanted tiles are found by a job over the edges (:meth:`tile_cover`).
        Up to :data:`MOST_TILES` they become a filter on the tile columns, which
        prunes a scan's partitions; more are joined.
        """
        if self.tiles is None:
            return self
        g, t = self.grid, self.tiles
        wanted = self.tile_cover(edges, kinds).select(F.col("tile_row").alias("r"), F.col("tile_col").alias("c")).distinct()
        found = wanted.limit(MOST_TILES + 1).collect()
        if len(found) > MOST_TILES:
            cells = self.cells.join(wanted, (F.col("tile_row") == F.col("r")) & (F.col("tile_col") == F.col("c")), "left_semi")
        else:
            each = lambda k: sorted({x[k] for x in found})
            wide = g.cols // t + 1
            pair = (F.col("tile_row").cast("long") * wide + F.col("tile_col")).isin([x.r * wide + x.c for x in found])
            cells = self.cells.where(F.col("tile_row").isin(each("r")) & F.col("tile_col").isin(each("c")) & pair)
        return replace(self, cells=cells)


#: Tiles that are a filter of the scan at most.
MOST_TILES = 10_000


def clean(value: Column, dtype: str, nodata=None, scale: float | None = None, offset: float | None = None, mask: Column | None = None) -> tuple[Column, str]:
    """Cell value with missing ones null, and its cell type after scaling.

    NODATA is compared before scaling. A NODATA value that the cell type can't
    hold is ignored. A false mask and NaN are missing too.
    """
    out = value
    if dtype in ("float32", "float64"):
        out = F.when(~F.isnan(out), out)
    if nodata is not None and nodata == nodata:
        low, high = INTEGER_RANGE.get(dtype, (None, None))
        if low is None or (float(nodata).is_integer() and low <= nodata <= high):
            out = F.when(out != F.lit(int(nodata) if low is not None else float(nodata)), out)
    if scale is not None or offset is not None:
        out, dtype = out.cast("double") * F.lit(1.0 if scale is None else float(scale)) + F.lit(0.0 if offset is None else float(offset)), "float64"
    if mask is not None:
        out = F.when(mask, out)
    return out.cast(CELL_TYPES[dtype][0]), dtype


def from_table(cells: DataFrame, grid: Grid, name: str = "", dtype: str | None = None, row: str = "row", col: str = "col", value: str = "value", mask: str | None = None, nodata=None, scale=None, offset=None, srs: str | None = None, tiles: int | None = None, keep: tuple[str, ...] = ()) -> Raster:
    """A raster from a table with a row for each cell (one row at most for a place).

    ``tiles`` says that the table has columns ``tile_row`` and ``tile_col``
    (best as partitions) with the numbers of square tiles of that side.
    ``keep`` names other columns that the cells keep.
    """
    dtype = dtype or _OF_SPARK[cells.schema[value].dataType.simpleString()]
    v, dtype = clean(F.col(value), dtype, nodata, scale, offset, F.col(mask) if mask else None)
    kept = [*keep, *(["tile_row", "tile_col"] if tiles else [])]
    return Raster(name, grid, dtype, cells.select(F.col(row).cast("int").alias("row"), F.col(col).cast("int").alias("col"), v.alias("value"), *kept), srs, tiles)


def from_parquet(spark: SparkSession, path: str, grid: Grid, **options) -> Raster:
    """A raster from Parquet cells; named after the file unless ``name`` is given."""
    options.setdefault("name", os.path.splitext(path.rstrip("/").rsplit("/", 1)[-1])[0])
    return from_table(spark.read.parquet(path), grid, **options)


def from_files(spark: SparkSession, paths: list[str], grids: Grid | list[Grid], **options) -> list[Raster]:
    """One raster for each file of Parquet cells, named after the file; one grid for all, or one for each."""
    each = grids if isinstance(grids, list) else [grids] * len(paths)
    return [from_parquet(spark, p, g, **options) for p, g in zip(paths, each, strict=True)]


def from_array(spark: SparkSession, array, extent: Box | None = None, name: str = "", nodata=None, mask=None, scale=None, offset=None, srs: str | None = None) -> Raster:
    """A raster from a two-dimensional array (masked arrays too); the extent is (0, 0, columns, rows) by default."""
    import numpy as np
    import pandas as pd

    if isinstance(array, np.ma.MaskedArray):
        mask = ~np.ma.getmaskarray(array) if mask is None else np.asarray(mask, bool) & ~np.ma.getmaskarray(array)
        array = array.data
    array = np.asarray(array)
    if array.ndim != 2:
        raise ValueError("A raster has two dimensions.")
    dtype = str(array.dtype)
    if dtype not in CELL_TYPES:
        array, dtype = array.astype(float), "float64"
    rows, cols = array.shape
    grid = Grid.of_shape(extent or Box(0, 0, cols, rows), rows, cols)
    r, c = np.divmod(np.arange(array.size), cols)
    flat = array.ravel()
    frame = pd.DataFrame({"row": r.astype("int32"), "col": c.astype("int32"), "value": flat.tolist() if dtype == "uint64" else flat, "ok": np.ones(array.size, bool) if mask is None else np.asarray(mask, bool).ravel()})
    if dtype == "uint64":
        from decimal import Decimal

        frame["value"] = [Decimal(int(x)) for x in flat]
    elif dtype != "float32" and dtype != "float64":
        frame["value"] = frame["value"].astype("int64" if CELL_TYPES[dtype][0] == "bigint" else "int32")
    kind = CELL_TYPES[dtype][0]
    cells = spark.createDataFrame(frame, f"row int, col int, value {kind}, ok boolean")
    return from_table(cells, grid, name, dtype, mask="ok", nodata=nodata, scale=scale, offset=offset, srs=srs)


def from_bands(bands: DataFrame, grid: Grid, root: str = "", band: str = "band", only: int | None = None, n_bands: int | None = None, **options) -> list[Raster]:
    """One raster for each band of a table with a ``band`` column (1-based)."""
    if only is not None and only <= 0:
        raise ValueError("Raster bands start at 1.")
    if only:
        return [from_table(bands.where(F.col(band) == only), grid, root, **options)]
    n = n_bands or bands.agg(F.max(band)).first()[0] or 0
    return [from_table(bands.where(F.col(band) == i), grid, name, **options) for i, name in enumerate(band_names(root, n), 1)]


def from_variables(table: DataFrame, grid: Grid, variables: Iterable[str], root: str = "", **options) -> list[Raster]:
    """One raster for each value column of a table of cells."""
    out = []
    for v in variables:
        out.append(from_table(table, grid, f"{root}_{v}" if root else v, value=v, **options))
    return out


def prepare(rasters) -> list[Raster]:
    """A raster, a list or a dict of rasters as a list with distinct names."""
    if rasters is None:
        return []
    if isinstance(rasters, Raster):
        rasters = [rasters]
    if isinstance(rasters, dict):
        rasters = [r.named(n) for n, r in rasters.items()]
    out: list[Raster] = []
    for r in rasters:
        out += r if isinstance(r, list) else [r]
    if len(out) > 1:
        out = [r if r.name else r.named(f"band_{i}") for i, r in enumerate(out, 1)]
    unique_raster_names([r.name for r in out])
    return out


def cell_area(grid: Grid, row: Column, how: str) -> Column:
    """Area of a cell in a row, single precision: ``cartesian``, ``spherical_m2`` or ``spherical_km2``."""
    from gridloom.functions.grid import EARTH_RADIUS

    if how == "cartesian":
        return F.lit(grid.dx * grid.dy).cast("float")
    top = F.radians(F.lit(grid.ymax) - row * F.lit(grid.dy))
    low = F.radians(F.lit(grid.ymax) - (row + 1) * F.lit(grid.dy))
    factor = {"spherical_m2": 1.0, "spherical_km2": 1e-6}[how]
    import math

    return (F.lit(EARTH_RADIUS**2 * math.pi / 180 * grid.dx * factor) * F.abs(F.sin(low) - F.sin(top))).cast("float")
