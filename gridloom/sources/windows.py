"""Rasters read window by window from user-defined sources, and adapters for installed raster libraries.

A source is any object that can be sent to the executors and has ``grid`` (a
:class:`~gridloom.functions.grid.Grid`), ``dtype`` (a cell type) and
``read_window(row, col, rows, cols)``, which returns an array of that window,
masked where cells are missing. ``name``, ``nodata``, ``scale``, ``offset``
and ``srs`` are optional. Windows are dealt to tasks; each task reads its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions.grid import Grid
from gridloom.sources import raster
from gridloom.sources.datasource import ARROW_TYPES, RASTER, packed, register, window_cells
from gridloom.sources.raster import CELL_TYPES, Raster, from_table


class WindowSource(Protocol):
    """What a user-defined raster source offers."""

    grid: Grid
    dtype: str

    def read_window(self, row: int, col: int, rows: int, cols: int) -> np.ndarray: ...


def from_source(spark: SparkSession, source: WindowSource, window: int = 512) -> Raster:
    """A raster whose cells are read by the tasks, a window of at most ``window`` cells a side at a time.

    A window is a tile: with features, only windows near them are read. The
    cells come through Spark's reader (``sources/datasource.py``), which gets the
    wanted windows as filters; more than :data:`raster.MOST_TILES` of them are
    rows themselves, and read where these are.
    """
    grid, kind = source.grid, CELL_TYPES[source.dtype][0]
    down, across = -(-grid.rows // window), -(-grid.cols // window)
    register(spark)

    def load(push: bool) -> DataFrame:
        return spark.read.format(RASTER).option("source", packed(source)).option("window", window).option("push", push).load()

    options = {k: getattr(source, k, None) for k in ("nodata", "scale", "offset", "srs")}
    name = getattr(source, "name", "") or ""
    schema = pa.schema([("row", pa.int32()), ("col", pa.int32()), ("value", ARROW_TYPES[kind]), ("tile_row", pa.int32()), ("tile_col", pa.int32())])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for r, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                at = window_cells(source, window, r, c)
                yield pa.RecordBatch.from_arrays([*at, *(pa.array(np.full(len(at[0]), x, np.int32)) for x in (r, c))], schema=schema)

    def of(table: DataFrame) -> Windows:
        made = from_table(table, grid, name, source.dtype, tiles=window, **options)
        return Windows(made.name, made.grid, made.dtype, made.cells, made.srs, made.tiles, grid.size)

    class Windows(Raster):
        """The wanted windows are chosen before any is read."""

        def read_near(self, edges: DataFrame, kinds: str = "PL") -> Raster:
            wanted = self.tile_cover(edges, kinds).select("tile_row", "tile_col").distinct()
            found = wanted.limit(raster.MOST_TILES + 1).collect()
            if len(found) <= raster.MOST_TILES:
                return of(load(True).where(F.col("tile").isin([t.tile_row * across + t.tile_col for t in found]))).named(self.name)
            spread = spark.range(down * across).select(F.floor(F.col("id") / across).cast("int").alias("tile_row"), (F.col("id") % across).cast("int").alias("tile_col"))
            near = spread.join(wanted, ["tile_row", "tile_col"], "left_semi")
            return of(near.mapInArrow(run, f"row int, col int, value {kind}, tile_row int, tile_col int")).named(self.name)

    return of(load(False))


def _type(dtype) -> str:
    """The cell type of an array's type."""
    name = str(np.dtype(dtype))
    return name if name in CELL_TYPES else "float64"


class ArraySource:
    """A two-dimensional array (masked arrays too) that goes to the tasks."""

    def __init__(self, array: np.ndarray, grid: Grid, name: str = "", nodata=None):
        self.array, self.grid, self.name, self.nodata, self.dtype = array, grid, name, nodata, _type(array.dtype)

    def read_window(self, row: int, col: int, rows: int, cols: int) -> np.ndarray:
        return self.array[row : row + rows, col : col + cols]


class RasterioSource:
    """A band of a file that the rasterio library opens, where that is installed."""

    def __init__(self, path: str, band: int = 1, name: str = ""):
        import rasterio

        if band <= 0:
            raise ValueError("Raster bands start at 1.")
        self.path, self.band, self.name = path, band, name
        with rasterio.open(path) as f:
            t = f.transform
            self.grid = Grid.from_geotransform((t.c, t.a, t.b, t.f, t.d, t.e), f.height, f.width)
            self.dtype, self.nodata = _type(f.dtypes[band - 1]), f.nodatavals[band - 1]
            scale, offset = f.scales[band - 1], f.offsets[band - 1]
            self.scale, self.offset = (scale, offset) if (scale, offset) != (1.0, 0.0) else (None, None)
            self.srs = f.crs.to_wkt() if f.crs else None

    def read_window(self, row: int, col: int, rows: int, cols: int) -> np.ndarray:
        import rasterio

        with rasterio.open(self.path) as f:
            return f.read(self.band, window=((row, row + rows), (col, col + cols)), masked=True)


class GdalSource:
    """A band of a file that the GDAL library opens, where that is installed."""

    def __init__(self, path: str, band: int = 1, name: str = ""):
        from osgeo import gdal, gdal_array

        if band <= 0:
            raise ValueError("Raster bands start at 1.")
        self.path, self.band, self.name = path, band, name
        file = gdal.Open(path)
        own = file.GetRasterBand(band)
        self.grid = Grid.from_geotransform(file.GetGeoTransform(), file.RasterYSize, file.RasterXSize)
        self.dtype = _type(gdal_array.GDALTypeCodeToNumericTypeCode(own.DataType))
        self.nodata, self.scale, self.offset, self.srs = own.GetNoDataValue(), own.GetScale(), own.GetOffset(), file.GetProjection() or None

    def read_window(self, row: int, col: int, rows: int, cols: int) -> np.ndarray:
        from osgeo import gdal

        return gdal.Open(self.path).GetRasterBand(self.band).ReadAsArray(col, row, cols, rows)


def from_xarray(spark: SparkSession, data, name: str | None = None, window: int = 512) -> list[Raster]:
    """Rasters of an array with dimensions ``y`` and ``x`` and one more at most, or of each variable of a dataset.

    Rows run downwards whatever the order of ``y``.
    """
    if hasattr(data, "data_vars"):
        return [r for n in data.data_vars for r in from_xarray(spark, data[n], str(n), window)]
    dims = list(data.dims)
    x, y = (next(d for d in dims if d in names) for names in (("x", "lon", "longitude"), ("y", "lat", "latitude")))
    rest = [d for d in dims if d not in (x, y)]
    if len(rest) > 1:
        raise ValueError("Arrays with more than one dimension besides x and y are not supported.")
    values = data.transpose(*rest, y, x).values
    xs, ys = np.asarray(data[x].values, float), np.asarray(data[y].values, float)
    if ys[0] < ys[-1]:
        values, ys = values[..., ::-1, :], ys[::-1]
    dx, dy = (xs[-1] - xs[0]) / (len(xs) - 1), (ys[0] - ys[-1]) / (len(ys) - 1)
    grid = Grid(*map(float, (xs[0] - dx / 2, ys[-1] - dy / 2, xs[-1] + dx / 2, ys[0] + dy / 2, dx, dy)))
    bands = values if rest else values[None]
    from gridloom.functions.descriptors import band_names

    root = name if name is not None else (str(data.name) if data.name else "")
    return [from_source(spark, ArraySource(b, grid, n), window) for b, n in zip(bands, band_names(root, len(bands)), strict=True)]
