"""Data sources for Spark's own reader and writer: rasters read by windows, features written with commit and abort.

``spark.read.format("gridloom_raster")`` gives the cells of a user-defined
source (``sources/windows.py``). Each partition is a range of windows; filters on
the window numbers ``tile_row``, ``tile_col`` and ``tile`` are taken over, so that
windows that fail them are never read. Spark keeps what a loaded table took over:
load anew for each filter, or load with option ``push`` false, which takes none
over. ``df.write.format("gridloom_features")``
writes GeoJSON features, one a line: tasks write aside, the commit puts all
files in place, and a job that fails leaves nothing.
"""

from __future__ import annotations

import base64
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import cloudpickle
from pyspark.sql import Row, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage
from pyspark.sql.types import StructType

from gridloom.sources.raster import CELL_TYPES

RASTER, FEATURES = "gridloom_raster", "gridloom_features"
#: Partitions of a raster at most, and windows of one unless there are more than that allows.
MOST_PARTITIONS, WINDOWS = 10_000, 8
ARROW_TYPES = {"int": pa.int32(), "bigint": pa.int64(), "float": pa.float32(), "double": pa.float64(), "decimal(20,0)": pa.decimal128(20, 0)}


def register(spark: SparkSession) -> None:
    """Make both formats known to a session, and let it hand filters over."""
    spark.dataSource.register(RasterSource)
    spark.dataSource.register(FeatureSink)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def packed(source) -> str:
    """A source as the text of an option."""
    return base64.b64encode(cloudpickle.dumps(source)).decode()


@dataclass
class WindowRange(InputPartition):
    """Windows by number, row by row of windows."""

    first: int
    last: int

    def __post_init__(self):
        super().__init__((self.first, self.last))


def window_cells(source, window: int, tile_row: int, tile_col: int) -> list[pa.Array]:
    """Rows, columns and values of a window's cells."""
    grid, kind = source.grid, CELL_TYPES[source.dtype][0]
    top, left = tile_row * window, tile_col * window
    h, w = min(window, grid.rows - top), min(window, grid.cols - left)
    got = np.ma.asarray(source.read_window(top, left, h, w))
    if got.shape != (h, w):
        raise ValueError(f"A window of {h} x {w} cells has the shape {got.shape}")
    missing = np.ma.getmaskarray(got).ravel()
    rows, cols = np.divmod(np.arange(h * w), w)
    value = pa.array(got.data.ravel() if kind != "decimal(20,0)" else [int(x) for x in got.data.ravel()], mask=missing).cast(ARROW_TYPES[kind])
    return [pa.array((rows + top).astype(np.int32)), pa.array((cols + left).astype(np.int32)), value]


class RasterSource(DataSource):
    """Options: ``source``, a user-defined source as :func:`packed` gives it, ``window``, the cells of a window's side, and ``push``, whether filters are taken over (true)."""

    def __init__(self, options: dict[str, str]):
        super().__init__(options)
        self.source = cloudpickle.loads(base64.b64decode(options["source"]))
        self.window = int(options.get("window", 512))

    @classmethod
    def name(cls) -> str:
        return RASTER

    def schema(self) -> str:
        return f"row int, col int, value {CELL_TYPES[self.source.dtype][0]}, tile_row int, tile_col int, tile bigint"

    def reader(self, schema: StructType) -> DataSourceReader:
        of = WindowReader if self.options.get("push", "true").lower() == "false" else FilteredReader
        return of(self.source, self.window)


class WindowReader(DataSourceReader):
    def __init__(self, source, window: int):
        self.source, self.window = source, window
        self.down, self.across = -(-source.grid.rows // window), -(-source.grid.cols // window)
        #: What pushed filters leave of each number: a range, and where it is set the only values.
        self.range = {"tile_row": [0, self.down - 1], "tile_col": [0, self.across - 1], "tile": [0, self.down * self.across - 1]}
        self.only: dict[str, frozenset[int]] = {}

    def wanted(self, tile: int) -> bool:
        for name, x in zip(("tile_row", "tile_col", "tile"), (*divmod(tile, self.across), tile)):
            low, high = self.range[name]
            if not low <= x <= high or x not in self.only.get(name, (x,)):
                return False
        return True

    def partitions(self) -> list[InputPartition]:
        """Ranges that hold a wanted window; where few windows are asked for by number, these alone."""
        if "tile" in self.only and len(self.only["tile"]) <= MOST_PARTITIONS:
            return [WindowRange(t, t + 1) for t in sorted(self.only["tile"]) if self.wanted(t)] or [WindowRange(0, 0)]
        rows, cols = self.range["tile_row"], self.range["tile_col"]
        first, last = rows[0] * self.across + cols[0], rows[1] * self.across + cols[1] + 1
        step = max(WINDOWS, -(-(last - first) // MOST_PARTITIONS))
        return [WindowRange(a, min(a + step, last)) for a in range(first, last, step)] or [WindowRange(0, 0)]

    def read(self, partition: WindowRange) -> Iterator[pa.RecordBatch]:
        names = ["row", "col", "value", "tile_row", "tile_col", "tile"]
        for tile in range(partition.first, partition.last):
            if self.wanted(tile):
                r, c = divmod(tile, self.across)
                cells = window_cells(self.source, self.window, r, c)
                n = len(cells[0])
                yield pa.RecordBatch.from_arrays([*cells, pa.array(np.full(n, r, np.int32)), pa.array(np.full(n, c, np.int32)), pa.array(np.full(n, tile, np.int64))], names=names)


class FilteredReader(WindowReader):
    """Reads only windows that the filters it has taken over leave."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Take over comparisons of a window number with constants; give back the others."""
        for f in filters:
            name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if name not in self.range:
                yield f
            elif isinstance(f, (EqualTo, In)):
                values = frozenset([f.value] if isinstance(f, EqualTo) else f.value)
                self.only[name] = self.only.get(name, values) & values
            elif isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                self.range[name][0] = max(self.range[name][0], f.value + isinstance(f, GreaterThan))
            elif isinstance(f, (LessThan, LessThanOrEqual)):
                self.range[name][1] = min(self.range[name][1], f.value - isinstance(f, LessThan))
            else:
                yield f


class FeatureSink(DataSource):
    """Options: ``path``, a folder that all executors share, ``geometry``, the column of GeoJSON geometries, and ``id``, that of the features' ids, if any."""

    @classmethod
    def name(cls) -> str:
        return FEATURES

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return FeatureWriter(self.options["path"], self.options.get("geometry"), self.options.get("id"), overwrite)


@dataclass
class Written(WriterCommitMessage):
    file: str | None


class FeatureWriter(DataSourceWriter):
    def __init__(self, path: str, geometry: str | None, key: str | None, overwrite: bool):
        self.path, self.geometry, self.key, self.overwrite = path, geometry, key, overwrite
        self.aside = f"{path.rstrip('/')}/.aside-{uuid.uuid4().hex}"

    def _place(self, uri: str) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri.removeprefix("file:"))

    def write(self, rows: Iterator[Row]) -> Written:
        system, folder = self._place(self.aside)
        system.create_dir(folder, recursive=True)
        file = f"{uuid.uuid4().hex}.geojsonl"
        n = 0
        with system.open_output_stream(f"{folder}/{file}") as out:
            for row in rows:
                values = row.asDict(True)
                shape = values.pop(self.geometry, None) if self.geometry else None
                feature = {"type": "Feature"} | ({"id": values.pop(self.key)} if self.key else {})
                feature |= {"geometry": json.loads(shape) if shape else None, "properties": values}
                out.write(json.dumps(feature, default=str).encode() + b"\n")
                n += 1
        return Written(file if n else None)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        system, aside = self._place(self.aside)
        _, folder = self._place(self.path)
        if self.overwrite:
            for f in system.get_file_info(fs.FileSelector(folder, allow_not_found=True)):
                if f.type == fs.FileType.File:
                    system.delete_file(f.path)
        for k, m in enumerate(m for m in messages if m is not None and m.file):
            system.move(f"{aside}/{m.file}", f"{folder}/part-{k:05d}-{m.file}")
        self._clear(system, aside)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        self._clear(*self._place(self.aside))

    def _clear(self, system: fs.FileSystem, aside: str) -> None:
        if system.get_file_info(aside).type == fs.FileType.Directory:
            system.delete_dir(aside)
