"""Rasters as blocks: one row for each square tile, its cells as bytes.

``tile_row, tile_col, data``: little-endian doubles, row by row, NaN where a
cell is missing; blocks at the right and lower edge are cut off there. A task
that reads a block can work on all of its cells at once
(``operators/block_states.py``). Every other operation gets the cells as rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.functions.grid import Grid
from gridloom.sources.raster import CELL_TYPES, Raster

#: Cell types that a double holds exactly.
BLOCK_TYPES = ("int8", "uint8", "int16", "uint16", "int32", "uint32", "float32", "float64")
SIDE = 256

_CELLS = pa.schema([("row", pa.int32()), ("col", pa.int32()), ("value", pa.float64()), ("tile_row", pa.int32()), ("tile_col", pa.int32())])


@dataclass(frozen=True)
class BlockRaster(Raster):
    """A raster whose table holds a row for each tile; ``cells`` are made of it where they are asked for."""

    blocks: DataFrame | None = None

    def near(self, edges: DataFrame, kinds: str = "PL") -> BlockRaster:
        """The same raster with only the blocks that features meet."""
        tiles = Raster(self.name, self.grid, self.dtype, self.blocks.withColumns({c: F.lit(0) for c in ("row", "col", "value")}), self.srs, self.tiles)
        return of_blocks(tiles.read_near(edges, kinds).cells.select(*self.blocks.columns), self.grid, self.tiles, self.name, self.dtype, self.srs)

    read_near = near


def shape_of(grid: Grid, side: int, tile_row: int, tile_col: int) -> tuple[int, int]:
    """Rows and columns of a block."""
    return min(side, grid.rows - tile_row * side), min(side, grid.cols - tile_col * side)


def block_array(data: bytes | memoryview | pa.Buffer, shape: tuple[int, int]) -> np.ndarray:
    """A block's cells."""
    cells = np.frombuffer(data, "<f8")
    if cells.size != shape[0] * shape[1]:
        raise ValueError(f"A block of {shape[0]} x {shape[1]} cells holds {cells.size}")
    return cells.reshape(shape)


def of_blocks(blocks: DataFrame, grid: Grid, side: int = SIDE, name: str = "", dtype: str = "float64", srs: str | None = None) -> BlockRaster:
    """A raster from a table ``tile_row, tile_col, data``; a tile without a row has no cells."""
    if dtype not in BLOCK_TYPES:
        raise ValueError(f"Blocks can't hold cells of type {dtype}")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for r, c, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                cells = block_array(data.as_buffer(), shape_of(grid, side, r, c))
                row, col = np.nonzero(~np.isnan(cells))
                at = [row + r * side, col + c * side, cells[row, col], np.full(len(row), r), np.full(len(row), c)]
                yield pa.RecordBatch.from_arrays([pa.array(x.astype(t.to_pandas_dtype())) for x, t in zip(at, _CELLS.types)], schema=_CELLS)

    blocks = blocks.select(F.col("tile_row").cast("int"), F.col("tile_col").cast("int"), "data")
    cells = blocks.mapInArrow(run, "row int, col int, value double, tile_row int, tile_col int").withColumn("value", F.col("value").cast(CELL_TYPES[dtype][0]))
    return BlockRaster(name, grid, dtype, cells, srs, side, blocks=blocks)


def to_blocks(raster: Raster, side: int = SIDE) -> BlockRaster:
    """A raster of cells as blocks; at most ``side`` x ``side`` cells meet in one row. Write ``blocks`` to keep them."""
    if raster.dtype not in BLOCK_TYPES:
        raise ValueError(f"Blocks can't hold cells of type {raster.dtype}")
    grid = raster.grid
    tile = lambda c: F.floor(F.col(c) / side).cast("int")
    inside = F.col("row").between(0, grid.rows - 1) & F.col("col").between(0, grid.cols - 1) & F.col("value").isNotNull()
    place = F.struct((F.col("row") % side).alias("r"), (F.col("col") % side).alias("c"), F.col("value").cast("double").alias("x"))
    grouped = raster.cells.where(inside).groupBy(tile("row").alias("tile_row"), tile("col").alias("tile_col")).agg(F.collect_list(place).alias("cells"))
    schema = pa.schema([("tile_row", pa.int32()), ("tile_col", pa.int32()), ("data", pa.binary())])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for i in range(batch.num_rows):
                r, c, cells = batch.column(0)[i].as_py(), batch.column(1)[i].as_py(), batch.column(2)[i].values
                out = np.full(shape_of(grid, side, r, c), np.nan)
                out[cells.field(0).to_numpy(), cells.field(1).to_numpy()] = cells.field(2).to_numpy()
                yield pa.RecordBatch.from_pydict({"tile_row": [r], "tile_col": [c], "data": [out.astype("<f8").tobytes()]}, schema=schema)

    return replace(of_blocks(grouped.mapInArrow(run, "tile_row int, tile_col int, data binary"), grid, side, raster.name, raster.dtype, raster.srs))
