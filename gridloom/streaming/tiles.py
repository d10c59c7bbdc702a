"""Rasters that arrive as a stream of tiles, against features at rest.

Each tile that arrives meets the coverage of the features in it and gives a
state for each of them (``operators/block_states.py``). A tile that comes again
replaces what it gave, so states must come apart again; extremes and squares
can't be subtracted. Each feature keeps its states in a tree instead: a node
holds 64 tiles, its parent 64 such nodes, and so on. A tile that changes is put
in its place and only the nodes above it are merged anew, so its cost grows with
the height of the tree and nothing is lost by cancelling. A feature of few tiles
(:data:`FEW`) keeps them in one value instead, as reads and writes of state cost
more than their merging. The tree is keyed state of Spark (a map state in RocksDB),
which its checkpoints keep.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from gridloom.functions.grid import Grid
from gridloom.operators import block_states as bs
from gridloom.operators import statistics as st
from gridloom.operators.coverage import coverage_runs
from gridloom.plans import zonal
from gridloom.shared import cut, drop_cut
from gridloom.sources.blocks import BLOCK_TYPES, SIDE, block_array, shape_of
from gridloom.sources.geometry import edges
from gridloom.sources.raster import Raster

#: Tiles, or nodes, to a side of one node; tiles of a feature that are kept without a tree.
FAN, FEW = 8, 128
#: The store of states that keyed maps need.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

_NODE = np.dtype([("version", "<i8"), ("n", "<f8"), ("mean", "<f8"), ("m2", "<f8"), ("lo", "<f8"), ("hi", "<f8")])
_TILE = np.dtype([("share", "<i4"), ("r", "<i4"), ("c", "<i4"), *_NODE.descr])
#: Where the tiles of a feature without a tree are kept; an empty value stands for a tree.
_ALL = (-1, 0, 0, 0)
_NOTHING = (np.iinfo(np.int64).min, 0.0, 0.0, 0.0, np.inf, -np.inf)
_MET = pa.schema([("fid", pa.int64()), ("share", pa.int32()), ("tile_row", pa.int32()), ("tile_col", pa.int32()), ("version", pa.int64()), *((n, pa.float64()) for n in ("n", "mean", "m2", "lo", "hi"))])
_MET_DDL = "fid long, share int, tile_row int, tile_col int, version long, n double, mean double, m2 double, lo double, hi double"
_RESULT = "fid long, n double, s double, lo double, hi double, mu double, var double"


def merged(node: np.ndarray) -> tuple[float, float, float, float, float]:
    """Weight, mean, squares about it and extremes of a node's states as one."""
    n = node["n"]
    total = n.sum()
    mean = (n * node["mean"]).sum() / total if total else 0.0
    m2 = (node["m2"] + np.where(n != 0, n * (node["mean"] - mean) ** 2, 0.0)).sum()
    return float(total), float(mean), float(m2), float(node["lo"].min()), float(node["hi"].max())


def _of_tile(values: np.ndarray, runs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Every feature of a tile's runs, which are sorted by feature, and its state; without valid cells an empty one."""
    fids = np.unique(runs[0])
    out = np.full(len(fids), np.array(_NOTHING, _NODE))
    ends = np.cumsum(runs[3] - runs[2] + 1)
    parts: list[list[np.ndarray]] = []
    a = 0
    while a < len(ends):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + bs.MOST_UNFOLDED, side="right")))
        parts.append(bs._gather(values, None, [r[a:b] for r in runs])[:6])
        a = b
    fid, n, mean, m2, lo, hi = (np.concatenate(x) for x in zip(*parts, strict=True))
    at = np.searchsorted(fids, fid.astype(fids.dtype))
    np.add.at(out["n"], at, n)
    np.add.at(out["mean"], at, n * mean)
    out["mean"] = np.divide(out["mean"], out["n"], out=np.zeros(len(fids)), where=out["n"] != 0)
    np.add.at(out["m2"], at, m2 + np.where(n != 0, n * (mean - out["mean"][at]) ** 2, 0.0))
    np.minimum.at(out["lo"], at, lo)
    np.maximum.at(out["hi"], at, hi)
    return fids, out


def _met(it: Iterator[pa.RecordBatch], grid: Grid, side: int) -> Iterator[pa.RecordBatch]:
    """``tile_row, tile_col, version, data, share, runs`` -> a row for each feature of a tile."""
    for batch in it:
        for i in range(batch.num_rows):
            r, c, version, share = (batch.column(k)[i].as_py() for k in (0, 1, 2, 4))
            shape = shape_of(grid, side, r, c)
            data = batch.column(3)[i]
            values = block_array(data.as_buffer(), shape) if data.is_valid else np.full(shape, np.nan)
            listed = batch.column(5)[i].values
            runs = [listed.field(k).to_numpy() for k in range(5)]
            order = np.argsort(runs[0], kind="stable")
            fids, states = _of_tile(values, [x[order] for x in runs])
            same = [np.full(len(fids), x) for x in (share, r, c)]
            versions = pa.array([version] * len(fids), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(fids, pa.int64()), *(pa.array(x, pa.int32()) for x in same), versions, *(pa.array(states[n]) for n in _NODE.names[1:])], schema=_MET)


class TileTree(StatefulProcessor):
    """The states of one feature's tiles; gives the feature's state whenever a tile changes it.

    ``levels`` of nodes reach from the tiles to one root for each of ``shares``
    (a tile with very many runs is dealt to several tasks in shares).
    """

    def __init__(self, levels: int, shares: int):
        self.levels, self.shares = levels, shares

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.nodes = handle.getMapState("nodes", "share int, level int, r int, c int", "data binary")

    def _load(self, key: tuple[int, int, int, int]) -> np.ndarray:
        """A node, which is read once for all changes that come together."""
        if key not in self.held:
            found = self.nodes.getValue(key)
            self.held[key] = np.full(FAN * FAN, np.array(_NOTHING, _NODE)) if found is None else np.frombuffer(bytes(found[0]), _NODE).copy()
        return self.held[key]

    def _save(self, key: tuple[int, int, int, int]) -> None:
        self.nodes.updateValue(key, (self.held[key].tobytes(),))

    def _few(self) -> dict[tuple[int, int, int], tuple] | None:
        """The tiles of a feature without a tree by share and place; None if it has a tree."""
        found = self.nodes.getValue(_ALL)
        if found is None:  # a new feature, or a tree from before trees began as single tiles
            return None if any(self.nodes.containsKey((s, self.levels, 0, 0)) for s in range(self.shares)) else {}
        data = bytes(found[0])
        return {x[:3]: x[3:] for x in np.frombuffer(data, _TILE).tolist()} if data else None

    def _put(self, tiles: list[tuple[tuple[int, int, int], tuple]]) -> set[tuple[int, int, int, int]]:
        """Put tiles in their places; the nodes that changed."""
        changed = set()
        for (share, r, c), state in tiles:
            key, slot = (share, 1, r // FAN, c // FAN), r % FAN * FAN + c % FAN
            node = self._load(key)
            if state > tuple(node[slot].item()):
                node[slot] = state
                changed.add(key)
        for key in changed:
            self._save(key)
        return changed

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        tiles = [((x.share, x.tile_row, x.tile_col), (x.version, x.n, x.mean, x.m2, x.lo, x.hi)) for x in rows]
        few = self._few()
        if few is not None:
            more = False
            for at, state in tiles:
                if state > few.get(at, _NOTHING):
                    few[at], more = state, True
            if not more:
                return
            tiles = sorted(few.items())
            if len(few) <= FEW:
                table = np.array([(*at, *state) for at, state in tiles], _TILE)
                self.nodes.updateValue(_ALL, (table.tobytes(),))
                yield self._row(key[0], *merged(table))
                return
            self.nodes.updateValue(_ALL, (b"",))
        self.held: dict[tuple[int, int, int, int], np.ndarray] = {}
        changed = self._put(tiles)
        if not changed:
            return
        for level in range(1, self.levels):
            above: dict[tuple[int, int, int, int], list] = {}
            for k in sorted(changed):
                above.setdefault((k[0], level + 1, k[2] // FAN, k[3] // FAN), []).append(k)
            for up, below in above.items():
                node = self._load(up)
                for k in below:
                    node[k[2] % FAN * FAN + k[3] % FAN] = (0, *merged(self._load(k)))
                self._save(up)
            changed = set(above)
        roots = [(0, *merged(self._load((s, self.levels, 0, 0)))) for s in range(self.shares)]
        yield self._row(key[0], *merged(np.array(roots, _NODE)))

    def _row(self, fid: int, n: float, mean: float, m2: float, lo: float, hi: float) -> Row:
        given = [n, n * mean, lo, hi, mean if n else np.nan, m2 / n if n else np.nan] if lo <= hi else [None] * 6
        return Row(fid=fid, **dict(zip(("n", "s", "lo", "hi", "mu", "var"), given, strict=True)))


def levels_of(grid: Grid, side: int) -> int:
    """Levels of nodes above the tiles of a grid, one at least."""
    most, levels = max(-(-grid.rows // side), -(-grid.cols // side)), 1
    while most > FAN**levels:
        levels += 1
    return levels


def stream_tiles(tiles: DataFrame, features: DataFrame, key: str, ops, grid: Grid, side: int = SIDE, version: str | None = None, geometry: str = "geometry", kinds: str = "PL", dtype: str = "float64") -> DataFrame:
    """A streaming table ``key`` and a column for each operation: in each batch the features that a tile changed.

    ``tiles`` streams ``tile_row, tile_col, data`` as ``sources/blocks.py``
    defines them. A tile that comes again replaces the earlier one; with a
    ``version`` column only a higher version does, and a lower one that comes
    late is passed over. Of one tile twice in a batch, or of equal versions, one
    counts, whichever the order. Null ``data`` withdraws a tile; tiles outside the
    grid are passed over. A null version is the time of its batch, as all are without the column.

    ``features`` are at rest; ``key`` is a unique integer column (rows with null
    are passed over) and must stay the same for a query that is restarted, as
    must the features. Features without a tile so far do not appear. The
    operations are those that states of blocks give, without weights, of one kind of
    coverage. Write the result in update mode; the last row of a key is the valid
    one. Sets the session's store of states to RocksDB.
    """
    spark = tiles.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    if dtype not in BLOCK_TYPES:
        raise ValueError(f"Blocks can't hold cells of type {dtype}")
    raster = Raster("", grid, dtype, spark.createDataFrame([], "row int, col int, value double"))
    plan = zonal.plan_operations([raster], [], ops)
    zonal.unique_names([key, *(o.name for o in plan)])
    if any(o.custom is not None or o.stat not in bs.BLOCK_STATS or o.default_value is not None or o.key[1] is not None for o in plan):
        raise ValueError("Tiles that arrive as a stream give only statistics of merged states, without weights")
    if len({o.key for o in plan}) != 1:
        raise ValueError("All operations over streamed tiles need the same kind of coverage")
    op = plan[0]
    known = features.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("fid"), F.col(geometry).alias("geometry"))
    e = cut(edges(known, "fid", "geometry"), "st-edges")
    runs = coverage_runs(e, grid, kinds)
    if op.min_coverage > 0:
        runs = runs.where(F.col("cov") >= F.lit(op.min_coverage).cast("float"))
    pieces = bs.by_tile(runs.withColumn("c", zonal._cover(op.coverage_weight, grid).cast("double")), side)
    lists = cut(bs.dealt(pieces), "st-lists")
    drop_cut(pieces)
    drop_cut(e)
    shares = (lists.agg(F.max("share")).first()[0] or 0) + 1  # type: ignore[index]
    at = ["tile_row", "tile_col"]
    # the time of a batch, which a batch that is run again keeps; timers would call for batches without end
    now = F.unix_millis(F.current_timestamp())
    told = F.coalesce(F.col(version).cast("long"), now) if version else now
    given = tiles.select(*(F.col(c).cast("int").alias(c) for c in at), told.alias("version"), "data")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _met(it, grid, side)

    met = given.join(lists, at).select(*at, "version", "data", F.col("share").cast("int").alias("share"), "runs").mapInArrow(run, _MET_DDL)
    found = met.groupBy("fid").transformWithState(TileTree(levels_of(grid, side), int(shares)), _RESULT, "Update", "None")
    place = zonal._x_of(grid), zonal._y_of(grid)
    results = [st.MOMENT_RESULT[o.stat]() if o.stat in st.MOMENT else st.scalar(o.stat, *place)[1]() for o in plan]
    return found.select(F.col("fid").alias(key), *[st.fill(o.stat, c, st.result_type(o.stat, raster.result_type)).alias(o.name) for o, c in zip(plan, results, strict=True)])
