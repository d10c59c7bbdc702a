"""Statistics of features over rasters in blocks, by states that merge.

The task that has a block gathers a state for each feature in it: weight, mean
and squares about that mean, extremes. Only states leave the task, never cells.
States of one feature merge to the whole: weights add up, and squares about the
common mean are those about the own mean and what lies between the two, so
nothing cancels and one pass over the cells is enough for the variances too.

Runs of coverage come to the blocks: as lists by tile, sent to all tasks up to
:data:`MOST_SENT` runs, by a join of whole blocks beyond. A tile with more than
:data:`MOST_RUNS` runs is dealt in shares to several tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions.grid import Grid
from gridloom.operators import statistics as st
from gridloom.shared import cut, drop_cut
from gridloom.sources.blocks import block_array, shape_of

#: Statistics that merged states give.
BLOCK_STATS = ("count", "sum", "mean", "min", "max", "weighted_sum", "weighted_mean", "weighted_count", "weighted_fraction", *st.MOMENT)
#: Runs in one list, runs (some 40 bytes each) that go to all tasks, and cells that a task unfolds at once.
MOST_RUNS, MOST_SENT, MOST_UNFOLDED = 20_000, 1_000_000, 1 << 20

_NAMES = ("n", "mean", "m2", "lo", "hi", "nw", "meanw", "m2w", "gone")
_STATES = pa.schema([("fid", pa.int64()), *((n, pa.float64()) for n in _NAMES)])


def by_tile(runs: DataFrame, side: int) -> DataFrame:
    """``fid, row, first, last, c`` cut at the borders of tiles, as lists ``tile_row, tile_col, runs``."""
    a, b = F.floor(F.col("first") / side).cast("int"), F.floor(F.col("last") / side).cast("int")
    pieces = runs.select("fid", F.floor(F.col("row") / side).cast("int").alias("tile_row"), F.explode(F.sequence(a, b)).alias("tile_col"), "row", "first", "last", "c")
    left = F.col("tile_col") * side
    pieces = pieces.select("tile_row", "tile_col", "fid", (F.col("row") - F.col("tile_row") * side).alias("row"), (F.greatest("first", left) - left).alias("first"), (F.least(F.col("last"), left + side - 1) - left).alias("last"), "c")
    return cut(pieces, "zs-pieces")


def dealt(pieces: DataFrame) -> DataFrame:
    """Lists of at most some :data:`MOST_RUNS` runs; a feature's row stays in one share."""
    at = ["tile_row", "tile_col"]
    hot = cut(pieces.groupBy(*at).count().where(F.col("count") > MOST_RUNS).select(*at, F.ceil(F.col("count") / MOST_RUNS).alias("shares")), "zs-hot")
    if hot.count():
        pieces = pieces.join(hot, at, "left")
        share = F.pmod(F.xxhash64("fid", "row"), F.coalesce(F.col("shares"), F.lit(1)))
    else:
        share = F.lit(0)
    return pieces.groupBy(*at, share.alias("share")).agg(F.collect_list(F.struct("fid", "row", "first", "last", "c")).alias("runs"))


def _gather(values: np.ndarray, weights: np.ndarray | None, runs: list[np.ndarray]) -> list[np.ndarray]:
    """A state for each feature of one slice of runs (fid, row, first, last, c), which are sorted by feature."""
    fid, row, first, last, c = runs
    size = last - first + 1
    ends = np.cumsum(size)
    at = np.arange(ends[-1]) - np.repeat(ends - size, size) + np.repeat(row.astype(np.int64) * values.shape[1] + first, size)
    x = values.ravel()[at]
    ok = ~np.isnan(x)
    if not ok.any():
        return [np.empty(0)] * 10
    x, c, of = x[ok], np.repeat(c, size)[ok], np.repeat(fid, size)[ok]
    begin = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
    count = np.diff(np.append(begin, len(of)))
    total = lambda v: np.add.reduceat(v, begin)

    def moments(c: np.ndarray) -> list[np.ndarray]:
        n = total(c)
        with np.errstate(all="ignore"):
            mean = np.where(n != 0, total(c * x) / n, 0.0)
            return [n, mean, total(np.where(c == 0, 0.0, c * (x - np.repeat(mean, count)) ** 2))]

    out = [of[begin], *moments(c), np.minimum.reduceat(x, begin), np.maximum.reduceat(x, begin)]
    if weights is None:
        return [*out, *[np.zeros(len(begin))] * 4]
    w = weights.ravel()[at][ok]
    gone = np.isnan(w)
    return [*out, *moments(c * np.where(gone, 0.0, w)), total(gone.astype(float))]


def _states(it: Iterator[pa.RecordBatch], grid: Grid, side: int, default_weight: float | None, weighted: bool) -> Iterator[pa.RecordBatch]:
    for batch in it:
        for i in range(batch.num_rows):
            shape = shape_of(grid, side, batch.column(0)[i].as_py(), batch.column(1)[i].as_py())
            values = block_array(batch.column(2)[i].as_buffer(), shape)
            weights = None
            if weighted:
                given = batch.column(3)[i]
                weights = block_array(given.as_buffer(), shape) if given.is_valid else np.full(shape, np.nan)
                if default_weight is not None:
                    weights = np.where(np.isnan(weights), default_weight, weights)
            listed = batch.column(batch.num_columns - 1)[i].values
            runs = [listed.field(k).to_numpy() for k in range(5)]
            order = np.argsort(runs[0], kind="stable")
            runs = [r[order] for r in runs]
            ends = np.cumsum(runs[3] - runs[2] + 1)
            a = 0
            while a < len(ends):
                b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + MOST_UNFOLDED, side="right")))
                state = _gather(values, weights, [r[a:b] for r in runs])
                if len(state[0]):
                    yield pa.RecordBatch.from_arrays([pa.array(s, t) for s, t in zip(state, _STATES.types)], schema=_STATES)
                a = b


def states(values, weights, runs: DataFrame, default_weight: float | None) -> DataFrame:
    """A state for each feature and block: ``fid, n, mean, m2, lo, hi, nw, meanw, m2w, gone``; written once."""
    grid, side = values.grid, values.tiles
    pieces = by_tile(runs, side)
    lists = dealt(pieces)
    blocks, at = values.blocks.select("tile_row", "tile_col", "data"), ["tile_row", "tile_col"]
    if weights is not None:
        blocks = blocks.join(weights.blocks.select(*at, F.col("data").alias("weight")), at, "left")
    if pieces.count() <= MOST_SENT:
        lists = F.broadcast(lists)
    met = blocks.join(lists, at).select(*at, "data", *(["weight"] if weights is not None else []), "runs")
    weighted = weights is not None

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _states(it, grid, side, default_weight, weighted)

    out = cut(met.mapInArrow(run, "fid long, " + ", ".join(f"{n} double" for n in _NAMES)), "zs-states")
    drop_cut(pieces)
    return out


def merge(found: DataFrame) -> DataFrame:
    """States of each feature as one: ``fid, n, s, lo, hi, mu, var, nw, sw, varw``."""
    n, nw = F.sum("n"), F.sum("nw")
    spoilt = lambda c: F.when(F.col("gone") > 0, F.lit(st.NAN)).otherwise(c)
    whole = found.groupBy("fid").agg(n.alias("n"), F.sum(F.col("n") * F.col("mean")).alias("s"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), nw.alias("nw"), F.sum(F.col("nw") * F.col("meanw")).alias("sw"), F.sum("gone").alias("gone"))
    ratio = lambda a, b: F.when(b != 0, a / F.nullif(b, F.lit(0.0)))
    means = whole.select(F.col("fid").alias("f"), ratio(F.col("s"), F.col("n")).alias("mu"), ratio(F.col("sw"), F.col("nw")).alias("muw"))
    about = lambda m2, n, mean, mu: F.sum(F.col(m2) + F.when(F.col(n) != 0, F.col(n) * (F.col(mean) - F.col(mu)) ** 2).otherwise(F.lit(0.0)))
    squares = found.join(means, F.col("fid") == F.col("f")).groupBy("f").agg(F.first("mu").alias("mu"), about("m2", "n", "mean", "mu").alias("q"), about("m2w", "nw", "meanw", "muw").alias("qw"))
    out = whole.join(squares, F.col("fid") == F.col("f")).drop("f")
    nan: Column = F.lit(st.NAN)
    return out.select("fid", "n", "s", "lo", "hi", F.coalesce("mu", nan).alias("mu"), F.coalesce(ratio(F.col("q"), F.col("n")), nan).alias("var"), spoilt(F.col("nw")).alias("nw"), spoilt(F.col("sw")).alias("sw"), spoilt(F.coalesce(ratio(F.col("qw"), F.col("nw")), nan)).alias("varw"))
