"""Tiles that arrive as a stream: the last of each counts, in any order of arrival."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.functions.grid import Box, Grid
from gridloom.operators import block_states as bs
from gridloom.plans.zonal import zonal_stats
from gridloom.sources.blocks import of_blocks, to_blocks
from gridloom.sources.raster import from_array
from gridloom.streaming.tiles import _NODE, _NOTHING, levels_of, merged, stream_tiles
from tests.test_runs import blob, features_of, near, polygon

OPS = ["count", "sum", "mean", "min", "max", "variance", "stdev"]
H, W, SIDE = 37, 53, 4
GRID = Grid(0, 0, W, H, 1, 1)


def batches_of(spark, folder, tables):
    for k, t in enumerate(tables):
        t.coalesce(1).write.mode("append").parquet(f"{folder}/{k}")


def drain(spark, folder, features, out, checkpoint, **options):
    """Process what has come; the last row of each feature over all batches so far."""
    tiles = spark.readStream.schema("tile_row int, tile_col int, data binary, version long").option("maxFilesPerTrigger", 1).parquet(f"{folder}/*")
    result = stream_tiles(tiles, features, "id", OPS, GRID, SIDE, **options)
    write = lambda df, n: df.withColumn("batch", F.lit(n)).write.mode("overwrite").parquet(f"{out}/n={n}")
    result.writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination(180)
    rows = spark.read.parquet(out).drop("n").collect()
    last = {}
    for r in sorted(rows, key=lambda r: r.batch):
        last[r.id] = r
    return last, len({r.batch for r in rows})


def same(got, want):
    for w in want:
        if w["count"] or w.id in got:
            for c in OPS:
                assert near(got[w.id][c], w[c]) or np.isclose(got[w.id][c], w[c], rtol=1e-9), (w.id, c, got[w.id], w)


@pytest.mark.parametrize("versions", [True, False])
def test_replaced_tiles_and_restart(spark, tmp_path, monkeypatch, versions):
    rng = random.Random(3)
    old = np.random.default_rng(1).normal(1e6, 1, (H, W))
    new = old + np.random.default_rng(2).normal(-50, 9, (H, W))
    new[np.random.default_rng(3).random((H, W)) < 0.3] = np.nan
    blocks = [to_blocks(from_array(spark, a, Box(0, 0, W, H), "v"), SIDE).blocks for a in (old, new)]
    shapes = [polygon(blob(rng, rng.uniform(0, W), rng.uniform(0, H), rng.uniform(1, 22))) for _ in range(9)]
    f = features_of(spark, [*shapes, "LINESTRING (1 1, 50 36, 52 3)", polygon([(0, 0), (0.5, 0), (0.5, 0.5)]), None])
    if versions:
        # shares of hot tiles
        monkeypatch.setattr(bs, "MOST_RUNS", 3)
    third = F.pmod(F.col("tile_row") * 7 + F.col("tile_col"), F.lit(3))
    v = lambda t, n: t.withColumn("version", F.lit(n).cast("long"))
    first, second = v(blocks[0], 1), v(blocks[1], 2)
    folder, out, cp = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp")
    batches_of(spark, folder, [first.where(third == 0).unionAll(first.where(third == 0)), first.where(third != 0), first.where(third == 1)])
    options = {"version": "version"} if versions else {}
    got, n = drain(spark, folder, f, out, cp, **options)
    assert n >= 2
    v0 = zonal_stats(of_blocks(blocks[0], GRID, SIDE, "v"), f, OPS, None, "id").collect()
    same(got, v0)
    # from the checkpoint: some tiles are replaced, and with versions late ones of the old raster change nothing
    more = [second.where(third == 1)] + ([first.where(third == 1)] if versions else [])
    for k, t in enumerate(more):
        t.coalesce(1).write.parquet(f"{folder}/late{k}")
    got, _ = drain(spark, folder, f, out, cp, **options)
    mixed = blocks[0].where(third != 1).unionAll(blocks[1].where(third == 1))
    same(got, zonal_stats(of_blocks(mixed, GRID, SIDE, "v"), f, OPS, None, "id").collect())
    # withdrawn tiles leave nothing
    second.withColumns({"data": F.lit(None).cast("binary"), "version": F.lit(9).cast("long")}).unionAll(v(spark.createDataFrame([(99, 0, None)], blocks[0].schema), 9)).coalesce(1).write.parquet(f"{folder}/none")
    got, _ = drain(spark, folder, f, out, cp, **options)
    assert {r["count"] for r in got.values()} == {0.0} and all(r["min"] is None for r in got.values())


def test_nodes_and_levels():
    assert [levels_of(Grid(0, 0, n, 1, 1, 1), 1) for n in (1, 8, 9, 64, 65)] == [1, 1, 2, 2, 3]
    x, c = np.random.default_rng(6).normal(1e9, 1e-3, 640), np.random.default_rng(7).random(640)
    node = np.full(64, np.array(_NOTHING, _NODE))
    for k, (a, w) in enumerate(zip(np.split(x, 64), np.split(c, 64), strict=True)):
        m = np.average(a, weights=w)
        node[k] = (1, w.sum(), m, (w * (a - m) ** 2).sum(), a.min(), a.max())
    n, mean, m2, lo, hi = merged(node)
    assert np.isclose(n, c.sum()) and (lo, hi) == (x.min(), x.max())
    assert np.isclose(m2 / n, np.average((x - 1e9 - np.average(x - 1e9, weights=c)) ** 2, weights=c), rtol=1e-3)


def test_what_is_refused(spark):
    tiles = spark.readStream.format("rate").load().selectExpr("0 tile_row", "0 tile_col", "cast(null as binary) data")
    f = features_of(spark, [polygon([(0, 0), (1, 0), (1, 1)])])
    for ops in (["median"], ["mean", "a=mean(min_coverage_frac=0.5)"], ["mean(default_value=1)"]):
        with pytest.raises(ValueError):
            stream_tiles(tiles, f, "id", ops, GRID, SIDE)


class Kept:
    """A map state in memory that counts its calls."""

    def __init__(self):
        self.data, self.calls = {}, 0

    def getMapState(self, *_):
        return self

    def getValue(self, key):
        self.calls += 1
        return self.data.get(key)

    def containsKey(self, key):
        self.calls += 1
        return key in self.data

    def updateValue(self, key, value):
        self.calls += 1
        self.data[key] = value


@pytest.mark.parametrize("few", [0, 30, 128])
def test_few_tiles_need_few_calls_and_grow_to_a_tree(monkeypatch, few):
    from pyspark.sql import Row

    from gridloom.streaming import tiles

    monkeypatch.setattr(tiles, "FEW", few)
    rng, kept, tree, last = random.Random(4), Kept(), tiles.TileTree(4, 2), {}
    tree.init(kept)
    for turn in range(8):
        rows = []
        for _ in range(12):
            at, n, mean = (rng.randrange(2), rng.randrange(3000), rng.randrange(7)), rng.uniform(0.1, 64), rng.uniform(-5, 5)
            rows.append(Row(fid=1, share=at[0], tile_row=at[1], tile_col=at[2], version=rng.randrange(9), n=n, mean=mean, m2=n, lo=mean - 1, hi=mean + 1))
            state = (rows[-1].version, n, mean, n, mean - 1, mean + 1)
            last[at] = max(last.get(at, _NOTHING), state)
        before = kept.calls
        (got,) = tree.handleInputRows((1,), iter(rows), None)
        n, mean, m2, lo, hi = merged(np.array(list(last.values()), _NODE))
        assert np.allclose([got.n, got.s, got.lo, got.hi, got.mu, got["var"]], [n, n * mean, lo, hi, mean, m2 / n])
        if len(last) <= few:
            assert kept.calls - before <= 4
        # what comes again, or late, changes nothing
        assert list(tree.handleInputRows((1,), iter([r for r in rows]), None)) == []
    # a tree from before features began without one
    if few == 0:
        del kept.data[tiles._ALL]
        assert list(tree.handleInputRows((1,), iter(rows), None)) == []
