"""Rasters in blocks: states that merge, against the path by cells."""

import random

import numpy as np
import pytest

from gridloom.functions.grid import Box, Grid
from gridloom.operators import block_states as bs
from gridloom.plans import zonal
from gridloom.plans.zonal import zonal_stats
from gridloom.sources.blocks import BlockRaster, of_blocks, to_blocks
from gridloom.sources.raster import from_array
from tests.test_runs import blob, features_of, near, polygon


def test_blocks_equal_cells(spark, monkeypatch):
    rng = random.Random(1)
    a = np.random.default_rng(2).normal(1e6, 1, (37, 53))
    a[np.random.default_rng(3).random(a.shape) < 0.2] = np.nan
    w = np.random.default_rng(4).random(a.shape)
    w[np.random.default_rng(5).random(w.shape) < 0.1] = np.nan
    cells = from_array(spark, a, Box(0, 0, 53, 37), "v"), from_array(spark, w, Box(0, 0, 53, 37), "w")
    v, ww = (to_blocks(r, 16) for r in cells)
    assert isinstance(v, BlockRaster) and sorted(map(tuple, v.cells.select("row", "col", "value").collect())) == sorted(tuple(r) for r in cells[0].cells.where("value is not null").select("row", "col", "value").collect())
    shapes = [polygon(blob(rng, rng.uniform(-5, 58), rng.uniform(-5, 42), rng.uniform(1, 25))) for _ in range(12)]
    f = features_of(spark, [*shapes, polygon([(100, 100), (101, 100), (101, 101)]), None, "LINESTRING (1 1, 50 36, 52 3)"])
    ops = ["count", "mean", "min", "max", "variance", "stdev", "coefficient_of_variation", "a=variance(min_coverage_frac=0.5)", "b=sum(coverage_weight=none)"]
    weighted = ["weighted_mean", "weighted_variance", "c=weighted_variance(default_weight=0)", "d=weighted_sum(default_weight=2)"]
    want = zonal_stats(cells[0], f, [*ops, *weighted, "median"], cells[1], "id").orderBy("id").collect()
    # hot tiles in shares, runs unfolded in small slices, lists joined instead of sent
    for settings in ({}, {"MOST_RUNS": 3, "MOST_SENT": 0}):
        for k, x in settings.items():
            monkeypatch.setattr(bs, k, x)
        got = zonal_stats(v, f, [*ops, *weighted], ww, "id").orderBy("id").collect()
        for x, y in zip(got, want, strict=True):
            assert all(near(x[c], y[c]) for c in x.asDict() if "var" not in c and c not in ("stdev", "a", "c")), (x, y)
            # squares about a mean of a million: a relative error of the mean shows
            assert all(x[c] is None and y[c] is None or np.isclose(x[c], y[c], rtol=1e-6, equal_nan=True) for c in ("variance", "stdev", "a", "c", "weighted_variance")), (x, y)


def test_other_statistics_take_the_cells(spark):
    v = to_blocks(from_array(spark, np.arange(48.0).reshape(6, 8), Box(0, 0, 8, 6), "v"), 4)
    got = zonal_stats(v, features_of(spark, [polygon([(0, 0), (2, 0), (2, 1), (0, 1)])]), ["values", "median", "mean"], None, "id").first()
    assert (got["values"], got["median"], got["mean"]) == ([40.0, 41.0], 40.5, 40.5)


def test_states_merge_without_loss():
    x, c = np.random.default_rng(6).normal(1e9, 1e-3, 5000), np.random.default_rng(7).random(5000)
    values, first = x.reshape(1, -1), np.arange(5000)
    parts = [[np.full(n, 7), np.zeros(n, int), first[a : a + n], first[a : a + n], c[a : a + n]] for a, n in ((0, 10), (10, 1990), (2000, 3000))]
    states = [bs._gather(values, None, p) for p in parts]
    n = sum(s[1][0] for s in states)
    mu = sum(s[1][0] * (s[2][0] - 1e9) for s in states) / n + 1e9
    var = sum(s[3][0] + s[1][0] * (s[2][0] - mu) ** 2 for s in states) / n
    mean = np.average(x - 1e9, weights=c)
    assert np.isclose(var, np.average((x - 1e9 - mean) ** 2, weights=c), rtol=1e-3)


def test_no_cells_are_shuffled(spark, monkeypatch):
    seen = []
    real = zonal.bs.states
    monkeypatch.setattr(zonal.bs, "states", lambda *a: seen.append(real(*a)) or seen[-1])
    monkeypatch.setattr(zonal, "cells_of_runs", lambda *_: pytest.fail("cells were made"))
    v = to_blocks(from_array(spark, np.arange(4096.0).reshape(64, 64), Box(0, 0, 64, 64), "v"), 16)
    f = features_of(spark, [polygon([(1.5, 1.5), (60.5, 1.5), (60.5, 60.5), (1.5, 60.5)]), polygon([(3, 3), (5, 3), (5, 5)])])
    assert zonal_stats(v, f, ["variance", "count"], None, "id").count() == 2
    # a row for each feature and tile
    assert seen[0].count() == 17


def test_bad_blocks(spark):
    with pytest.raises(ValueError):
        of_blocks(spark.createDataFrame([], "tile_row int, tile_col int, data binary"), Grid(0, 0, 4, 4, 1, 1), 2, dtype="int64")
    short = spark.createDataFrame([(0, 0, bytearray(8))], "tile_row int, tile_col int, data binary")
    with pytest.raises(Exception, match="holds 1"):
        of_blocks(short, Grid(0, 0, 4, 4, 1, 1), 2).cells.collect()
    none = of_blocks(short.where("1=0"), Grid(0, 0, 4, 4, 1, 1), 2)
    got = zonal_stats(none, features_of(spark, [polygon([(0, 0), (2, 0), (2, 1)])]), ["count", "variance"], None, "id").first()
    assert got["count"] == 0.0 and np.isnan(got["variance"])
