"""Runs with running sums, tiles that features meet, and quantiles of features with many values."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.functions.grid import Box, Grid
from gridloom.operators import runs as rn
from gridloom.operators import statistics as st
from gridloom.operators.coverage import coverage_runs
from gridloom.plans import zonal
from gridloom.plans.zonal import zonal_stats
from gridloom.sources.geometry import edges
from gridloom.sources.raster import from_array, from_table


def polygon(*rings):
    return "POLYGON (" + ", ".join("(" + ", ".join(f"{x} {y}" for x, y in [*r, r[0]]) + ")" for r in rings) + ")"


def blob(rng, cx, cy, size):
    n = rng.randint(5, 12)
    return [(cx + size * rng.uniform(0.4, 1) * math.cos(2 * math.pi * i / n), cy + size * rng.uniform(0.4, 1) * math.sin(2 * math.pi * i / n)) for i in range(n)]


def near(a, b):
    if a is None or b is None or isinstance(a, float) and math.isnan(a):
        return a is b or a is None and b is None or (isinstance(b, float) and math.isnan(a) and math.isnan(b))
    return a == b or abs(a - b) <= 1e-9 * max(abs(a), abs(b))


def both_ways(spark, monkeypatch, values, features, ops, weights=None, **options):
    """Results by runs and, with runs switched off, by cells."""
    got = zonal_stats(values, features, ops, weights, "id", **options).orderBy("id").collect()
    with monkeypatch.context() as m:
        m.setattr(zonal, "of_runs", lambda *_: False)
        want = zonal_stats(values, features, ops, weights, "id", **options).orderBy("id").collect()
    assert [r.asDict().keys() for r in got] == [r.asDict().keys() for r in want]
    for a, b in zip(got, want, strict=True):
        assert all(near(x, y) for x, y in zip(a, b, strict=True)), (a, b)
    return got


def features_of(spark, shapes):
    return spark.createDataFrame([(i, s) for i, s in enumerate(shapes)], "id int, geometry string")


def test_runs_equal_cells(spark, monkeypatch):
    rng = random.Random(1)
    a = np.random.default_rng(2).lognormal(0, 2, (40, 60))
    a[np.random.default_rng(3).random(a.shape) < 0.2] = np.nan
    w = np.random.default_rng(4).random((20, 30))
    w[np.random.default_rng(5).random(w.shape) < 0.1] = np.nan
    values, weights = from_array(spark, a, Box(0, 0, 60, 40), "v"), from_array(spark, w, Box(0, 0, 60, 40), "w")
    shapes = [polygon(blob(rng, rng.uniform(-5, 65), rng.uniform(-5, 45), rng.uniform(1, 25))) for _ in range(25)]
    shapes += [polygon([(2, 2), (58, 2), (58, 38), (2, 38)], [(10, 10), (50, 10), (50, 30), (10, 30)]), polygon([(100, 100), (101, 100), (101, 101)]), None, "LINESTRING (1 1, 50 39, 55 3)"]
    f = features_of(spark, shapes)
    both_ways(spark, monkeypatch, values, f, ["count", "sum", "mean", "a=count(min_coverage_frac=0.5)", "b=sum(coverage_weight=none)", "c=count(coverage_weight=area_spherical_km2)"])
    # a weight raster of half the resolution; missing weights spoil their own features, or have a default
    monkeypatch.setattr(rn, "BLOCK", 7)
    both_ways(spark, monkeypatch, values, f, ["weighted_mean", "weighted_sum(default_weight=0.5)", "weighted_count(default_weight=0)", "weighted_fraction(default_weight=2)", "mean"], weights)


def test_large_values_beside_a_feature(spark, monkeypatch):
    a = np.ones((6, 40))
    a[:, 3], a[2, 9], a[4, 20] = -3.4e38, 1e22, np.inf
    values = from_array(spark, a, Box(0, 0, 40, 6), "v")
    f = features_of(spark, [polygon([(12, 0), (18.5, 0), (18.5, 6), (12, 6)]), polygon([(25, 1), (39, 1), (39, 2.5), (25, 2.5)]), polygon([(0, 0), (40, 0), (40, 6), (0, 6)]), polygon([(5, 0), (11, 0), (11, 6), (5, 6)])])
    got = both_ways(spark, monkeypatch, values, f, ["sum", "mean", "count"])
    assert [r["mean"] for r in got[:2]] == [1.0, 1.0] and got[0]["sum"] == 39.0


def test_what_is_read_grows_with_the_outline(spark):
    f = features_of(spark, [polygon([(0.5, 0.5), (n + 0.5, 0.5), (n + 0.5, n + 0.5), (0.5, n + 0.5)]) for n in (50, 100, 200)])
    points = rn.changes(coverage_runs(edges(f, "id"), Grid(0, 0, 300, 300, 1, 1)).withColumn("c", F.col("cov").cast("double")))
    n = dict(points.groupBy("fid").count().collect())
    assert n[0] < 50 * 5 and n[1] < 2.1 * n[0] and n[2] < 2.1 * n[1]


def test_tiles_of_parts_and_hollows(spark):
    grid = Grid(0, 0, 512, 512, 1, 1)
    cells = spark.range(0).select(*[F.col("id").cast("int").alias(c) for c in ("row", "col", "value", "tile_row", "tile_col")])
    r = from_table(cells, grid, "v", tiles=8)
    specks = "MULTIPOLYGON (((0.1 0.1, 0.2 0.1, 0.2 0.2, 0.1 0.1)), ((511.1 511.1, 511.2 511.1, 511.2 511.2, 511.1 511.1)))"
    c_shape = polygon([(4, 4), (508, 4), (508, 12), (12, 12), (12, 500), (508, 500), (508, 508), (4, 508)])
    got = {}
    for t in r.tile_cover(edges(features_of(spark, [specks, c_shape, "LINESTRING (1 1, 1 100)"]), "id")).collect():
        got.setdefault(t.fid, set()).add((t.tile_row, t.tile_col))
    assert got[0] == {(63, 0), (0, 63)}
    # the arms and the back, and nothing of the hollow between them
    assert len(got[1]) < 4 * 64 * 2 and not any(5 < a < 58 and 5 < b for a, b in got[1])
    assert got[2] == {(63 - k, 0) for k in range(13)}


def test_only_the_tiles_that_are_met_are_read(spark):
    grid = Grid(0, 0, 64, 64, 1, 1)
    i = F.col("id").cast("int")
    cells = spark.range(64 * 64).select(F.floor(i / 64).cast("int").alias("row"), (i % 64).alias("col"), i.alias("value"), F.floor(i / 512).cast("int").alias("tile_row"), F.floor(i % 64 / 8).cast("int").alias("tile_col"))
    r = from_table(cells, grid, "v", tiles=8)
    f = features_of(spark, ["MULTIPOLYGON (((1 1, 2 1, 2 2, 1 2, 1 1)), ((61 61, 63 61, 63 62, 61 62, 61 61)))"])
    assert r.read_near(edges(f, "id")).cells.count() == 128
    got = zonal_stats(r, f, ["count", "sum", "max"], None, "id").first()
    assert (got["count"], got["max"]) == (3.0, 62 * 64 + 1)


def plain_quantiles(pairs, qs):
    """Interpolation between the values, weights as the library defines."""
    xs = sorted(pairs)
    n, total = len(xs), sum(w for _, w in xs)
    place, before = [], 0.0
    for i, (_, w) in enumerate(xs):
        place.append(0.0 if i == 0 else i * w + (n - 1) * before)
        before += w
    out = []
    for q in qs:
        t = q * total * (n - 1)
        i = max(k for k in range(n) if place[k] <= t)
        if i == n - 1 or place[i + 1] == place[i]:
            out.append(xs[i][0])
        else:
            out.append(xs[i][0] + (t - place[i]) * (xs[i + 1][0] - xs[i][0]) / (place[i + 1] - place[i]))
    return out


@pytest.mark.parametrize("sigma", [0.1, 3.0])
def test_features_with_many_values_are_narrowed(spark, sigma, monkeypatch):
    rng = np.random.default_rng(7)
    data = {1: rng.lognormal(0, sigma, 20_000), 2: rng.lognormal(0, sigma, 30), 3: np.arange(3000.0), 4: np.array([5.0]), 5: -rng.lognormal(5, sigma, 4000)}
    rows = [(f, float(x), float(w)) for f, xs in data.items() for x, w in zip(xs, rng.random(len(xs)) + 0.01)]
    hist = spark.createDataFrame(rows, "fid long, x double, sc double").repartition(5)
    qs = [0.0, 0.01, 0.25, 0.5, 0.9, 1.0]
    for borders in (st.MOST_BORDERS, 0):
        monkeypatch.setattr(st, "MOST_BORDERS", borders)
        got = {r.fid: list(r)[1:] for r in st.quantiles(hist, qs, "double", 100).collect()}
        for f in data:
            want = plain_quantiles([(x, w) for g, x, w in rows if g == f], qs)
            assert np.allclose(got[f], want, rtol=1e-9), f


def test_slices_are_even_whatever_the_values(spark):
    xs = np.random.default_rng(8).lognormal(0, 3, 100_000)
    rows = spark.createDataFrame([(1, 0, float(x)) for x in xs], "fid long, part long, x double")
    sizes = [r["count"] for r in st._sliced(rows).groupBy("slice").count().collect()]
    assert sum(sizes) == len(xs) and max(sizes) < 0.05 * len(xs)


def test_many_sets_of_borders_are_not_broadcast(spark, monkeypatch):
    """Borders of many features grow no faster than their values, and small files of them are no reason to send them to the driver."""
    rows = spark.range(3000).selectExpr("cast(id % 60 as long) fid", "0L part", "cast(id % 7 as double) x").union(spark.range(40_000).selectExpr("99L", "0L", "cast(id as double)"))
    want = sorted(map(tuple, st._sliced(rows).collect()))
    monkeypatch.setattr(st, "MOST_BORDERS", 10)
    for dealt, copies in ((st.DEALT, 61), (100, 60 + st.SLICES)):
        monkeypatch.setattr(st, "DEALT", dealt)
        sliced = st._sliced(rows)
        assert sorted(map(tuple, sliced.collect())) == want
        plan = sliced._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
        assert "SortMergeJoin" in plan
        made = []
        explode = F.explode
        monkeypatch.setattr(st.F, "explode", lambda c: made.append(c) or explode(c))
        st._sliced(rows)
        monkeypatch.setattr(st.F, "explode", explode)
        sets = rows.groupBy("fid", "part").agg(F.count("*").alias("many")).select(explode(made[0]))
        assert sets.count() == copies


def test_planner_narrows_by_count_of_cells(spark, monkeypatch):
    a = np.random.default_rng(9).lognormal(0, 3, (50, 50))
    values = from_array(spark, a, Box(0, 0, 50, 50), "v")
    f = features_of(spark, [polygon([(0, 0), (50, 0), (50, 50), (0, 50)]), polygon([(3, 3), (6, 3), (6, 5), (3, 5)])])
    ops = ["median", "quantile(q=0.99)", "max"]
    want = [tuple(r) for r in zonal_stats(values, f, ops, None, "id").orderBy("id").collect()]
    monkeypatch.setattr(st, "MANY", 50)
    got = [tuple(r) for r in zonal_stats(values, f, ops, None, "id").orderBy("id").collect()]
    assert np.allclose(got, want, rtol=1e-12) and np.isclose(want[0][1], np.median(a))
