"""Invariants of the coverage join and of merging, on random star-shaped polygons."""

import math
import random

import pytest
from pyspark.sql import functions as F

from gridloom.functions.grid import Grid
from gridloom.operators.coverage import coverage
from gridloom.operators.subdivide import subdivide
from gridloom.plans.zonal import zonal_stats
from gridloom.sources.geometry import edges, signed_area
from gridloom.sources.raster import from_table


def star(rng, n):
    cx, cy = rng.uniform(8, 32), rng.uniform(8, 22)
    ring = [(cx + (r := rng.uniform(1, 7)) * math.cos(t), cy + r * math.sin(t)) for t in sorted(rng.uniform(0, 2 * math.pi) for _ in range(n))]
    return ring if rng.random() < 0.5 else ring[::-1]


@pytest.fixture(scope="module")
def stars(spark):
    rng = random.Random(12)
    rings = {i: star(rng, rng.randint(5, 60)) for i in range(60)}
    # gaps of over half a turn between corners would leave the centre outside; areas are by the ring itself
    rows = [(i, "POLYGON ((" + ", ".join(f"{x!r} {y!r}" for x, y in [*r, r[0]]) + "))") for i, r in rings.items()]
    return rings, spark.createDataFrame(rows, "id long, geometry string").cache()


GRID = Grid(0, 0, 40, 30, 1, 0.5)


def test_area_and_range(stars):
    rings, f = stars
    got = {r.fid: r for r in coverage(edges(f, "id"), GRID, "P").groupBy("fid").agg(F.sum(F.col("cov").cast("double")).alias("a"), F.min("cov").alias("lo"), F.max("cov").alias("hi")).collect()}
    for i, ring in rings.items():
        assert got[i].a * 0.5 == pytest.approx(abs(signed_area([*ring, ring[0]])), rel=1e-6)
        assert got[i].lo > 0 and got[i].hi <= 1


def test_tiles_agree_with_the_whole(stars):
    _, f = stars
    e = edges(f, "id")
    whole = {(r.fid, r.row, r.col): r.cov for r in coverage(e, GRID, "P").collect()}
    parts = {}
    for r0, c0, rows, cols in ((0, 0, 27, 13), (0, 13, 27, 27), (27, 0, 33, 13), (27, 13, 33, 27)):
        for r in coverage(e, GRID.window(r0, c0, rows, cols), "P").collect():
            parts[r.fid, r.row + r0, r.col + c0] = r.cov
    assert parts.keys() == whole.keys() and all(parts[k] == pytest.approx(whole[k], abs=1e-6) for k in whole)


def test_cut_geometries_have_the_same_areas(stars):
    _, f = stars
    want = {(r.fid, r.row, r.col): r.cov * 0.5 for r in coverage(edges(f, "id"), GRID, "P").collect()}
    got = {(r.id, r.row, r.col): r.area for r in subdivide(f, GRID, "id").collect()}
    assert all(got.get(k, 0.0) == pytest.approx(a, abs=1e-6) for k, a in want.items()) and all(want.get(k, 0.0) == pytest.approx(a, abs=1e-6) for k, a in got.items())


def test_sums_of_parts_merge(spark, stars):
    _, f = stars
    cells = spark.range(GRID.size).select((F.col("id") / GRID.cols).cast("int").alias("row"), (F.col("id") % GRID.cols).cast("int").alias("col"), (F.col("id") % 17).cast("double").alias("value"))
    whole = {r.id: (r["count"], r["sum"]) for r in zonal_stats(from_table(cells, GRID), f, ["count", "sum"], include_cols="id", kinds="P").collect()}
    halves = {}
    for part in (F.col("row") < 30, F.col("row") >= 30):
        for r in zonal_stats(from_table(cells.where(part), GRID), f, ["count", "sum"], include_cols="id", kinds="P").collect():
            a, b = halves.get(r.id, (0.0, 0.0))
            halves[r.id] = (a + r["count"], b + r["sum"])
    assert all(halves[i] == pytest.approx(v) for i, v in whole.items())
