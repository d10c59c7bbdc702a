"""Rectangles against the sweep, and polygons that several tasks cut."""

import random

import duckdb
import numpy as np
from pyspark.sql import functions as F

from gridloom.functions.grid import Grid
from gridloom.operators import subdivide as sd
from gridloom.operators.coverage import coverage, polygon_coverage, touched
from gridloom.operators.subdivide import pieces, rectangle, subdivide
from gridloom.plans import registry
from gridloom.sources.geometry import edges, edges_of
from tests.test_runs import blob, features_of, polygon


def test_rectangles_equal_the_sweep(spark):
    rng, grid = random.Random(1), Grid(-3.0, 2.0, 17.0, 12.0, 0.5, 2.0)
    boxes = [(a, b, a + rng.uniform(0.01, 25), b + rng.uniform(0.01, 15)) for a, b in ((rng.uniform(-10, 20), rng.uniform(-5, 15)) for _ in range(60))]
    boxes += [(0, 4, 1, 6), (0.25, 4.5, 0.3, 5), (-3, 2, 17, 12), (-100, -100, 100, 100), (17, 2, 18, 3), (-3, 12, 0, 13)]
    turned = [polygon([(a, b), (a, d), (c, d), (c, b)][::rng.choice([1, -1])]) for a, b, c, d in boxes]
    f = features_of(spark, turned)
    e = edges(f, "id")
    assert {r.kind for r in e.select("kind").distinct().collect()} == {"R"} and e.count() == len(boxes)
    four = spark.createDataFrame([(i, *x) for i, t in enumerate(turned) for x in edges_of(t)], "fid long, kind string, sg double, x0 double, y0 double, x1 double, y1 double")
    want = {(r.fid, r.row, r.col): r.cov for r in polygon_coverage(four, grid).collect()}
    runs = coverage(e, grid, "P")
    got = {(r.fid, r.row, r.col): r.cov for r in runs.collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-6 for k in want)
    # nothing is shuffled for them
    assert "Exchange" not in coverage(e, grid, "P", {"R"})._jdf.queryExecution().executedPlan().toString()
    met = {(r.fid, r.row, c) for r in touched(e, grid, "P").collect() for c in range(r.first, r.last + 1)}
    assert want.keys() <= met


def test_other_shapes_stay_polygons(spark):
    shapes = [polygon([(0, 0), (2, 0), (2, 2), (0, 2)], [(0.5, 0.5), (1, 0.5), (1, 1)]), polygon([(0, 0), (2, 0), (2, 2)]), polygon([(0, 0), (2, 0), (2, 2), (1, 2)]), "MULTIPOLYGON (((0 0, 1 0, 1 1, 0 1, 0 0)), ((2 2, 3 2, 3 3, 2 3, 2 2)))", "POLYGON ((0 0, 2 2, 2 0, 0 2, 0 0))", "LINESTRING (0 0, 1 0, 1 1, 0 1, 0 0)"]
    kinds = {(r.fid, r.kind) for r in edges(features_of(spark, shapes), "id").collect()}
    assert kinds == {(i, "L" if i == 5 else "P") for i in range(6)}


def test_large_polygons_are_cut_by_many_tasks(spark):
    rng, grid = random.Random(2), Grid(0.0, 0.0, 120.0, 90.0, 1.0, 1.0)
    shapes = [polygon(blob(rng, 60, 45, 58), [(55, 40), (65, 40), (65, 50), (55, 50)]), polygon(blob(rng, 20, 20, 15)), None, polygon([(200, 200), (201, 200), (201, 201)]), "MULTIPOLYGON (((1 1, 4 1, 4 3, 1 1)), ((100 80, 119 80, 119 89.5, 100 80)))"]
    f = features_of(spark, shapes)
    want = {(i, r, c): area for i, s in enumerate(shapes) if s for r, c, area, _ in pieces(s, grid)}
    cut = subdivide(f, grid, "id", most_cells=100)
    got = cut.withColumn("task", F.spark_partition_id()).collect()
    areas = {(r.id, r.row, r.col): r.area for r in got}
    assert areas.keys() == want.keys() and len(got) == len(areas) and all(np.isclose(areas[k], want[k], rtol=1e-9) for k in want)
    assert len({r.task for r in got if r.id == 0}) > 8
    cov = {(r.fid, r.row, r.col): r.cov for r in coverage(edges(f, "id"), grid, "P").collect()}
    assert cov.keys() == areas.keys() and all(abs(cov[k] - areas[k]) < 1e-6 for k in cov)


def test_areas_equal_the_sql_to_the_last_place(spark):
    """Areas half-way between two sixth places are rounded as coverage in single precision is."""
    sf_dir = "/root/testdata/sf0.01"
    sql = registry.ORACLES["subdivide_wide"]
    for t in ("part", "supplier", "customer"):
        sql = sql.replace(f"FROM {t}", f"FROM '{sf_dir}/{t}.parquet'")
    want = duckdb.sql(sql).fetchall()
    got = [tuple(r) for r in registry.QUERIES["subdivide_wide"](spark, sf_dir).collect()]
    assert sorted(got) == sorted(want)


def test_cells_within_a_polygon_need_no_clipping(spark, monkeypatch):
    """What is left in a box as one rectangle, and a hole that takes all of a box, are not halved on."""
    calls = []
    clip = sd.clip
    monkeypatch.setattr(sd, "clip", lambda *a: calls.append(1) or clip(*a))
    grid = Grid(0.0, 0.0, 200.0, 100.0, 1.0, 0.5)
    hole = polygon([(0.5, 0.5), (199.5, 0.5), (199.5, 99.75), (0.5, 99.75)], [(20.25, 20), (170, 20), (170, 80.3), (20.25, 80.3)])
    got = list(pieces(hole, grid))
    assert len(calls) < 20 * 4 * (400 + 600)  # some twenty for each cell of the outline, of 40000 cells
    cov = {(r.row, r.col): r.cov for r in coverage(edges(features_of(spark, [hole]), "id"), grid, "P").collect()}
    assert cov.keys() == {(r, c) for r, c, _, _ in got} and all(abs(cov[r, c] - area / 0.5) < 1e-6 for r, c, area, _ in got)
    calls.clear()
    assert len(list(pieces(polygon([(0.5, 0.5), (199.5, 0.5), (199.5, 99.75), (0.5, 99.75)]), grid))) == 200 * 199 and len(calls) <= 4
    assert list(pieces(polygon([(300, 300), (301, 300), (301, 301)]), grid)) == []


def test_rectangles_with_points_on_their_sides():
    box = [(0, 0), (3, 0), (3, 2), (0, 2)]
    for ring in (box, box[::-1], [(1, 0), *box[1:], (0, 0)], [(0, 0), (0, 0), (1, 0), (3, 0), (3, 0), (3, 1), (3, 2), (2, 2), (0, 2), (0, 1)], [*box, (0, 3), (0, 1)], [(0, 1), (0, 0), (0, 0), *box[1:], (0, 2)]):
        assert rectangle(ring) == (0, 0, 3, 2), ring
    for ring in ([(0, 0), (3, 0), (3, 2)], [(0, 0), (3, 0), (3, 2), (0, 1)], [(0, 0), (3, 0), (3, 1), (2, 1), (2, 2), (0, 2)], [(0, 0), (3, 2), (3, 0), (0, 2)]):
        assert rectangle(ring) is None, ring
    grid = Grid(0.0, 0.0, 3.0, 2.0, 1.0, 1.0)
    (one,) = pieces(polygon([(0.25, 0.5), (0.75, 0.5), (0.75, 1.0), (0.25, 1.0)]), grid)
    assert one == (1, 0, 0.25, "POLYGON ((0.25 0.5, 0.75 0.5, 0.75 1.0, 0.25 1.0, 0.25 0.5))")
