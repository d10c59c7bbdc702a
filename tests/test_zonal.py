"""Coverage and statistics against a computation from first principles."""

import json
import math
import struct
import warnings

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.functions.descriptors import DescriptorError, Request
from gridloom.functions.grid import Box, Grid, IncompatibleGrids
from gridloom.operators.coverage import coverage
from gridloom.operators.custom import CustomStat
from gridloom.plans.zonal import coverage_table, zonal_stats
from gridloom.sources.geometry import edges
from gridloom.sources.raster import from_array
from tests import brute

#: A grid of 6 x 8 cells of 2 x 1.5 map units, values and weights on it.
GRID = Grid(-4.0, 10.0, 12.0, 19.0, 2.0, 1.5)
VALUES = np.array([[(7 * r + 3 * c * c) % 11 - 2 for c in range(8)] for r in range(6)])
WEIGHTS = np.array([[(r * 5 + c * 2) % 7 / 4 for c in range(8)] for r in range(6)])

#: Own shapes: each a list of polygons, a polygon a list of rings.
SHAPES = {
    "kite": [[[(-1.3, 12.1), (4.4, 10.7), (7.9, 14.9), (3.1, 18.6)]]],
    "comb": [[[(-3.5, 10.2), (11.5, 10.2), (11.5, 18.8), (9.7, 18.8), (9.7, 11.9), (5.3, 11.9), (5.3, 17.2), (3.9, 17.2), (3.9, 11.1), (-2.2, 11.1), (-2.2, 18.1), (-3.5, 18.1)]]],
    "window": [[[(-2.0, 11.5), (8.0, 11.5), (8.0, 17.5), (-2.0, 17.5)], [(0.0, 13.0), (0.0, 16.0), (4.0, 16.0), (4.0, 13.0)], [(4.7, 14.0), (6.9, 14.2), (5.5, 16.8)]]],
    "islands": [[[(-3.9, 10.1), (-2.5, 10.4), (-3.0, 11.3)]], [[(6.1, 15.1), (11.9, 15.3), (9.0, 18.9)]], [[(0.25, 13.25), (1.75, 13.25), (1.75, 14.25), (0.25, 14.25)]]],
    "reversed": [[[(3.1, 18.6), (7.9, 14.9), (4.4, 10.7), (-1.3, 12.1)]]],
    "on the lines": [[[(0.0, 11.5), (6.0, 11.5), (6.0, 14.5), (2.0, 14.5), (2.0, 17.5), (0.0, 17.5)]]],
    "speck": [[[(2.21, 13.37), (2.24, 13.37), (2.22, 13.41)]]],
    "over the edge": [[[(-9.0, 8.0), (2.7, 8.0), (2.7, 15.2), (-9.0, 15.2)]]],
    "needle": [[[(-4.0, 10.0), (12.0, 19.0), (11.9, 19.0)]]],
}
LINES = {"zigzag": [(-3.3, 10.4), (1.1, 17.9), (5.9, 10.9), (13.0, 16.2)], "far": [(-20.0, 12.0), (30.0, 12.2)]}
KITE, KITE_CELLS = brute.wkt_of(SHAPES["kite"]), brute.polygon_shares(SHAPES["kite"], GRID)
BOX = Box(GRID.xmin, GRID.ymin, GRID.xmax, GRID.ymax)


def features(spark, *wkt):
    return spark.createDataFrame([(i, w) for i, w in enumerate(wkt, 1)], "id long, geometry string").coalesce(1)


def raster(spark, array=VALUES, box=BOX, **kw):
    return from_array(spark, array, box, **kw)


def one(df):
    (row,) = df.collect()
    return row


def seen(shares, *arrays, where=True):
    """Cells that count, row by row: coverage in single precision, and the arrays there."""
    c = shares.astype("float32").astype(float)
    keep = (c > 0) & where
    return [c[keep], *(a[keep] for a in arrays)]


def test_coverage_of_own_shapes(spark):
    names = [*SHAPES, *LINES]
    shapes = {n: brute.wkt_of(p) for n, p in SHAPES.items()} | {n: "LINESTRING (" + ", ".join(f"{x} {y}" for x, y in p) + ")" for n, p in LINES.items()}
    f = features(spark, *shapes.values())
    got = {n: np.zeros((GRID.rows, GRID.cols)) for n in names}
    for r in coverage(edges(f, "id"), GRID).collect():
        got[names[r.fid - 1]][r.row, r.col] += r.cov
    for n in names:
        want = brute.polygon_shares(SHAPES[n], GRID) if n in SHAPES else brute.line_lengths(LINES[n], GRID)
        np.testing.assert_allclose(got[n], want, atol=1e-6, err_msg=n)
    collection = "GEOMETRYCOLLECTION (" + ", ".join(brute.wkt_of([p]) for p in SHAPES["islands"][:1]) + ", " + brute.wkt_of(SHAPES["islands"][1:]) + ")"
    whole = coverage(edges(features(spark, collection), "id"), GRID).collect()
    assert sum(r.cov for r in whole) == pytest.approx(got["islands"].sum(), abs=1e-5)
    flat = coverage(edges(features(spark, "POLYGON ((0 11, 6 15, 0 11))"), "id"), GRID)
    assert flat.collect() == []
    coarse = Grid(-100.0, -100.0, 100.0, 100.0, 200.0, 200.0)
    (r,) = coverage(edges(features(spark, KITE), "id"), coarse).collect()
    assert r.cov == pytest.approx(KITE_CELLS.sum() * 3 / 40_000, rel=1e-6)


SCALARS = ["count", "sum", "mean", "min", "max", "mode", "minority", "variety", "variance", "stdev", "coefficient_of_variation"]
LISTS = ["values", "coverage", "unique", "frac"]
PLACES = ["center_x", "center_y", "cell_id", "min_center_x", "min_center_y", "max_center_x", "max_center_y"]


@pytest.mark.parametrize("kind", ["int32", "float64"])
@pytest.mark.parametrize("shape", ["kite", "window", "comb"])
def test_every_statistic(spark, kind, shape):
    ops = [*SCALARS, *LISTS, *PLACES, "majority", "median", "quantile(q=0.25)", "q=quantile(q=0.8)", "count_of(v=4)", "frac_of(v=4)"]
    r = one(zonal_stats(raster(spark, VALUES.astype(kind)), features(spark, brute.wkt_of(SHAPES[shape])), ops, include_cols="id"))
    assert list(r.asDict())[0] == "id" and len(r) == len(ops) + 1
    rows, cols = np.indices(VALUES.shape)
    c, x, row, col = seen(brute.polygon_shares(SHAPES[shape], GRID), VALUES.astype(float), rows, cols)
    want = brute.statistics(x, c)
    for s in SCALARS + LISTS:
        assert r[s] == pytest.approx(want[s], rel=1e-6, abs=1e-6), s
    assert r.majority == r.mode
    for name, q in (("median", 0.5), ("quantile_25", 0.25), ("q_80", 0.8)):
        exact = brute.quantile(x, c, q)
        assert r[name] == (math.trunc(exact) if kind == "int32" else pytest.approx(exact, abs=1e-6))
    assert r.count_of == pytest.approx(c[x == 4].sum()) and r.frac_of == pytest.approx(c[x == 4].sum() / c.sum())
    cx, cy = -4 + 2 * (col + 0.5), 19 - 1.5 * (row + 0.5)
    assert (r.center_x, r.center_y, r.cell_id) == (cx.tolist(), cy.tolist(), (row * 8 + col).tolist())
    low, high = int(x.argmin()), int(x.argmax())
    assert (r.min_center_x, r.min_center_y, r.max_center_x, r.max_center_y) == (cx[low], cy[low], cx[high], cy[high])
    assert isinstance(r["values"][0], int if kind == "int32" else float)


WEIGHTED = ["weighted_sum", "weighted_mean", "weighted_variance", "weighted_stdev", "weighted_fraction", "weighted_count", "weights", "weighted_frac"]


def test_weights(spark):
    w = raster(spark, WEIGHTS, name="w")
    r = one(zonal_stats(raster(spark), features(spark, KITE), [*WEIGHTED, "mean"], weights=w))
    c, x, ws = seen(KITE_CELLS, VALUES.astype(float), WEIGHTS)
    want = brute.statistics(x, c, ws)
    for s in (*WEIGHTED, "mean"):
        assert r[s] == pytest.approx(want[s], rel=1e-6, abs=1e-9), s
    holes = raster(spark, np.ma.masked_where(WEIGHTS == 0.75, WEIGHTS), name="w")
    r = one(zonal_stats(raster(spark), features(spark, KITE), ["weighted_mean", "m=weighted_mean(default_weight=3)"], weights=holes))
    want = brute.statistics(x, c, np.where(ws == 0.75, 3.0, ws))
    assert math.isnan(r.weighted_mean) and r.m == pytest.approx(want["weighted_mean"])


def test_coverage_options(spark):
    r = one(zonal_stats(raster(spark), features(spark, KITE), ["n=count(coverage_weight=none)", "m=mean(coverage_weight=none)", "cell_id(min_coverage_frac=0.6)", "k=count(min_coverage_frac=0.6)", "area=count(coverage_weight=area_cartesian)"]))
    c, x = seen(KITE_CELLS, VALUES.astype(float))
    assert (r.n, r.m) == (len(c), pytest.approx(x.mean()))
    assert r.cell_id == np.flatnonzero(KITE_CELLS >= 0.6).tolist() and r.k == pytest.approx(KITE_CELLS[KITE_CELLS >= 0.6].sum())
    assert r.area == pytest.approx(KITE_CELLS.sum() * 3, rel=1e-6)
    # a cap of the sphere between two parallels
    globe = from_array(spark, np.ones((2, 3)), Box(0, 20, 90, 60))
    r = one(zonal_stats(globe, features(spark, "POLYGON ((0 20, 90 20, 90 60, 0 60, 0 20))"), ["a=sum(coverage_weight=area_spherical_m2)", "b=sum(coverage_weight=area_spherical_km2)"]))
    whole = 6378137.0**2 * math.pi / 2 * (math.sin(math.radians(60)) - math.sin(math.radians(20)))
    assert r.a == pytest.approx(whole, rel=1e-5) and r.b == pytest.approx(whole / 1e6, rel=1e-5)


def test_empty_results(spark):
    names = ["count", "sum", "mean", "variance", "variety", "mode", "min", "median", "unique", "values", "frac", "min_center_x"]
    r = one(zonal_stats(raster(spark, np.full((6, 8), -9), nodata=-9), features(spark, KITE), names))
    assert (r["count"], r["sum"], r.variety, r.mode, r["min"], r.median) == (0, 0, 0, None, None, None)
    assert math.isnan(r.mean) and math.isnan(r.variance) and math.isnan(r.min_center_x) and (r.unique, r["values"], r.frac) == ([], [], [])
    rows = zonal_stats(raster(spark), features(spark, KITE, "POLYGON ((100 100, 101 100, 101 101, 100 100))", "POLYGON ((11 10, 90 10, 90 11.5, 11 11.5, 11 10))", None), ["count", "median", "mean"], include_cols=["id"]).collect()
    got = {r.id: r for r in rows}
    assert got[2]["count"] == 0 and got[2].median is None and math.isnan(got[2].mean)
    assert (got[3]["count"], got[3].median) == (0.5, VALUES[5, 7]) and got[4]["count"] == 0


def test_nodata_scale_mask_default(spark):
    a = np.where(VALUES % 4 == 0, -999, VALUES).astype("int16")
    c, x = seen(KITE_CELLS, a.astype(float), where=a != -999)
    gone = seen(KITE_CELLS, where=a == -999)[0].sum()
    r = one(zonal_stats(raster(spark, a, nodata=-999), features(spark, KITE), ["count", "sum", "d=sum(default_value=100)", "n=count(default_value=0)"]))
    assert (r["count"], r.n) == (pytest.approx(c.sum()), pytest.approx(KITE_CELLS.sum()))
    assert r["sum"] == pytest.approx((x * c).sum(), abs=1e-6) and r.d == pytest.approx((x * c).sum() + 100 * gone, rel=1e-6)
    r = one(zonal_stats(raster(spark, a, nodata=-999, scale=2.5, offset=-1.0), features(spark, KITE), ["values"]))
    assert r["values"] == (x * 2.5 - 1).tolist()
    r = one(zonal_stats(raster(spark, a, mask=a > 4), features(spark, KITE), ["values"]))
    assert r["values"] == seen(KITE_CELLS, a, where=a > 4)[1].tolist()
    strip = features(spark, "POLYGON ((0 0, 2 0, 2 1, 0 1, 0 0))")
    r = one(zonal_stats(from_array(spark, np.array([[3, 255]], "uint8"), nodata=-1), strip, ["max"]))
    assert r["max"] == 255
    big = np.array([[2**53 + 1, 2**53 + 3]], "int64")
    r = one(zonal_stats(from_array(spark, big), strip, ["values", "max"]))
    assert r["values"] == big[0].tolist() and r["max"] == 2**53 + 3
    with pytest.raises(DescriptorError, match="out of range"):
        zonal_stats(raster(spark, a), features(spark, KITE), "sum(default_value=40000)")


def test_two_resolutions(spark):
    coarse = np.array([[1.0, 2, 5, 7], [3, 4, 6, 8]])
    v, w = raster(spark, VALUES.astype(float), name="v"), raster(spark, coarse, name="w")
    c, x, k = seen(KITE_CELLS, VALUES.astype(float), np.kron(coarse, np.ones((3, 2))))
    r = one(zonal_stats(v, features(spark, KITE), ["weighted_mean", "weights", "cell_id"], weights=w))
    assert r.weighted_mean == pytest.approx((x * c * k).sum() / (c * k).sum()) and r.weights == k.tolist()
    r = one(zonal_stats([w.named("a"), v.named("b")], features(spark, KITE), ["count", "sum", "cell_id"]))
    assert r.a_count == r.b_count == pytest.approx(KITE_CELLS.sum()) and r.a_sum == pytest.approx((c * k).sum())
    rows, cols = (i[KITE_CELLS > 0] for i in np.indices(VALUES.shape))
    assert r.a_cell_id == (rows // 3 * 4 + cols // 2).tolist() and r.b_cell_id == (rows * 8 + cols).tolist()
    part = from_array(spark, np.ones((2, 2)), Box(0, 16, 4, 19), name="w")
    r = one(zonal_stats(v, features(spark, KITE), ["weighted_sum(default_weight=0)", "count"], weights=part))
    inside = np.zeros_like(KITE_CELLS)
    inside[:2, 2:4] = 1
    assert r.weighted_sum == pytest.approx((VALUES * KITE_CELLS * inside).sum(), abs=1e-6) and r["count"] == pytest.approx(KITE_CELLS.sum())
    with pytest.raises(IncompatibleGrids):
        zonal_stats(v, features(spark, KITE), "weighted_mean", weights=raster(spark, np.ones((5, 5)), name="w"))


def test_lines(spark):
    line = LINES["zigzag"]
    r = one(zonal_stats(raster(spark), features(spark, "LINESTRING (" + ", ".join(f"{x} {y}" for x, y in line) + ")"), ["count", "mean"]))
    c, x = seen(brute.line_lengths(line, GRID), VALUES.astype(float))
    assert r["count"] == pytest.approx(c.sum(), rel=1e-6) and r.mean == pytest.approx((x * c).sum() / c.sum(), rel=1e-5)


def test_geometry_errors(spark):
    for wkt, text in (("POINT (0 0)", "Unsupported geometry type"), ("GEOMETRYCOLLECTION (POLYGON ((0 0, 1 0, 1 1, 0 0)), LINESTRING (0 0, 1 1))", "Mixed-type"), ("POLYGON EMPTY", "empty"), ("nonsense", "parse")):
        with pytest.raises(Exception, match=text):
            zonal_stats(raster(spark), features(spark, wkt), "count").collect()


def test_wkb_and_geojson(spark):
    ring = [*SHAPES["kite"][0][0], SHAPES["kite"][0][0][0]]
    mean = one(zonal_stats(raster(spark), features(spark, KITE), "mean")).mean
    for order, mark in (("<", 1), (">", 0)):
        wkb = struct.pack(f"{order}BIII", mark, 3, 1, len(ring)) + b"".join(struct.pack(f"{order}2d", *p) for p in ring)
        f = spark.createDataFrame([(1, bytearray(wkb))], "id long, geometry binary")
        assert one(zonal_stats(raster(spark), f, "mean")).mean == mean
    text = json.dumps({"type": "Polygon", "coordinates": [ring]})
    assert one(zonal_stats(raster(spark), features(spark, text), "mean")).mean == mean


def test_user_functions(spark):
    def weighted(values, cov, w) -> float:
        return float((values * cov * w).sum())

    def biggest(values, cov) -> int:
        return int(values.max())

    def label(values, cov) -> str:
        return f"{len(values)} cells"

    def doubled(values, cov) -> np.ndarray:
        return 2.0 * values.filled(0)

    a = np.where(VALUES == 4, -99, VALUES)
    c, x, ws = seen(KITE_CELLS, a.astype(float), WEIGHTS)
    ok = x != -99
    w = raster(spark, WEIGHTS, name="w")
    ops = [weighted, biggest, label, doubled, "mean", CustomStat(lambda v, c: int(v.mask.sum()), "long", "missing")]
    r = one(zonal_stats(raster(spark, a, nodata=-99), features(spark, KITE), ops, weights=w))
    assert (r.biggest, r.missing, r.label) == (x.max(), (~ok).sum(), f"{len(x)} cells") and r.weighted == pytest.approx((x * c * ws)[ok].sum())
    assert r.doubled == np.where(ok, 2 * x, 0).tolist()
    assert dict(zonal_stats(raster(spark), features(spark, KITE), [biggest, label]).dtypes) == {"biggest": "bigint", "label": "string"}
    with pytest.raises(ValueError, match="2 or 3 arguments"):
        CustomStat(lambda a: 1)
    with pytest.raises(DescriptorError, match="No weights provided"):
        zonal_stats(raster(spark), features(spark, KITE), weighted)
    with pytest.raises(Exception, match="Unhandled type"):
        zonal_stats(raster(spark), features(spark, KITE), CustomStat(lambda v, c: {1: 2}, name="bad")).collect()
    gone = one(zonal_stats(raster(spark), features(spark, "POLYGON ((50 50, 51 50, 51 51, 50 50))"), biggest))
    assert gone.biggest is None
    named = one(zonal_stats([raster(spark, name="a"), raster(spark, name="b")], features(spark, KITE), biggest))
    assert list(named.asDict()) == ["a_biggest", "b_biggest"]


def test_cells_table_and_requests(spark):
    rows = coverage_table(raster(spark), features(spark, KITE), "id").orderBy("row", "col").collect()
    c, x = seen(KITE_CELLS, VALUES)
    assert [r.cell_id for r in rows] == np.flatnonzero(KITE_CELLS > 0).tolist() and [r.value for r in rows] == x.tolist()
    assert [r.coverage for r in rows] == pytest.approx(c.tolist())
    r = one(zonal_stats(raster(spark, name="v"), features(spark, KITE), [Request("mean", "m", "v"), "count"]))
    assert (r.m, r["count"]) == (pytest.approx((x * c).sum() / c.sum()), pytest.approx(c.sum()))
    # requests that hold their rasters need no others
    own = Request("weighted_mean", "mine", raster(spark), raster(spark, WEIGHTS))
    r = one(zonal_stats(None, features(spark, KITE), own))
    want = brute.statistics(x.astype(float), c, seen(KITE_CELLS, WEIGHTS)[1])
    assert r.mine == pytest.approx(want["weighted_mean"])
    r = one(zonal_stats(raster(spark, name="v"), features(spark, KITE), ["mean", Request("mean", "again", raster(spark))]))
    assert r.mean == r.again
    with pytest.raises(DescriptorError, match="No rasters"):
        zonal_stats(None, features(spark, KITE), "mean")


def test_shares_as_maps(spark):
    w = raster(spark, WEIGHTS, name="w")
    far = "POLYGON ((50 50, 51 50, 51 51, 50 50))"
    rows = zonal_stats(raster(spark), features(spark, KITE, far), ["frac(min_coverage_frac=0.5)", "weighted_frac", "all=frac"], weights=w, frac_as_map=True, include_cols="id").collect()
    got = {r.id: r for r in rows}
    c, x, ws = seen(KITE_CELLS, VALUES, WEIGHTS)
    want = brute.statistics(x.astype(float), c, ws)
    assert list(got[1].asDict()) == ["id", "frac", "weighted_frac", "all"]
    assert got[1].all == pytest.approx(dict(zip(want["unique"], want["frac"]))) and got[1].weighted_frac == pytest.approx(dict(zip(want["unique"], want["weighted_frac"])))
    half = brute.statistics(x[c >= 0.5].astype(float), c[c >= 0.5])
    assert got[1].frac == pytest.approx(dict(zip(half["unique"], half["frac"]))) and got[2].frac == {} == got[2].all
    r = one(zonal_stats(raster(spark), features(spark, KITE), ["frac", "unique"], frac_as_map=True))
    assert r.unique == want["unique"] and sorted(r.frac) == want["unique"]
    two = zonal_stats([raster(spark, name="a"), raster(spark, name="b")], features(spark, KITE), "frac", frac_as_map=True)
    assert two.columns == ["a_frac", "b_frac"]


def test_features_that_were_shuffled_keep_their_own_results(spark):
    """Grouped features, in partitions so small that adaptive execution merges each branch's in its own way."""
    was = {k: spark.conf.get(k, None) for k in ("spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.parallelismFirst")}
    for k, v in zip(was, ("32k", "64", "false")):
        spark.conf.set(k, v)
    try:
        n = 3000
        box = F.format_string("POLYGON ((%d 0, %d 0, %d 1, %d 1, %d 0))", *[F.col("id") + k for k in (0, 1, 1, 0, 0)])
        rows = spark.range(2 * n).select((F.col("id") % n).alias("id")).select("id", box.alias("geometry"), F.repeat(F.lit("wide "), 20).alias("other"))
        f = rows.groupBy("id").agg(F.first("geometry").alias("geometry"), F.first("other").alias("other"))
        r = from_array(spark, np.arange(n)[None, :])
        got = zonal_stats(r, f, ["mean", "variance"], include_cols=["id", "other"]).collect()
        assert len(got) == n and all(x.mean == x.id for x in got)
    finally:
        for k, v in was.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_clashing_names(spark):
    f = features(spark, KITE).selectExpr("id as _fid", "geometry", "id as mean", "7 as _f", "8 as v0")
    r = one(zonal_stats(raster(spark), f, ["count"], include_cols=["_fid", "_f", "mean", "v0"]))
    assert (r._fid, r._f, r.mean, r.v0) == (1, 7, 1, 8) and r["count"] == pytest.approx(KITE_CELLS.sum())
    with pytest.raises(DescriptorError, match="not unique: mean"):
        zonal_stats(raster(spark), f, ["mean"], include_cols="mean")


def test_many_passes_read_one_join(spark):
    df = zonal_stats(raster(spark), features(spark, KITE), ["mean", "variance", "median", "mode", "values", "frac_of(v=4)"])
    plan = df._jdf.queryExecution().executedPlan().toString()
    # the joins with the raster were done before, once
    assert "MapInArrow" not in plan and "zs-cells" in plan


def test_crs_warning(spark):
    with pytest.warns(UserWarning, match="does not exactly match raster"):
        zonal_stats(raster(spark, srs="EPSG:4326"), features(spark, KITE), "count", features_srs="EPSG:32618")
    with warnings.catch_warnings():
        warnings.simplefilter("error")
        zonal_stats(raster(spark), features(spark, KITE), "count", features_srs="EPSG:32618")


def test_quantiles_with_equal_weights(spark):
    # equal weights of distinct values give the common definition, by interpolation between order statistics
    x = np.array([2.5, 3.0, 7.25, 8.0, 11.0, 11.5])
    qs = [0, 0.15, 0.5, 0.9, 1]
    r = one(zonal_stats(from_array(spark, x[None, :]), features(spark, "POLYGON ((0 0, 6 0, 6 1, 0 1, 0 0))"), [f"x{i}=quantile(q={q})" for i, q in enumerate(qs)]))
    assert [v for v in r] == pytest.approx(np.quantile(x, qs).tolist())
