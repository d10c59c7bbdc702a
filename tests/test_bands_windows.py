"""Bands as rows, tiles and user-defined sources and writers."""

import json
from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.functions.descriptors import DescriptorError
from gridloom.functions.grid import Grid
from gridloom.operators import statistics
from gridloom.operators.coverage import coverage
from gridloom.operators.custom import CustomStat
from gridloom.plans import zonal
from gridloom.plans.bands import band_stats, stack, wide
from gridloom.plans.zonal import zonal_stats
from gridloom.shared import numbered, shared_path
from gridloom.sources import output, raster
from gridloom.sources.features import from_pandas
from gridloom.sources.features import from_source as from_feature_source
from gridloom.sources.geometry import edges, to_geojson
from gridloom.sources.windows import ArraySource, from_source, from_xarray
from tests import brute
from tests.test_zonal import GRID, KITE, KITE_CELLS, SHAPES, VALUES, WEIGHTS, features, one
from tests.test_zonal import raster as plain_raster


def cells_table(spark, arrays):
    rows = [(b, r, c, int(a[r, c])) for b, a in enumerate(arrays, 1) for r in range(a.shape[0]) for c in range(a.shape[1])]
    return spark.createDataFrame(rows, "band int, row int, col int, value int")


def test_bands_are_rows(spark):
    arrays = [VALUES + 1, VALUES * 2 % 5, VALUES % 3]
    b = stack(cells_table(spark, arrays), GRID, root="t", nodata=2)
    assert b.count == 3 and b.names == ["t_band_1", "t_band_2", "t_band_3"]
    far = "POLYGON ((50 50, 51 50, 51 51, 50 50))"
    ops = ["count", "mean", "variance", "mode", "weighted_mean", "q=quantile(q=0.3)"]
    f = features(spark, KITE, brute.wkt_of(SHAPES["comb"]), far)
    got = {(r.id, r.band): r for r in band_stats(b, f, ops, plain_raster(spark, WEIGHTS), "id").collect()}
    assert len(got) == 9
    for k, a in enumerate(arrays, 1):
        for i, shape in ((1, "kite"), (2, "comb")):
            shares = brute.polygon_shares(SHAPES[shape], GRID).astype("float32").astype(float)
            keep = (shares > 0) & (a != 2)
            c, x, w = shares[keep], a[keep].astype(float), WEIGHTS[keep]
            want = brute.statistics(x, c, w)
            for s in ("count", "mean", "variance", "mode", "weighted_mean"):
                assert got[i, k][s] == pytest.approx(want[s], rel=1e-6), (i, k, s)
            assert got[i, k].q_30 == int(brute.quantile(x, c, 0.3))
        assert got[3, k]["count"] == 0
    turned = wide(band_stats(b, f, ["count", "min"], None, "id"), b, "id")
    assert turned.columns == ["id", *[f"t_band_{k}_{s}" for k in (1, 2, 3) for s in ("count", "min")]]
    assert {r.id: r.t_band_2_count for r in turned.collect()}[1] == pytest.approx(got[1, 2]["count"])
    one_band = stack(cells_table(spark, arrays[:1]), GRID)
    assert wide(band_stats(one_band, f, "sum", None, "id"), one_band, "id").columns == ["id", "sum"]
    with pytest.raises(DescriptorError):
        stack(cells_table(spark, arrays).where("1 = 0"), GRID)


def test_only_tiles_near_features_are_read(spark):
    t = cells_table(spark, [VALUES]).selectExpr("row", "col", "value", "floor(row / 2) tile_row", "floor(col / 2) tile_col")
    path = shared_path(spark, "t-tiles")
    t.write.partitionBy("tile_row", "tile_col").parquet(path)
    r = raster.from_table(spark.read.parquet(path), GRID, tiles=2)
    box = "POLYGON ((0.5 14.2, 3.5 14.2, 3.5 15.8, 0.5 15.8, 0.5 14.2))"
    f = features(spark, box)
    e = edges(numbered(f, "_n", "t"), "_n")
    near = r.read_near(e)
    # rows 2 and 3 of columns 2 and 3 are one tile
    assert near.cells.select("tile_row", "tile_col").distinct().collect() == [(1, 1)]
    plan = near.cells._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull" in plan or "PartitionFilters: [tile_row" in plan
    assert len(near.cells.inputFiles()) <= len(r.cells.inputFiles())
    got, want = (one(zonal_stats(x, f, ["count", "sum", "values"])) for x in (r, plain_raster(spark)))
    assert got == want
    was = raster.MOST_TILES
    raster.MOST_TILES = 0
    try:
        assert one(zonal_stats(r, f, ["count", "sum", "values"])) == want
    finally:
        raster.MOST_TILES = was


@pytest.mark.parametrize("most", [1_000_000, 0])
def test_large_rasters(spark, monkeypatch, most):
    """Where a raster is large, its cells that no feature covers never leave their task, or all shuffle."""
    monkeypatch.setattr(zonal, "LARGE_RASTER", 1)
    monkeypatch.setattr(zonal, "MOST_CELLS", most)
    path = shared_path(spark, "t-large")
    cells_table(spark, [VALUES]).drop("band").write.parquet(path)
    big = raster.from_parquet(spark, path, GRID, name="v")
    ops = ["count", "sum", "median", "d=count(default_value=1)", "quantile(q=0)", "quantile(q=1)", "quantile(q=0.35)", "mode"]
    f = features(spark, KITE, brute.wkt_of(SHAPES["islands"]))
    got = zonal_stats(big, f, ops, include_cols="id").orderBy("id").collect()
    assert got == zonal_stats(plain_raster(spark), f, ops, include_cols="id").orderBy("id").collect()


def test_window_sources(spark):
    masked = np.ma.masked_equal(VALUES, 3)
    want = one(zonal_stats(plain_raster(spark, masked), features(spark, KITE), ["count", "sum", "values"]))
    for window in (2, 3, 100):
        r = from_source(spark, ArraySource(masked, GRID, "mine"), window)
        assert r.cells.count() == VALUES.size and r.name == "mine" and r.dtype == str(VALUES.dtype)
        assert one(zonal_stats(r, features(spark, KITE), ["count", "sum", "values"])) == want

    class Computed:
        """A user's own source, with a NODATA value and a scale."""

        grid, dtype, nodata, scale = GRID, "float32", 4.0, 0.5

        def read_window(self, row, col, rows, cols):
            return VALUES[row : row + rows, col : col + cols].astype("float32")

    r = one(zonal_stats(from_source(spark, Computed(), 4), features(spark, KITE), ["values"]))
    c = KITE_CELLS > 0
    assert r["values"] == [x * 0.5 for x in VALUES[c & (VALUES != 4)].tolist()]

    class Wrong(Computed):
        def read_window(self, row, col, rows, cols):
            return np.zeros((1, 1))

    with pytest.raises(Exception, match="has the shape"):
        from_source(spark, Wrong(), 4).cells.count()


class FakeArray:
    """As much of a labelled array as the adapter asks for."""

    def __init__(self, values, dims, coords, name=None):
        self.values, self.dims, self.coords, self.name = np.asarray(values), dims, coords, name

    def __getitem__(self, d):
        return SimpleNamespace(values=np.asarray(self.coords[d]))

    def transpose(self, *dims):
        return FakeArray(np.transpose(self.values, [self.dims.index(d) for d in dims]), dims, self.coords, self.name)


def test_labelled_arrays(spark):
    xs, ys = [GRID.x_of(c) for c in range(8)], [GRID.y_of(r) for r in range(6)]
    down = FakeArray(VALUES, ("y", "x"), {"y": ys, "x": xs}, "t")
    (r,) = from_xarray(spark, down)
    assert r.name == "t" and r.grid == GRID
    # y upwards, x first, and two times
    up = FakeArray(np.stack([VALUES[::-1].T, VALUES[::-1].T * 2], axis=1), ("lon", "time", "lat"), {"lat": ys[::-1], "lon": xs, "time": [0, 1]}, "t")
    both = from_xarray(spark, up)
    assert [b.name for b in both] == ["t_band_1", "t_band_2"]
    out = one(zonal_stats(both, features(spark, KITE), "sum"))
    want = one(zonal_stats(plain_raster(spark), features(spark, KITE), "sum")).sum
    assert out.t_band_1_sum == pytest.approx(want) and out.t_band_2_sum == pytest.approx(2 * want)
    several = type("Set", (), {"data_vars": ["a", "b"], "__getitem__": lambda self, n: down})()
    assert [r.name for r in from_xarray(spark, several)] == ["a", "b"]
    with pytest.raises(ValueError, match="more than one dimension"):
        from_xarray(spark, FakeArray(np.zeros((1, 1, 6, 8)), ("a", "b", "y", "x"), {"y": ys, "x": xs}))


def test_variables_and_files(spark, tmp_path):
    t = cells_table(spark, [VALUES]).selectExpr("row", "col", "value a", "value * 2 b")
    names = [r.name for r in raster.from_variables(t, GRID, ["a", "b"], "root")]
    assert names == ["root_a", "root_b"]
    r = one(zonal_stats(raster.from_variables(t, GRID, ["a", "b"]), features(spark, KITE), "sum"))
    assert r.b_sum == pytest.approx(2 * r.a_sum)
    for n in ("one", "two"):
        t.selectExpr("row", "col", "a value").write.parquet(f"{tmp_path}/{n}.parquet")
    many = raster.from_files(spark, [f"{tmp_path}/one.parquet", f"{tmp_path}/two.parquet"], GRID)
    assert [r.name for r in many] == ["one", "two"]
    assert one(zonal_stats(many, features(spark, KITE), "mean")).asDict().keys() == {"one_mean", "two_mean"}
    stacked = cells_table(spark, [VALUES, VALUES * 3])
    assert [r.name for r in raster.from_bands(stacked, GRID)] == ["band_1", "band_2"]
    assert [r.name for r in raster.from_bands(stacked, GRID, "x", only=2)] == ["x"]
    with pytest.raises(ValueError):
        raster.from_bands(stacked, GRID, only=-1)


def test_geojson_of_wkt_and_wkb(spark):
    ring = [*SHAPES["kite"][0][0], SHAPES["kite"][0][0][0]]
    assert json.loads(to_geojson(KITE)) == {"type": "Polygon", "coordinates": [[list(p) for p in ring]]}
    assert json.loads(to_geojson(brute.wkt_of(SHAPES["islands"])))["type"] == "MultiPolygon"
    assert json.loads(to_geojson("LINESTRING (0 0, 1 2)")) == {"type": "LineString", "coordinates": [[0, 0], [1, 2]]}
    assert json.loads(to_geojson("MULTILINESTRING ((0 0, 1 2), (3 3, 4 4))"))["type"] == "MultiLineString" and to_geojson(None) is None
    ready = '{"type": "Point", "coordinates": [1, 2]}'
    df = spark.createDataFrame([(1, KITE, None), (2, ready, bytearray(b"")), (3, None, None)], "id long, g string, w binary")
    rows = {json.loads(r.value)["id"]: json.loads(r.value) for r in output.geojson(df.drop("w"), "g", "id").collect()}
    assert rows[1]["geometry"]["type"] == "Polygon" and rows[2]["geometry"] == json.loads(ready) and rows[3]["geometry"] is None
    import struct

    wkb = struct.pack("<BIII", 1, 3, 1, len(ring)) + b"".join(struct.pack("<2d", *p) for p in ring)
    (r,) = output.geojson(spark.createDataFrame([(bytearray(wkb), 5)], "g binary, n int"), "g").collect()
    assert json.loads(r.value) == {"type": "Feature", "geometry": json.loads(to_geojson(KITE)), "properties": {"n": 5}}


class Boxes:
    """A user's feature source: boxes in a row, every part its share of them."""

    schema = "id long, name string, width double"

    def read(self, part, parts):
        for k in range(part, 7, parts):
            x = -4.0 + 2 * k
            shape = {"type": "Polygon", "coordinates": [[[x, 10.0], [x + 1, 10.0], [x + 1, 19.0], [x, 19.0], [x, 10.0]]]}
            yield {"type": "Feature", "id": k, "properties": {"name": f"box {k}", "width": 1.0}, "geometry": shape if k != 5 else None}


def test_user_defined_features(spark):
    for parts in (1, 3, 20):
        f = from_feature_source(spark, Boxes(), parts)
        assert f.dtypes == [("id", "bigint"), ("name", "string"), ("width", "double"), ("geometry", "string")]
        got = {r.id: r for r in zonal_stats(plain_raster(spark), f, ["count", "sum"], include_cols=["id", "name"]).collect()}
        assert len(got) == 7 and got[5]["count"] == 0 and got[3].name == "box 3"
        for k in (0, 1, 2, 3, 4, 6):
            assert got[k]["count"] == pytest.approx(3.0) and got[k].sum == pytest.approx(VALUES[:, k].sum() / 2)


class FileWriter:
    """A user's writer: a file for each partition."""

    def __init__(self, path):
        self.path, self.rows = path, []

    def write(self, row):
        self.rows.append(row)

    def finish(self):
        with open(self.path, "w") as f:
            json.dump(self.rows, f)


def test_user_defined_writer(spark, tmp_path):
    df = spark.range(10).selectExpr("id", "id * id sq").repartition(3)
    folder = str(tmp_path)
    assert output.to_writer(df, lambda k: FileWriter(f"{folder}/{k}.json")) == 10
    rows = [r for p in tmp_path.iterdir() for r in json.loads(p.read_text())]
    assert sorted(r["sq"] for r in rows) == [i * i for i in range(10)]
    assert output.to_writer(df.where("id < 0"), lambda k: FileWriter(f"{folder}/{k}.json")) == 0


def test_pandas_keeps_an_index(spark):
    import pandas as pd

    frame = pd.DataFrame({"name": ["a", "b"], "geometry": [KITE, None]}, index=[7, 9])
    f = from_pandas(spark, frame, index="key")
    out = output.pandas(zonal_stats(plain_raster(spark), f, "count", include_cols=["key", "name"]), index="key")
    assert sorted(out.index) == [7, 9] and out.loc[9, "count"] == 0 and out.loc[7, "count"] == pytest.approx(KITE_CELLS.sum())


def test_numbers_are_stable_where_rows_move(spark):
    plain = spark.range(10).selectExpr("id", "id * 2 x").where("id > 3")
    assert "_gridloom_path" not in numbered(plain, "n", "t").__dict__
    assert "/t-" not in numbered(plain, "n", "t")._jdf.queryExecution().optimizedPlan().toString()
    moved = numbered(plain.groupBy("x").agg(F.max("id").alias("id")), "n", "t-moved")
    assert any("t-moved" in p for p in moved.inputFiles())
    random = numbered(plain.withColumn("r", F.rand()), "n", "t-moved")
    assert any("t-moved" in p for p in random.inputFiles())
    (cov,) = coverage(edges(features(spark, "POLYGON ((0.1 10.1, 0.2 10.1, 0.2 10.2, 0.1 10.1))"), "id"), GRID).collect()
    assert cov.row == 5


@pytest.mark.parametrize("slices", [2, 3, 64])
def test_quantiles_in_slices(spark, monkeypatch, slices):
    """Where a feature's values go to several tasks, quantiles are the same."""
    monkeypatch.setattr(statistics, "SLICES", slices)
    rng = np.random.default_rng(5)
    rows = [(f, float(x), float(w)) for f, n in ((1, 1), (2, 2), (3, 400), (4, 30)) for x, w in zip(np.unique(rng.normal(size=n).round(3) if f < 4 else rng.exponential(size=n)), rng.random(n) + 0.01)]
    hist = spark.createDataFrame(rows, "fid long, x double, sc double")
    qs = [0.0, 0.1, 0.5, 0.77, 1.0]
    got = {r.fid: [r[f"q{k}"] for k in range(5)] for r in statistics.quantiles(hist, qs, "double", 10).collect()}
    for f in (1, 2, 3, 4):
        x, c = (np.array([r[k] for r in rows if r[0] == f]) for k in (1, 2))
        assert got[f] == pytest.approx([brute.quantile(x, c, q) for q in qs]), f


def spread(values, coverage):
    """Greatest less least value, and the count of cells without one."""
    held = values.compressed()
    return [float(held.max() - held.min()) if len(held) else -1.0, float(np.ma.getmaskarray(values).sum())]


def weighted_most(values, coverage, weights) -> float:
    got = (values * coverage * weights).max()
    return None if got is np.ma.masked else float(got)


def test_bands_share_a_plan(spark):
    """Stacked bands give what rasters of their own give: same columns, names, order and values."""
    # each band lacks other cells: as NODATA, or for want of a row
    table = cells_table(spark, [VALUES + 1, VALUES * 2 % 5, VALUES % 3]).where("(row + 2 * col) % 7 <> band")
    f = features(spark, KITE, brute.wkt_of(SHAPES["comb"]), "POLYGON ((50 50, 51 50, 51 51, 50 50))", "POLYGON ((-1 14, 2.5 14, 2.5 30, -1 14))")
    w = plain_raster(spark, WEIGHTS)
    ops = ["count", "mean", "sum(default_value=9,min_coverage_frac=0.4)", "variance", "weighted_mean", "weighted_sum(default_weight=0)", "quantile(q=0.3)", "min", "values", CustomStat(spread, "array<double>"), weighted_most]
    for mine, weight in ((ops, w), (["count(default_value=9)", "unique", "frac", "min_center_x"], None)):
        want = zonal_stats(raster.from_bands(table, GRID, "t", nodata=2), f, mine, weight, "id", include_geom=True)
        got = zonal_stats(stack(table, GRID, root="t", nodata=2), f, mine, weight, "id", include_geom=True)
        assert got.columns == want.columns and got.dtypes == want.dtypes
        a, b = ({r.id: r.asDict() for r in x.collect()} for x in (got, want))
        assert len(a) == 4 and a.keys() == b.keys()
        for i in a:
            for c in got.columns:
                x, y = a[i][c], b[i][c]
                same = x == y or (isinstance(x, float) and (x == pytest.approx(y, rel=1e-9, nan_ok=True))) or (isinstance(x, list) and x == pytest.approx(y, rel=1e-9, nan_ok=True))
                assert same, (i, c, x, y)
    b = stack(table, GRID, root="t")
    with pytest.raises(DescriptorError, match="single bands|Unknown raster"):
        zonal_stats(b, f, "mean(t_band_2)", None, "id")
    with pytest.raises(DescriptorError, match="not unique"):
        zonal_stats(b, f, "x=mean", None, "id")
    with pytest.raises(DescriptorError, match="one weight raster"):
        zonal_stats(b, f, "weighted_mean", [w.named("a"), w.named("b")], "id")


def test_one_plan_for_any_count_of_bands(spark):
    table = spark.range(0, 64 * 40, 1, 4).selectExpr("cast(id % 40 + 1 as int) band", "cast(id / 40 % 8 as int) row", "cast(id / 320 as int) col", "cast(id as int) value")
    joins = []
    for n in (2, 40):
        got = zonal_stats(stack(table.where(f"band <= {n}"), Grid(0, 0, 8, 8, 1, 1), n), features(spark, "POLYGON ((1 1, 6 1, 3 7, 1 1))"), ["mean", "max"], None, "id")
        joins.append(got._jdf.queryExecution().optimizedPlan().toString().count("Join "))
        assert got.columns == ["id", *[f"band_{b}_{s}" for s in ("mean", "max") for b in range(1, n + 1)]]
        assert got.first().band_2_max - got.first().band_1_max == 1
    assert joins[0] == joins[1]
