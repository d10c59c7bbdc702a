"""Sinks, feature sources, cutting, command line and stream."""

import json

import numpy as np
import pandas as pd
import pytest

from gridloom import cli
from gridloom.functions.grid import Grid
from gridloom.operators.subdivide import bands, pieces, subdivide
from gridloom.plans.progress import watched
from gridloom.plans.zonal import zonal_stats
from gridloom.sources import features, output
from gridloom.sources.raster import from_array
from gridloom.streaming.zones import stream_zonal_stats
from tests import brute

SQUARE = "POLYGON ((0.5 0.5, 2.5 0.5, 2.5 2.5, 0.5 2.5, 0.5 0.5))"


@pytest.fixture(scope="module")
def result(spark):
    f = spark.createDataFrame([(1, SQUARE), (2, "POLYGON ((9 9, 10 9, 10 10, 9 9))")], "id int, geometry string")
    return zonal_stats(from_array(spark, np.array([[1] * 3, [2] * 3, [3] * 3])), f, ["unique", "frac", "count"], include_cols="id").cache()


def test_unnest(spark, result):
    rows = [tuple(r) for r in output.unnest(result).collect()]
    assert sorted(rows) == [(1, 1, 0.25, 4.0), (1, 2, 0.5, 4.0), (1, 3, 0.25, 4.0)]
    odd = spark.createDataFrame([(1, [1, 2], [1])], "id int, a array<int>, b array<int>")
    with pytest.raises(Exception, match="different lengths"):
        output.unnest(odd).collect()


def test_maps_records_and_files(spark, result, tmp_path):
    m = output.map_fields(result, {"share": ("unique", "frac")}).orderBy("id").collect()
    assert m[0].share == {1: 0.25, 2: 0.5, 3: 0.25} and m[1].share == {}
    f = output.records(result.orderBy("id"), "list", identity="id")
    assert f[0] == {"type": "Feature", "id": 1, "properties": {"unique": [1, 2, 3], "frac": [0.25, 0.5, 0.25], "count": 4.0}}
    assert output.records(result.where("id=1"), "set")[0]["properties"]["unique"] == {1, 2, 3}
    output.write(result, f"{tmp_path}/x.csv")
    assert spark.read.option("header", True).csv(f"{tmp_path}/x.csv").count() == 3
    output.write(result, f"{tmp_path}/x.parquet", nested=True)
    assert spark.read.parquet(f"{tmp_path}/x.parquet").count() == 2
    output.write(result, f"{tmp_path}/x.geojson", nested=True)
    got = [json.loads(r.value) for r in spark.read.text(f"{tmp_path}/x.geojson").collect()]
    assert {g["properties"]["count"] for g in got} == {4.0, 0.0}
    with pytest.raises(ValueError, match="Unknown output format"):
        output.write(result, f"{tmp_path}/x.xyz")
    assert output.with_id(result, "id", "key", "text").columns[0] == "key"
    with pytest.raises(ValueError):
        output.with_id(result, "id", "key")


def test_feature_sources(spark, tmp_path):
    one = {"type": "Feature", "id": 7, "properties": {"name": "a"}, "geometry": {"type": "Polygon", "coordinates": [[[0.5, 0.5], [2.5, 0.5], [2.5, 2.5], [0.5, 2.5], [0.5, 0.5]]]}}
    (tmp_path / "f.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": [one]}, indent=1))
    r = from_array(spark, np.arange(1, 10).reshape(3, 3))
    for f in (features.read(spark, f"{tmp_path}/f.geojson"), features.from_records(spark, one), features.from_pandas(spark, pd.DataFrame({"id": [7], "name": ["a"], "geometry": [SQUARE]}))):
        (row,) = zonal_stats(r, f, "mean", include_cols=["id", "name"], include_geom=True).collect()
        assert row.mean == 5 and int(row.id) == 7 and row.name == "a" and row.geometry


def test_cut_areas(spark):
    f = spark.createDataFrame([(1, "POLYGON ((0 0, 3 0, 3 3, 0 3, 0 0), (0.5 0.5, 2.5 0.5, 2.5 2.5, 0.5 2.5, 0.5 0.5))")], "id int, geometry string")
    rows = subdivide(f, Grid(0, 0, 3, 3, 1, 1), "id").collect()
    assert sum(r.area for r in rows) == pytest.approx(5) and {(r.row, r.col) for r in rows} == {(r, c) for r in range(3) for c in range(3)} - {(1, 1)}


def test_command_line(spark, tmp_path, capsys):
    spark.createDataFrame([(r, c, r * 3 + c + 1) for r in range(3) for c in range(3)], "row int, col int, value int").write.parquet(f"{tmp_path}/r.parquet")
    spark.createDataFrame([(1, SQUARE)], "id int, geometry string").write.parquet(f"{tmp_path}/f.parquet")
    base = ["-g", "0,0,3,3,3,3", "-p", f"{tmp_path}/f.parquet", "-f", "id"]
    assert cli.main([*base, "-r", f"{tmp_path}/r.parquet", "-s", "mean", "-s", "quantile(q=0.25)", "-o", f"{tmp_path}/o.csv", "--id-name", "key", "--id-type", "text"], spark) == 0
    (row,) = spark.read.option("header", True).csv(f"{tmp_path}/o.csv").collect()
    assert row.asDict() == {"key": "1", "mean": "5.0", "quantile_25": "3"}
    assert cli.main([*base, "-r", f"{tmp_path}/r.parquet", "-s", "nonsense", "-o", f"{tmp_path}/p.csv"], spark) == 1
    assert "Error" in capsys.readouterr().err
    (tmp_path / "c.toml").write_text(f'raster="t:{tmp_path}/r.parquet"\nstat="count(t)"\noutput="{tmp_path}/q.csv"\n')
    assert cli.main([*base, "--config", f"{tmp_path}/c.toml"], spark) == 0
    assert spark.read.option("header", True).csv(f"{tmp_path}/q.csv").columns == ["id", "t_count"]


def test_stream(spark, tmp_path):
    spark.createDataFrame([(i, SQUARE) for i in range(5)], "id int, geometry string").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("id int, geometry string").parquet(f"{tmp_path}/in")
    r = from_array(spark, np.arange(1, 10).reshape(3, 3))
    stream_zonal_stats(stream, r, ["mean"], lambda df, n: df.write.mode("overwrite").parquet(f"{tmp_path}/out/batch={n}"), f"{tmp_path}/cp", include_cols="id").awaitTermination()
    assert [(x.id, x.mean) for x in spark.read.parquet(f"{tmp_path}/out").orderBy("id").collect()] == [(i, 5.0) for i in range(5)]


def test_progress_of_an_action(spark):
    told = []
    n = watched(spark, lambda: spark.range(0, 400, 1, 40).selectExpr("sum(id * id)").first()[0], lambda share, what: told.append((share, what)), every=0.01)
    assert n == sum(i * i for i in range(400))
    shares = [s for s, _ in told]
    assert shares[0] == 0 and shares[-1] == 1 and shares == sorted(shares)

    def fails():
        raise RuntimeError("no")

    with pytest.raises(RuntimeError):
        watched(spark, fails, lambda *a: told.append(a))
    assert told[-1][0] == 0


def test_a_wide_polygon_is_cut_by_halves():
    """A comb over many columns: every cell's area as that of its box."""
    grid = Grid(0.0, 0.0, 300.0, 4.0, 1.0, 1.0)
    top = [(float(x), 3.5 if x % 2 else 1.25) for x in range(299, 0, -1)]
    ring = [(0.5, 0.25), (299.5, 0.25), *top]
    wkt = "POLYGON ((" + ", ".join(f"{x} {y}" for x, y in [*ring, ring[0]]) + "))"
    got = {(r, c): area for r, c, area, _ in pieces(wkt, grid)}
    for r, c, box in brute.boxes(grid):
        want = brute.inside_box(list(ring), *box)
        assert got.get((r, c), 0.0) == pytest.approx(want, abs=1e-9)
    # lines that go down split as lines that go up
    parts = dict(bands([(0.0, 0.0), (2.0, 0.0), (2.0, 2.0), (0.0, 2.0)], 1, 0, 1, lambda k: 2.0 - k))
    assert sorted(p[1] for p in parts[0]) == [1.0, 1.0, 2.0, 2.0] and sorted(p[1] for p in parts[1]) == [0.0, 0.0, 1.0, 1.0]


def test_strategies_agree(spark, result):
    f = spark.createDataFrame([(1, SQUARE)], "id int, geometry string")
    r = from_array(spark, np.arange(9).reshape(3, 3))
    want = zonal_stats(r, f, ["sum", "count"]).collect()
    for strategy in ("raster-sequential", "raster-parallel"):
        for most in (1, 30_000_000):
            assert zonal_stats(r, f, ["sum", "count"], strategy=strategy, max_cells_in_memory=most).collect() == want


def test_command_line_with_bands(spark, tmp_path):
    rows = [(b, r, c, b * (r * 4 + c)) for b in (1, 2, 3) for r in range(4) for c in range(4)]
    spark.createDataFrame(rows, "band int, row int, col int, value int").write.parquet(f"{tmp_path}/b.parquet")
    spark.createDataFrame([(4, "POLYGON ((0 0, 2 0, 2 1, 0 1, 0 0))"), (5, None)], "id int, geometry string").write.parquet(f"{tmp_path}/f.parquet")
    base = ["-g", "0,0,4,4,4,4", "-p", f"{tmp_path}/f.parquet", "-f", "id", "--nodata", "13"]
    for k, (name, stats, columns) in enumerate((("", ["max", "count"], [f"band_{b}_{s}" for s in ("max", "count") for b in (1, 2, 3)]), ("t:", ["max(t_band_2)"], ["t_band_2_max"]))):
        assert cli.main([*base, "-r", f"{name}{tmp_path}/b.parquet", *[x for s in stats for x in ("-s", s)], "-o", f"{tmp_path}/{k}.parquet"], spark) == 0
        got = spark.read.parquet(f"{tmp_path}/{k}.parquet")
        assert got.columns == ["id", *columns]
        row = got.where("id = 4").first()
        # the value 13 of the first band is missing
        assert (row.band_1_max, row.band_1_count, row.band_3_max, row.band_3_count) == (12, 1.0, 39, 2.0) if k == 0 else row.t_band_2_max == 26
    assert cli.main([*base, "-r", f"{tmp_path}/b.parquet[2]", "-s", "max", "-o", f"{tmp_path}/o.parquet"], spark) == 0
    assert spark.read.parquet(f"{tmp_path}/o.parquet").columns == ["id", "max"]
