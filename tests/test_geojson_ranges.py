"""GeoJSON in byte ranges: every cut of a file gives the same features."""

import gzip
import json
import random

import pytest

from gridloom.sources import features, geojson
from gridloom.sources.geojson import features as texts
from gridloom.sources.geojson import ranges

ODD = ['say "hi"', "back\\slash", 'end\\"', "{[", "]}", '"features": [', "tab\t", "né {", "\\\\", ""]


def feature(i, rng):
    n = rng.randint(1, 6)
    ring = [[rng.randint(0, 99) / 4, rng.randint(0, 99) / 4] for _ in range(n)]
    properties = {"name": ODD[i % len(ODD)], "n": i, "sub": {"type": "Feature", "features": [{"type": "Feature"}]}}
    return {"type": "Feature", "id": i, "properties": properties, "geometry": {"type": "LineString", "coordinates": [*ring, ring[0]]}}


def collection(rows, rng, indent):
    head = {"type": "FeatureCollection", "name": 'a "features": [ b', "crs": {"type": "name", "properties": {"name": "x}"}}, "bbox": [0, 0, 1, 1]}
    return json.dumps(head | {"features": rows, "after": {"k": [1, {"z": "]"}]}}, indent=indent, ensure_ascii=rng.random() < 0.5)


@pytest.mark.parametrize("size", [7, 64, 501, 1 << 20])
@pytest.mark.parametrize("indent", [None, 2])
def test_every_cut_gives_the_same(spark, tmp_path, monkeypatch, size, indent):
    monkeypatch.setattr(geojson, "MOST_TASKS", 8)
    rng = random.Random(size)
    rows = [feature(i, rng) for i in range(24)]
    (tmp_path / "a.geojson").write_text(collection(rows[:10], rng, indent))
    # a folder may hold lines beside collections, with and without an end of the last line
    (tmp_path / "b b.geojson").write_text("\n".join(json.dumps(r) for r in rows[10:20]))
    (tmp_path / "c.geojson").write_text("no feature\n\n" + "".join(json.dumps(r) + "\r\n" for r in rows[20:]))
    (tmp_path / "empty.geojson").write_text("")
    got = [json.loads(r.value) for r in texts(spark, str(tmp_path), size).collect()]
    assert sorted(got, key=lambda r: r["id"]) == rows


def test_long_runs_of_backslashes(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(geojson, "MOST_TASKS", 8)
    rows = [{"type": "Feature", "id": n, "properties": {"p": "\\" * n + '"}'}, "geometry": None} for n in range(70, 90)]
    (tmp_path / "a.json").write_text(json.dumps({"features": rows, "type": "FeatureCollection"}))
    for size in (33, 100):
        got = [json.loads(r.value) for r in texts(spark, str(tmp_path / "a.json"), size).collect()]
        assert sorted(got, key=lambda r: r["id"]) == rows


def test_one_line_is_read_by_many_tasks(spark, tmp_path):
    rng = random.Random(1)
    rows = [feature(i, rng) for i in range(5000)]
    path = tmp_path / "big.geojson"
    path.write_text(collection(rows, rng, None))
    size = path.stat().st_size // 9
    told = ranges(spark, str(path), size)
    assert told.count() == 10 and told.where("array is null").count() == 0
    out = texts(spark, str(path), size)
    assert out.rdd.getNumPartitions() == 10 and out.count() == 5000
    by_task = out.selectExpr("spark_partition_id() p").groupBy("p").count().collect()
    assert len(by_task) >= 9 and max(r["count"] for r in by_task) < 1000


def test_columns_packed_files_and_errors(spark, tmp_path):
    rng = random.Random(2)
    rows = [feature(i, rng) for i in range(6)]
    rows[3]["properties"] = {"late": 5}
    whole = collection(rows, rng, None)
    (tmp_path / "a.geojson").write_text(whole)
    df = features.geojson(spark, str(tmp_path / "a.geojson"))
    assert df.columns == ["id", "late", "n", "name", "sub", "geometry"]
    assert {r.id: r.late for r in df.collect()} == {str(i): "5" if i == 3 else None for i in range(6)}
    assert features.geojson(spark, str(tmp_path / "a.geojson"), ["n"]).columns == ["id", "n", "geometry"]
    (tmp_path / "p").mkdir()
    (tmp_path / "p" / "a.geojson.gz").write_bytes(gzip.compress(whole.encode()))
    assert texts(spark, str(tmp_path / "p")).count() == 6
    (tmp_path / "b.geojson").write_text(whole[: whole.index('"id": 4') + 9])
    with pytest.raises(Exception, match="ends within a feature"):
        texts(spark, str(tmp_path / "b.geojson")).count()
