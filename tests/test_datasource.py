"""Spark's reader on windows, with the filters it takes over; its writer, with commit and abort."""

import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.functions.grid import Grid
from gridloom.plans.zonal import is_large, zonal_stats
from gridloom.sources.datasource import FEATURES, RASTER, packed, register
from gridloom.sources.windows import ArraySource, from_source
from tests.test_runs import features_of


class Logged:
    """A source that leaves a file for each window that is read."""

    dtype = "float64"

    def __init__(self, folder, side):
        self.folder, self.grid = folder, Grid(0.0, 0.0, float(side), float(side), 1.0, 1.0)

    def read_window(self, row, col, rows, cols):
        open(f"{self.folder}/{row}-{col}", "w").close()
        return np.add.outer(np.arange(row, row + rows) * 1000.0, np.arange(col, col + cols))


def test_filters_reach_the_reader(spark, tmp_path):
    register(spark)
    def load(push=True):
        return spark.read.format(RASTER).option("source", packed(Logged(str(tmp_path), 40))).option("window", 8).option("push", push).load()

    some = load().where("tile_row = 2 and tile_col >= 3 and value > 0")
    assert some.count() == 2 * 64 and sorted(os.listdir(tmp_path)) == ["16-24", "16-32"]
    # what the reader took over is shown with the scan and no longer filtered behind it
    shown = some._sc._jvm.PythonSQLUtils.explainString(some._jdf.queryExecution(), "formatted")
    assert "tile_row" in shown.split("PushedFilters", 1)[1].split("\n")[0]
    assert load().where("tile_row = 99").count() == 0
    assert load().where(F.col("tile").isin([0, 24])).agg(F.max("value")).first()[0] == 39039.0 and len(os.listdir(tmp_path)) == 4
    plain = load(False)
    assert plain.where("tile = 3").count() == 64 and plain.count() == 1600


def test_only_windows_of_features_are_read(spark, tmp_path):
    r = from_source(spark, Logged(str(tmp_path), 64), 16)
    two = "MULTIPOLYGON (((1 1, 3 1, 3 2, 1 2, 1 1)), ((61 61, 63 61, 63 62, 61 62, 61 61)))"
    got = zonal_stats(r, features_of(spark, [two]), ["count", "max"], None, "id").first()
    assert (got["count"], got["max"]) == (4.0, 62_002.0) and sorted(os.listdir(tmp_path)) == ["0-48", "48-0"]


def test_count_of_cells_tells_what_is_large(spark, tmp_path):
    assert is_large(from_source(spark, Logged(str(tmp_path), 100_000), 4096))
    assert not is_large(from_source(spark, ArraySource(np.zeros((4, 4)), Grid(0, 0, 4, 4, 1, 1)), 4))
    assert not os.listdir(tmp_path)


def test_features_are_committed_or_absent(spark, tmp_path):
    register(spark)
    path = str(tmp_path / "out")
    shape = json.dumps({"type": "Point", "coordinates": [1, 2]})
    df = spark.range(10).select(F.col("id"), F.lit(shape).alias("geometry"), (F.col("id") / 4).alias("mean"), F.array(F.lit(1)).alias("values")).repartition(3)

    def save(df, mode="append"):
        df.write.format(FEATURES).option("path", path).option("geometry", "geometry").option("id", "id").mode(mode).save()

    def load():
        return sorted((json.loads(x) for f in os.listdir(path) for x in open(f"{path}/{f}")), key=lambda x: x["id"])

    bad = df.withColumn("mean", F.when(F.col("id") == 7, F.raise_error(F.lit("no"))).otherwise(F.col("mean")))
    with pytest.raises(Exception, match="no"):
        save(bad)
    assert not os.path.exists(path) or os.listdir(path) == []
    save(df)
    assert [x["id"] for x in load()] == list(range(10)) and load()[3] == {"type": "Feature", "id": 3, "geometry": json.loads(shape), "properties": {"mean": 0.75, "values": [1]}}
    save(df.where("id < 2"))
    assert len(load()) == 12
    with pytest.raises(Exception, match="no"):
        save(bad, "overwrite")
    assert len(load()) == 12
    save(df.where("id < 2"), "overwrite")
    assert len(load()) == 2 and not any(f.startswith(".") for f in os.listdir(path))
