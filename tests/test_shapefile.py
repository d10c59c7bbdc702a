"""Shapefiles: round trips, bytes as the format has them, ranges of records, commit and abort."""

import datetime
import os
import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.sources import features, output, shapefile
from gridloom.sources.geometry import decode, rings_of, signed_area

SCHEMA = "id long, name string, share double, small float, n int, ok boolean, day date, geometry string"


def row(i, g, **kw):
    return tuple({"id": i, "name": f"ñame {i}", "share": i / 7, "small": 0.5, "n": -i, "ok": i % 2 == 0, "day": datetime.date(1987, 6, 1 + i % 28), "geometry": g, **kw}.values())


HOLED = "POLYGON ((2 1, 9 1.5, 8 7, 2.25 6, 2 1), (3 2, 3 3, 4 3, 3 2))"
PARTS = "MULTIPOLYGON (((20 0, 29 0, 29 9, 20 9, 20 0), (21 1, 28 1, 28 8, 21 8, 21 1)), ((23 3, 25 3, 25 6, 23 3)), ((40 0, 41 0, 41 2, 40 0)))"
LINE, LINES = "LINESTRING (0 0, 3 4.5, 7 1)", "MULTILINESTRING ((0 0, 1 1), (5 5, 6 7, 9 7.125))"


def canonical(value):
    """Kind and rings of a geometry whatever their direction, first point and order."""
    out = []
    for kind, rings in decode(value):
        new = []
        for r in rings:
            r = list(map(tuple, r))
            if kind == "P":
                r = r[:-1] if r[0] == r[-1] else r
                r = r[::-1] if signed_area(r) < 0 else r
                k = r.index(min(r))
                r = r[k:] + r[:k]
            new.append(r)
        out.append((kind, [new[0], *sorted(new[1:])]))
    return sorted(out)


def test_round_trip(spark, tmp_path):
    rows = [row(0, HOLED), row(1, PARTS), row(2, None), row(3, LINE), row(4, LINES), row(5, "POLYGON EMPTY")]
    rows += [(6, *[None] * 6, HOLED), row(2**63 - 1, HOLED, n=-(2**31), day=datetime.date(2, 1, 1), share=-2.2250738585072014e-308, name="é" * 127), row(-(2**63), LINE, n=0, day=datetime.date(9999, 12, 31), share=1e300, name="")]
    path = str(tmp_path / "out.shp")
    output.write(spark.createDataFrame(rows, SCHEMA).repartition(3), path, geometry="geometry")
    with pytest.raises(ValueError, match="exists already"):
        output.write(spark.createDataFrame(rows, SCHEMA), path, geometry="geometry")
    got = features.read(spark, path)
    assert dict(got.dtypes) == {"id": "bigint", "name": "string", "share": "double", "small": "double", "n": "bigint", "ok": "boolean", "day": "date", "geometry": "binary"}
    by = {r.id: r for r in got.collect()}
    assert len(by) == len(rows)
    for r in rows:
        assert tuple(by[r[0]])[:-1] == r[:-1]
        g = by[r[0]].geometry
        if r[-1] in (None, "POLYGON EMPTY"):
            assert g is None
        else:
            assert canonical(bytes(g)) == canonical(r[-1])
    # one kind of shape in a part
    for f in os.listdir(path):
        if f.endswith(".shp"):
            data = open(f"{path}/{f}", "rb").read()
            assert struct.unpack_from(">i", data)[0] == 9994 and 2 * struct.unpack_from(">i", data, 24)[0] == len(data)
            at, seen = 100, set()
            while at < len(data):
                seen.add(struct.unpack_from("<i", data, at + 8)[0])
                at += 8 + 2 * struct.unpack_from(">i", data, at + 4)[0]
            assert seen - {0} <= {struct.unpack_from("<i", data, 32)[0]}


def test_known_bytes(spark, tmp_path):
    """A file put together here by the published description, with Z, points apart, a deleted row and a gap."""
    ring = [(0.0, 0.0), (0.0, 4.0), (4.0, 4.0), (4.0, 0.0), (0.0, 0.0)]
    hole = [(1.0, 1.0), (2.0, 1.0), (2.0, 2.0), (1.0, 1.0)]
    xy = b"".join(struct.pack("<2d", *p) for p in hole + ring)
    polygon_z = struct.pack("<i4d2i2i", 15, 0, 0, 4, 4, 2, 9, 0, 4) + xy + struct.pack("<11d", *[0.0] * 11)
    bodies = [polygon_z, struct.pack("<i", 0), polygon_z]
    shp, index = b"", b""
    for k, b in enumerate(bodies):
        index += struct.pack(">2i", (100 + len(shp)) // 2, len(b) // 2)
        shp += struct.pack(">2i", k + 1, len(b) // 2) + b + b"\0" * (5000 if k == 0 else 0)
    head = lambda n: struct.pack(">7i", 9994, 0, 0, 0, 0, 0, (100 + n) // 2) + struct.pack("<2i8d", 1000, 15, 0, 0, 4, 4, 0, 0, 0, 0)
    dbf = struct.pack("<4BI2H20x", 3, 95, 7, 26, 3, 32 + 96 + 1, 16) + b"".join(struct.pack("<11sc4x2B14x", n, t, w, d) for n, t, w, d in ((b"NAME", b"C", 4, 0), (b"N", b"N", 5, 0), (b"X", b"F", 6, 2)))
    dbf += b"\r" + b" \xe9t\xe9     7  1.25" + b" ab  *********** " [:16] + b"*zz      1  0.00" + b"\x1a"
    for end, data in (("shp", head(len(shp)) + shp), ("shx", head(len(index)) + index), ("dbf", dbf), ("cpg", b"ISO 8859-1")):
        (tmp_path / f"old.{end}").write_bytes(data)
    got = shapefile.read(spark, str(tmp_path / "old.shp"), records=1).collect()
    assert [(r.NAME, r.N, r.X) for r in got] == [("été", 7, 1.25), ("ab", None, None)]
    assert canonical(bytes(got[0].geometry)) == [("P", [ring[:1] + ring[3:0:-1], hole[:-1]])] and got[1].geometry is None
    os.remove(tmp_path / "old.shx")
    with pytest.raises(Exception, match="without its index"):
        shapefile.read(spark, str(tmp_path / "old.shp")).collect()


def test_names():
    assert shapefile.field_names(["coefficient_of_variation", "coefficient_of_x", "A", "a", "ññññññ"]) == ["coefficien", "coeffici_1", "A", "a_1", "ñññññ"]


def test_ranges_and_parts(spark, tmp_path, monkeypatch):
    """Parts are bounded, and a part is read by as many tasks as it has ranges; nothing is lost or doubled."""
    rng = random.Random(5)
    df = spark.range(3000).select(F.col("id").alias("a_long_name_of_a_column"), F.concat(F.lit("POLYGON (("), F.col("id"), F.lit(" 0, "), F.col("id") + 1, F.lit(" 0, "), F.col("id"), F.lit(" 5))")).alias("shape")).repartition(2)
    shapefile.write(df, str(tmp_path / "one"), "shape")
    got = shapefile.read(spark, str(tmp_path / "one"), "shape", records=100)
    assert got.columns == ["a_long_nam", "shape"] and got.rdd.getNumPartitions() >= 30
    back = {r.a_long_nam: rings_of(bytes(r.shape))[0][2] for r in got.collect()}
    i = rng.randrange(3000)
    assert len(back) == 3000 and {tuple(p) for p in back[i]} == {(i, 0), (i + 1, 0), (i, 5)}
    fields = [("x", "N", 20, 0)]
    part = shapefile._Part(fields)
    for k in range(10):
        part.add(*shapefile.shape_record(HOLED), [b"%20d" % k])
    assert abs(part.bytes - sum(len(x) for end, x in part.files().items() if end != "cpg")) < 500
    monkeypatch.setattr(shapefile, "PART", 2000)
    w = shapefile.ShapefileWriter(str(tmp_path / "two"), "shape", df.schema, False)
    done = w.write(iter(df.limit(100).toArrow().to_batches()))
    assert len(done.parts) >= 5
    w.commit([done, None])
    assert shapefile.read(spark, str(tmp_path / "two"), "shape").count() == 100


def test_nested_shells_and_touching_holes():
    box = lambda x, y, w: np.array([(x, y), (x, y + w), (x + w, y + w), (x + w, y), (x, y)], float)
    outer, lake, island, pond = box(0, 0, 10), box(1, 1, 8)[::-1], box(2, 2, 6), box(2, 3, 2)[::-1]
    got = shapefile.grouped([pond, lake, island, outer])
    assert [[r.tolist() for r in p] for p in got] == [[island.tolist(), pond.tolist()], [outer.tolist(), lake.tolist()]]
    alone = shapefile.grouped([box(50, 50, 1)[::-1], outer, island])
    assert sorted(map(len, alone)) == [1, 1, 1]


def test_committed_or_absent(spark, tmp_path):
    path = str(tmp_path / "out")
    df = spark.range(10).select("id", F.lit(HOLED).alias("geometry")).repartition(3)
    bad = df.withColumn("id", F.when(F.col("id") == 7, F.raise_error(F.lit("no"))).otherwise(F.col("id")))
    with pytest.raises(Exception, match="no"):
        shapefile.write(bad, path)
    assert not os.path.exists(path) or os.listdir(path) == []
    shapefile.write(df, path)
    with pytest.raises(Exception, match="no"):
        shapefile.write(bad, path, mode="overwrite")
    assert shapefile.read(spark, path).count() == 10
    shapefile.write(df.where("id < 2"), path)
    assert shapefile.read(spark, path).count() == 12
    shapefile.write(df.where("id < 2").select("geometry"), path, mode="overwrite")
    assert shapefile.read(spark, path).columns == ["fid", "geometry"] and shapefile.read(spark, path).count() == 2
    for wrong, what in ((df.withColumn("t", F.lit("x" * 255)), "254 bytes"), (df.withColumn("t", F.array("id")), "can't hold the column t"), (df.drop("geometry"), "no column geometry")):
        with pytest.raises(Exception, match=what):
            shapefile.write(wrong, str(tmp_path / "wrong"))
    assert not os.path.exists(tmp_path / "wrong") or os.listdir(tmp_path / "wrong") == []
