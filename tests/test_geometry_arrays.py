"""Edges from arrays of points against edges one by one."""

import random
import struct

import pyarrow as pa
import pytest

from gridloom.sources import geometry
from gridloom.sources.geometry import GeometryError, decode, edges_of, rings_of, to_wkb
from tests.test_runs import blob, polygon

SHAPES = [
    polygon([(0.5, 0.25), (3, 0), (2.5, 4)], [(1, 1), (1.5, 1), (1.5, 2)]),
    polygon([(0, 0), (0, 4), (4, 4), (4, 0)]),
    "MULTIPOLYGON (((0 0, 1 0, 1 1, 0 0)), ((5 5, 7 5, 7 7, 5 7, 5 5), (5.5 5.5, 5.5 6, 6 6, 5.5 5.5)))",
    "LINESTRING (0 0, 1 1, 1 1, 3 0.5)",
    "MULTILINESTRING ((0 0, 1 1), (2 2, 3 3, 4 2))",
    "GEOMETRYCOLLECTION (POLYGON ((0 0, 1 0, 1 1, 0 0)), POLYGON ((3 3, 3 4, 4 4, 3 3)))",
    "POLYGON ((0 0, 1 1, 0 0))",
    "POLYGON ((0 0, 0 0, 2 0, 2 2, 0 2, 0 0))",
]


def by_arrays(values):
    rows = [r for b in geometry._edge_rows(iter([pa.RecordBatch.from_pydict({"fid": list(range(len(values))), "g": pa.array(values)})])) for r in b.to_pylist()]
    return sorted((r["fid"], r["kind"], r["sg"], r["x0"], r["y0"], r["x1"], r["y1"]) for r in rows)


def one_by_one(values):
    out = []
    for i, v in enumerate(values):
        if v is not None:
            found = edges_of(v)
            xs, ys = {e[2] for e in found}, {e[3] for e in found}
            rings = decode(v)
            box = len(found) == 4 and len(rings) == 1 and len(rings[0][1]) == 1 and len(rings[0][1][0]) == 5 and len(xs) == len(ys) == 2 and all((e[2] == e[4]) != (e[3] == e[5]) for e in found)
            out += [(i, "R", 1.0, min(xs), min(ys), max(xs), max(ys))] if box else [(i, *e) for e in found]
    return sorted(out)


def test_arrays_equal_edges_one_by_one(monkeypatch):
    rng = random.Random(1)
    shapes = [*SHAPES, *(polygon(blob(rng, rng.uniform(-9, 9), rng.uniform(-9, 9), 3)[:: rng.choice([1, -1])]) for _ in range(40)), None]
    for values in (shapes, [to_wkb(s) for s in shapes], [None if s is None else to_wkb(s).hex() for s in shapes]):
        assert by_arrays(values) == one_by_one(shapes)
    monkeypatch.setattr(geometry, "POINTS", 7)
    assert by_arrays([to_wkb(s) for s in shapes]) == one_by_one(shapes)


def test_wkb_round_trip_and_other_layouts():
    for s in SHAPES:
        assert decode(to_wkb(s)) == decode(s)
    points = [(0.0, 0.0, 9.0, 8.0), (2.0, 0.0, 9.0, 8.0), (2.0, 3.0, 9.0, 8.0), (0.0, 0.0, 9.0, 8.0)]
    plain = one_by_one([polygon([(0, 0), (2, 0), (2, 3)])])
    for order, mark in (("<", 1), (">", 0)):
        for code, dims, srid in ((3, 2, False), (1003, 3, False), (2003, 3, False), (3003, 4, False), (0x80000003, 3, False), (0x40000003, 3, False), (0x20000003, 2, True), (0xE0000003, 4, True)):
            data = struct.pack("B", mark) + struct.pack(order + "I", code) + (struct.pack(order + "I", 4326) if srid else b"")
            data += struct.pack(order + "II", 1, 4) + struct.pack(f"{order}{4 * dims}d", *(x for p in points for x in p[:dims]))
            assert by_arrays([data]) == plain


def test_what_is_no_polygon_or_line():
    point = struct.pack("<BI2d", 1, 1, 0.0, 0.0)
    mixed = to_wkb("GEOMETRYCOLLECTION (POLYGON ((0 0, 1 0, 1 1, 0 0)), LINESTRING (0 0, 1 1))")
    for bad, why in ((point, "Unsupported"), (mixed, "Mixed"), (to_wkb(SHAPES[0])[:-3], "parse"), (struct.pack("<BII", 1, 3, 0), "empty"), ("POLYGON EMPTY", "empty"), ("POLYGON ((0 0", "parse")):
        with pytest.raises(GeometryError, match=why):
            rings_of(bad)
