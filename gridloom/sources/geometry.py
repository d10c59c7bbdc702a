"""Geometry decoding on executors: WKB, WKT or GeoJSON text -> boundary edges.

One row for each edge: feature id, kind (``P`` polygon, ``L`` line), sign and
end points. A feature that is one rectangle along the axes is one row of kind
``R`` with its least and its greatest corner. The sign is +1 for a counter-clockwise shell and a clockwise hole,
-1 for the others, so that signed areas of all edges add up to covered area.
"""

from __future__ import annotations

import json
import math
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_NUMBER = re.compile(r"[-+]?(?:\d+\.?\d*(?:[eE][-+]?\d+)?|\.\d+(?:[eE][-+]?\d+)?)")
#: Part of a geometry: kind, rings (or one line), each a list of points.
Part = tuple[str, list[list[tuple[float, float]]]]


class GeometryError(ValueError):
    """A geometry can't be decoded or is of no supported kind."""


def _tree(text: str):
    """Nested lists of a WKT body."""
    stack, at = [[]], 0
    for m in re.finditer(r"[(),]|[^(),]+", text):
        t = m[0].strip()
        if t == "(":
            new: list = []
            stack[-1].append(new)
            stack.append(new)
        elif t == ")":
            stack.pop()
            if not stack:
                raise GeometryError("Failed to parse geometry.")
        elif t and t != ",":
            stack[-1].append(t)
        at = m.end()
    if len(stack) != 1 or at != len(text):
        raise GeometryError("Failed to parse geometry.")
    return stack[0]


def _points(items: list) -> list[tuple[float, float]]:
    out = []
    for p in items:
        xs = _NUMBER.findall(p) if isinstance(p, str) else []
        if len(xs) < 2:
            raise GeometryError("Failed to parse geometry.")
        out.append((float(xs[0]), float(xs[1])))
    return out


def _wkt(text: str) -> list[Part]:
    m = re.match(r"\s*(?:SRID=\d+;)?\s*([A-Za-z]+)\s*(?:ZM|Z|M)?\s*(EMPTY|\()", text, re.I)
    if not m:
        raise GeometryError("Failed to parse geometry.")
    kind = m[1].upper()
    if m[2].upper() == "EMPTY":
        return []
    body = text[m.start(2) :].strip()
    if kind == "GEOMETRYCOLLECTION":
        inner, depth, start, out = body[1:-1], 0, 0, []
        for i, c in enumerate([*inner, ","]):
            depth += (c == "(") - (c == ")")
            if c == "," and depth == 0:
                out += _wkt(inner[start:i])
                start = i + 1
        return out
    (tree,) = _tree(body)
    if kind == "POLYGON":
        return [("P", [_points(r) for r in tree])]
    if kind == "MULTIPOLYGON":
        return [("P", [_points(r) for r in p]) for p in tree]
    if kind in ("LINESTRING", "LINEARRING"):
        return [("L", [_points(tree)])]
    if kind == "MULTILINESTRING":
        return [("L", [_points(x)]) for x in tree]
    raise GeometryError("Unsupported geometry type.")


def _wkb(data: bytes, at: int = 0) -> tuple[list[Part], int]:
    order = "<" if data[at] else ">"
    (code,) = struct.unpack_from(order + "I", data, at + 1)
    at += 5
    if code & 0x20000000:
        at += 4
    dims = 2 + bool(code & 0x80000000) + bool(code & 0x40000000)
    code &= 0x0FFFFFFF
    dims += {0: 0, 1: 1, 2: 1, 3: 2}[code // 1000]
    kind = code % 1000

    def count() -> int:
        nonlocal at
        (n,) = struct.unpack_from(order + "I", data, at)
        at += 4
        return n

    def points() -> list[tuple[float, float]]:
        nonlocal at
        n = count()
        xs = struct.unpack_from(f"{order}{n * dims}d", data, at)
        at += 8 * n * dims
        return list(zip(xs[0::dims], xs[1::dims]))

    if kind == 2:
        return [("L", [points()])], at
    if kind == 3:
        rings = [points() for _ in range(count())]
        return ([("P", rings)] if rings else []), at
    if kind in (5, 6, 7):
        out = []
        for _ in range(count()):
            parts, at = _wkb(data, at)
            out += parts
        return out, at
    raise GeometryError("Unsupported geometry type.")


def _wkb_arrays(data: bytes, at: int = 0) -> tuple[list[tuple[str, int, np.ndarray]], int]:
    """Kind, number in its part and points (an array of x and y) of each ring or line of a WKB geometry, as views of its bytes."""
    order = "<" if data[at] else ">"
    (code,) = struct.unpack_from(order + "I", data, at + 1)
    at += 9 if code & 0x20000000 else 5
    dims = 2 + bool(code & 0x80000000) + bool(code & 0x40000000)
    code &= 0x0FFFFFFF
    dims += {0: 0, 1: 1, 2: 1, 3: 2}[code // 1000]
    kind = code % 1000
    if kind not in (2, 3, 5, 6, 7):
        raise GeometryError("Unsupported geometry type.")
    (n,) = (1,) if kind == 2 else struct.unpack_from(order + "I", data, at)
    at += 0 if kind == 2 else 4
    out: list[tuple[str, int, np.ndarray]] = []
    for i in range(n):
        if kind > 3:
            inner, at = _wkb_arrays(data, at)
            out += inner
            continue
        (size,) = struct.unpack_from(order + "I", data, at)
        points = np.frombuffer(data, order + "f8", size * dims, at + 4).reshape(size, dims)[:, :2]
        out.append(("L" if kind == 2 else "P", i, points))
        at += 4 + 8 * size * dims
    return out, at


def to_wkb(value: bytes | str | None) -> bytes | None:
    """A geometry (WKB, WKT or GeoJSON) as little-endian WKB."""
    if value is None:
        return None
    line = lambda points: struct.pack(f"<I{2 * len(points)}d", len(points), *(x for p in points for x in p))
    parts = decode(value)
    one = [struct.pack("<BI", 1, 2) + line(rings[0]) if kind == "L" else struct.pack("<BII", 1, 3, len(rings)) + b"".join(map(line, rings)) for kind, rings in parts]
    if len(one) == 1:
        return one[0]
    kinds = {kind for kind, _ in parts}
    return struct.pack("<BII", 1, {"P": 6, "L": 5}[kinds.pop()] if len(kinds) == 1 else 7, len(one)) + b"".join(one)


def _geojson(g: dict) -> list[Part]:
    kind, c = g.get("type"), g.get("coordinates")
    ring = lambda r: [(float(p[0]), float(p[1])) for p in r]
    if kind == "Feature":
        return _geojson(g["geometry"])
    if kind == "Polygon":
        return [("P", [ring(r) for r in c])] if c else []
    if kind == "MultiPolygon":
        return [("P", [ring(r) for r in p]) for p in c]
    if kind == "LineString":
        return [("L", [ring(c)])]
    if kind == "MultiLineString":
        return [("L", [ring(x)]) for x in c]
    if kind == "GeometryCollection":
        return [p for x in g["geometries"] for p in _geojson(x)]
    raise GeometryError("Unsupported geometry type.")


def decode(value: bytes | str) -> list[Part]:
    """Parts of a geometry; bytes are WKB (or text), text is WKT or GeoJSON."""
    if isinstance(value, (bytes, bytearray, memoryview)):
        data = bytes(value)
        if data[:1] in (b"\x00", b"\x01"):
            try:
                return _wkb(data)[0]
            except (struct.error, IndexError, KeyError):
                raise GeometryError("Failed to parse geometry.") from None
        value = data.decode()
    text = value.strip()
    if text[:1] == "{":
        return _geojson(json.loads(text))
    if re.fullmatch(r"0[01][0-9A-Fa-f]{8,}", text):
        return _wkb(bytes.fromhex(text))[0]
    return _wkt(text)


def to_geojson(value: bytes | str | None) -> str | None:
    """A geometry (WKB, WKT or GeoJSON) as GeoJSON text."""
    if value is None:
        return None
    parts = decode(value)
    kinds = {k for k, _ in parts}
    if not parts or len(kinds) > 1:
        one = [to_geojson_part(p) for p in parts]
        return json.dumps({"type": "GeometryCollection", "geometries": one})
    if len(parts) == 1:
        return json.dumps(to_geojson_part(parts[0]))
    many = "MultiPolygon" if kinds == {"P"} else "MultiLineString"
    return json.dumps({"type": many, "coordinates": [to_geojson_part(p)["coordinates"] for p in parts]})


def to_geojson_part(part: Part) -> dict:
    """One polygon or line as a GeoJSON object."""
    kind, rings = part
    if kind == "P":
        return {"type": "Polygon", "coordinates": [[list(p) for p in r] for r in rings]}
    return {"type": "LineString", "coordinates": [list(p) for p in rings[0]]}


def signed_area(ring: list[tuple[float, float]]) -> float:
    """Area of a ring, positive if counter-clockwise."""
    if not ring:
        return 0.0
    ox, oy = ring[0]
    pairs = zip(ring, ring[1:] + ring[:1])
    return sum((a[0] - ox) * (b[1] - oy) - (b[0] - ox) * (a[1] - oy) for a, b in pairs) / 2


def length(line: list[tuple[float, float]]) -> float:
    return sum(math.dist(a, b) for a, b in zip(line, line[1:]))


def edges_of(value: bytes | str) -> list[tuple[str, float, float, float, float, float]]:
    """Edges (kind, sign, x0, y0, x1, y1) of a geometry.

    Rings of fewer than four points are skipped. An empty geometry, one of
    points, or one of both lines and polygons is an error.
    """
    parts = decode(value)
    if not parts:
        raise GeometryError("Can't get statistics for an empty geometry.")
    if len({k for k, _ in parts}) > 1:
        raise GeometryError("Mixed-type geometries not supported.")
    out = []
    for kind, rings in parts:
        for i, ring in enumerate(rings):
            if kind == "P":
                if len(ring) < 4:
                    continue
                if ring[0] != ring[-1]:
                    ring = [*ring, ring[0]]
                sign = (1.0 if signed_area(ring) >= 0 else -1.0) * (-1.0 if i else 1.0)
            else:
                sign = 1.0
            out += [(kind, sign, *a, *b) for a, b in zip(ring, ring[1:]) if a != b]
    return out


def rings_of(value: bytes | str) -> list[tuple[str, int, np.ndarray]]:
    """Kind, number in its part and points of each ring or line; WKB is not unfolded to Python numbers.

    An empty geometry, one of points, or one of both lines and polygons is an error.
    """
    if isinstance(value, str) and re.fullmatch(r"0[01][0-9A-Fa-f]{8,}", value.strip()):
        value = bytes.fromhex(value.strip())
    if isinstance(value, (bytes, bytearray, memoryview)) and bytes(value[:1]) in (b"\x00", b"\x01"):
        try:
            out = _wkb_arrays(bytes(value))[0]
        except (struct.error, IndexError, KeyError, ValueError) as e:
            raise e if isinstance(e, GeometryError) else GeometryError("Failed to parse geometry.") from None
    else:
        out = [(kind, i, np.array(ring, float).reshape(-1, 2)) for kind, rings in decode(value) for i, ring in enumerate(rings)]
    if not out:
        raise GeometryError("Can't get statistics for an empty geometry.")
    if len({kind for kind, *_ in out}) > 1:
        raise GeometryError("Mixed-type geometries not supported.")
    return out


_EDGES = pa.schema([("fid", pa.int64()), ("kind", pa.string()), ("sg", pa.float64()), ("x0", pa.float64()), ("y0", pa.float64()), ("x1", pa.float64()), ("y1", pa.float64())])
#: Points whose edges are made at once.
POINTS = 100_000


def _batch(found: list[tuple[int, bool, str, int, np.ndarray]]) -> pa.RecordBatch:
    """Edges of rings (feature, whether it has this one only, kind, number in its part, closed points), by arrays."""
    fid, alone, hole = (np.array(x) for x in ([f[0] for f in found], [f[1] for f in found], [f[3] > 0 for f in found]))
    line = np.array([f[2] == "L" for f in found])
    size = np.array([len(f[4]) for f in found])
    xy = np.concatenate([f[4] for f in found]).astype(float)
    ends = np.cumsum(size)
    ring = np.repeat(np.arange(len(found)), size)
    start = np.ones(len(xy), bool)
    start[ends - 1] = False
    at = np.flatnonzero(start)
    a, b, of = xy[at], xy[at + 1], ring[at]
    corner = xy[(ends - size)[of]]
    cross = (a[:, 0] - corner[:, 0]) * (b[:, 1] - corner[:, 1]) - (b[:, 0] - corner[:, 0]) * (a[:, 1] - corner[:, 1])
    area = np.bincount(of, cross, len(found))
    sign = np.where(line, 1.0, np.where(area >= 0, 1.0, -1.0) * np.where(hole, -1.0, 1.0))
    # rings of five points whose sides run along the axes in turn are rectangles
    five = np.flatnonzero(alone & ~line & (size == 5))
    square = np.zeros(len(found), bool)
    if len(five):
        p = xy[(ends - size)[five][:, None] + np.arange(5)]
        level, upright = p[:, 1:, 1] == p[:, :-1, 1], p[:, 1:, 0] == p[:, :-1, 0]
        turns = (level != upright).all(axis=1) & (level[:, :-1] != level[:, 1:]).all(axis=1)
        square[five] = turns & (p[:, 0] == p[:, 4]).all(axis=1)
    keep = (a != b).any(axis=1) & ~square[of]
    a, b, of = a[keep], b[keep], of[keep]
    boxes = np.flatnonzero(square)
    corners = xy[(ends - size)[boxes][:, None] + np.arange(4)] if len(boxes) else np.empty((0, 4, 2))
    low, high = corners.min(axis=1), corners.max(axis=1)
    every = np.concatenate((of, boxes))
    kind = np.where(square[every], "R", np.where(line[every], "L", "P"))
    sides = [np.concatenate(x) for x in ((a[:, 0], low[:, 0]), (a[:, 1], low[:, 1]), (b[:, 0], high[:, 0]), (b[:, 1], high[:, 1]))]
    return pa.RecordBatch.from_arrays([pa.array(fid[every]), pa.array(kind, pa.string()), pa.array(np.where(square[every], 1.0, sign[every])), *map(pa.array, sides)], schema=_EDGES)


def _edge_rows(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in it:
        found, points = [], 0
        for fid, g in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            g = g.as_py()
            if g is None:
                continue
            rings = rings_of(g)
            for kind, i, xy in rings:
                if kind == "P":
                    if len(xy) < 4:
                        continue
                    if (xy[0] != xy[-1]).any():
                        xy = np.concatenate((xy, xy[:1]))
                if len(xy):
                    found.append((fid, len(rings) == 1, kind, i, xy))
                    points += len(xy)
            if points >= POINTS:
                yield _batch(found)
                found, points = [], 0
        if found:
            yield _batch(found)


def edges(features: DataFrame, fid: str, geometry: str = "geometry") -> DataFrame:
    """Edges of all features with a geometry, or its corners where that is a rectangle along the axes; null geometries have none."""
    return features.select(F.col(fid).cast("long").alias("fid"), F.col(geometry)).mapInArrow(_edge_rows, "fid long, kind string, sg double, x0 double, y0 double, x1 double, y1 double")
