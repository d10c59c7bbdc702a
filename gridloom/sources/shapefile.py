"""Shapefiles through Spark's reader and writer, without a library behind them.

``df.write.format("gridloom_shapefile")`` makes a folder of parts, each of
``.shp``, ``.shx``, ``.dbf`` and ``.cpg``. A task begins a new part beyond
:data:`PART` bytes, and one for each kind of shape, as a part holds one kind
only. Tasks write aside; the commit puts all parts in place, the index of each
last, and a job that fails leaves nothing.

``spark.read.format("gridloom_shapefile")`` reads such a folder, or one
``.shp``. Records have places in the index and in the table, so ranges of
:data:`RECORDS` records of a part are read by tasks of their own, and the driver
opens no more than the header of one table. Shapes become WKB. Columns that a schema
given to the reader leaves out are not decoded.

What the format cannot hold. Names have ten bytes: longer or repeated ones are
shortened and numbered. Text has 254 bytes: more is an error, never cut; blanks
at its end are lost. A null text is zero bytes and an empty one blanks, which other
programs may take for the same. Numbers are text of 24 characters, which hold
every double. Rings that are not closed are closed; shells run clockwise. A
table without columns gets ``fid``. Heights and measures are not read.
"""

from __future__ import annotations

import codecs
import datetime
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from gridloom.sources.geometry import decode

SHAPEFILE = "gridloom_shapefile"
#: Bytes of a part from which on a task begins a new one (the format allows 2 GB), records of a task, bytes read at once.
PART, RECORDS, READ = 64 << 20, 100_000, 8 << 20
# Fixed values of the format: code of a file, version, shape types (with heights, with measures), longest text and name.
MAGIC, VERSION, NULL = 9994, 1000, 0
POINTS, LINES, POLYGONS, MULTIPOINTS = (1, 11, 21), (3, 13, 23), (5, 15, 25), (8, 18, 28)
MOST_TEXT, MOST_NAME, MOST_FIELDS = 254, 10, 255


def register(spark: SparkSession) -> None:
    """Make the format known to a session."""
    spark.dataSource.register(ShapefileSource)


def _place(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri.removeprefix("file:"))


def field_names(names: list[str]) -> list[str]:
    """Names of at most ten bytes, all different in any case."""
    out: list[str] = []
    taken: set[str] = set()
    short = lambda name, most: name.encode()[:most].decode(errors="ignore")
    for name in names:
        new, k = short(name, MOST_NAME), 0
        while new.lower() in taken:
            k += 1
            new = f"{short(name, MOST_NAME - 1 - len(str(k)))}_{k}"
        taken.add(new.lower())
        out.append(new)
    return out


def _field(name: str, kind: T.DataType) -> tuple[str, int, int]:
    """Letter, width (0: that of the longest text) and decimals of a column's field."""
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return "N", 20, 0
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return "N", 24, 15
    if isinstance(kind, T.DecimalType):
        return "N", kind.precision + 3, kind.scale
    if isinstance(kind, T.BooleanType):
        return "L", 1, 0
    if isinstance(kind, T.DateType):
        return "D", 8, 0
    if isinstance(kind, (T.StringType, T.TimestampType, T.TimestampNTZType)):
        return "C", 0, 0
    raise ValueError(f"A shapefile can't hold the column {name} of type {kind.simpleString()}")


def _cells(name: str, letter: str, width: int, column: pa.Array) -> list[bytes]:
    """A column's values as bytes; texts are not filled up yet."""
    values = column.to_pylist()
    if letter == "N":
        return [b" " * width if x is None else (repr(x) if isinstance(x, float) else str(x)).rjust(width).encode() for x in values]
    if letter == "L":
        return [b"?" if x is None else b"T" if x else b"F" for x in values]
    if letter == "D":
        return [b" " * 8 if x is None else f"{x.year:04d}{x.month:02d}{x.day:02d}".encode() for x in values]
    out = [b"\0" if x is None else (x if isinstance(x, str) else x.isoformat(" ")).encode() for x in values]
    if any(len(x) > MOST_TEXT for x in out):
        raise ValueError(f"A text of column {name} has more than {MOST_TEXT} bytes, which a shapefile can't hold")
    return out


def _area(xy: np.ndarray) -> float:
    """Area of a closed ring, positive if counter-clockwise."""
    x, y = (xy - xy[0]).T
    return float(x[:-1] @ y[1:] - x[1:] @ y[:-1]) / 2


def shape_record(value: bytes | str | None) -> tuple[int, bytes, np.ndarray]:
    """Shape type, content and box of a geometry; null and empty ones are of type 0."""
    parts = decode(value) if value is not None else []
    if not parts:
        return NULL, struct.pack("<i", NULL), np.empty((0, 2))
    kinds = {kind for kind, _ in parts}
    if len(kinds) > 1:
        raise ValueError("A shape is made of polygons or of lines, not of both")
    polygon, rings = kinds == {"P"}, []
    for _, of in parts:
        for i, ring in enumerate(of):
            xy = np.array(ring, "<f8").reshape(-1, 2)
            if polygon and len(xy):
                if (xy[0] != xy[-1]).any():
                    xy = np.concatenate((xy, xy[:1]))
                # shells clockwise, holes the other way
                if (_area(xy) > 0) == (i == 0):
                    xy = xy[::-1]
            if len(xy):
                rings.append(xy)
    if not rings:
        return NULL, struct.pack("<i", NULL), np.empty((0, 2))
    xy = np.concatenate(rings)
    code = POLYGONS[0] if polygon else LINES[0]
    starts = np.cumsum([0, *map(len, rings[:-1])]).astype("<i4")
    box = np.concatenate((xy.min(axis=0), xy.max(axis=0)))
    head = struct.pack("<i4d2i", code, *box, len(rings), len(xy))
    return code, head + starts.tobytes() + np.ascontiguousarray(xy, "<f8").tobytes(), box.reshape(2, 2)


class _Part:
    """A part in the making: records of one shape type."""

    def __init__(self, fields: list[tuple[str, str, int, int]]):
        self.fields = fields
        self.code, self.shapes, self.bytes = NULL, [], 0
        self.low, self.high = np.full(2, np.inf), np.full(2, -np.inf)
        self.columns: list[list[bytes]] = [[] for _ in fields]

    def add(self, code: int, content: bytes, box: np.ndarray, values: list[bytes]) -> None:
        self.code = self.code or code
        self.shapes.append(content)
        if len(box):
            self.low, self.high = np.minimum(self.low, box[0]), np.maximum(self.high, box[1])
        for column, x in zip(self.columns, values, strict=True):
            column.append(x)
        self.bytes += len(content) + 16 + sum(w or len(x) for (_, _, w, _), x in zip(self.fields, values))

    def _header(self, size: int) -> bytes:
        box = [*self.low, *self.high] if np.isfinite(self.low).all() else [0.0] * 4
        return struct.pack(">7i", MAGIC, 0, 0, 0, 0, 0, size // 2) + struct.pack("<2i8d", VERSION, self.code, *box, 0, 0, 0, 0)

    def files(self) -> dict[str, bytes]:
        """The part's files by ending, the index last."""
        sizes = np.array([len(x) for x in self.shapes])
        at = 100 + np.cumsum(np.concatenate(([0], sizes[:-1] + 8)))
        index = np.stack((at // 2, sizes // 2), axis=1).astype(">i4").tobytes()
        records = b"".join(struct.pack(">2i", i + 1, len(x) // 2) + x for i, x in enumerate(self.shapes))
        widths = [w or max(1, *map(len, column)) for (_, _, w, _), column in zip(self.fields, self.columns)]
        length = 1 + sum(widths)
        if length > 0xFFFF:
            raise ValueError("A record of a shapefile's table has 65535 bytes at most")
        day = datetime.date.today()
        table = struct.pack("<4BI2H20x", 3, day.year - 1900, day.month, day.day, len(self.shapes), 33 + 32 * len(widths), length)
        for (name, letter, _, decimals), w in zip(self.fields, widths):
            table += struct.pack("<11sc4x2B14x", name.encode(), letter.encode(), w, decimals)
        filled = [column if w else [x.ljust(n, b"\0" if x == b"\0" else b" ") for x in column] for (_, _, w, _), n, column in zip(self.fields, widths, self.columns)]
        table += b"\r" + b"".join(b" " + b"".join(row) for row in zip(*filled)) + b"\x1a"
        return {"shp": self._header(100 + len(records)) + records, "dbf": table, "cpg": b"UTF-8", "shx": self._header(100 + len(index)) + index}


@dataclass
class Written(WriterCommitMessage):
    parts: list[str]


class ShapefileWriter(DataSourceArrowWriter):
    def __init__(self, path: str, geometry: str, schema: T.StructType, overwrite: bool):
        if geometry not in schema.names:
            raise ValueError(f"There is no column {geometry} with the shapes")
        self.path, self.geometry, self.overwrite = path.rstrip("/"), geometry, overwrite
        self.names = [n for n in schema.names if n != geometry]
        kinds = [_field(n, schema[n].dataType) for n in self.names]
        self.fields = [(short, *kind) for short, kind in zip(field_names(self.names), kinds)] or [("fid", "N", 20, 0)]
        if len(self.fields) > MOST_FIELDS:
            raise ValueError(f"A shapefile has {MOST_FIELDS} columns at most")
        self.aside = f"{self.path}/.aside-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, folder = _place(self.aside)
        system.create_dir(folder, recursive=True)
        open_: dict[int, _Part] = {}
        done: list[str] = []
        number, last = 0, POLYGONS[0]

        def close(part: _Part) -> None:
            name = uuid.uuid4().hex
            for end, data in part.files().items():
                with system.open_output_stream(f"{folder}/{name}.{end}") as out:
                    out.write(data)
            done.append(name)

        for batch in iterator:
            by_name = dict(zip(batch.schema.names, batch.columns))
            columns = [_cells(n, letter, w, by_name[n]) for n, (_, letter, w, _) in zip(self.names, self.fields)]
            for i, g in enumerate(by_name[self.geometry]):
                code, content, box = shape_record(g.as_py())
                # a record without a shape goes with those before it
                last = code or last
                part = open_.setdefault(last, _Part(self.fields))
                part.add(code, content, box, [c[i] for c in columns] or [b"%20d" % number])
                number += 1
                if part.bytes >= PART:
                    close(open_.pop(last))
        for part in open_.values():
            close(part)
        return Written(done)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        system, aside = _place(self.aside)
        _, folder = _place(self.path)
        if self.overwrite:
            for f in system.get_file_info(fs.FileSelector(folder, allow_not_found=True)):
                if f.type == fs.FileType.File:
                    system.delete_file(f.path)
        for k, name in enumerate(name for m in messages if m is not None for name in m.parts):
            for end in ("dbf", "cpg", "shp", "shx"):
                system.move(f"{aside}/{name}.{end}", f"{folder}/part-{k:05d}-{name}.{end}")
        self._clear(system, aside)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        self._clear(*_place(self.aside))

    def _clear(self, system: fs.FileSystem, aside: str) -> None:
        if system.get_file_info(aside).type == fs.FileType.Directory:
            system.delete_dir(aside)


def _table_fields(data: bytes) -> tuple[int, int, list[tuple[str, str, int, int]]]:
    """Length of a table's header and of its records, and its fields: name, letter, width, decimals."""
    head, length = struct.unpack_from("<2H", data, 8)
    fields = []
    for at in range(32, head - 1, 32):
        if data[at] == 0x0D:
            break
        name, letter, width, decimals = struct.unpack_from("<11sc4x2B", data, at)
        fields.append((name.split(b"\0")[0].decode("utf-8", "replace").strip(), letter.decode("latin-1"), width, decimals))
    return head, length, fields


def _type(letter: str, decimals: int) -> T.DataType:
    if letter == "N" and not decimals:
        return T.LongType()
    return {"N": T.DoubleType(), "F": T.DoubleType(), "L": T.BooleanType(), "D": T.DateType()}.get(letter, T.StringType())


_ARROW = {"bigint": pa.int64(), "double": pa.float64(), "boolean": pa.bool_(), "date": pa.date32(), "string": pa.string()}


def _value(raw: bytes, letter: str, decimals: int, encoding: str):
    """A field's value; blanks (or stars, as others write them) are null, but for text."""
    if letter == "L":
        return {b"T": True, b"t": True, b"Y": True, b"y": True, b"F": False, b"f": False, b"N": False, b"n": False}.get(raw[:1])
    text = raw.strip(b" \0")
    if letter in "NF":
        if not text.strip(b"*"):
            return None
        if letter == "F" or decimals:
            return float(text)
        return int(text) if text.lstrip(b"+-").isdigit() else int(float(text))
    if letter == "D":
        return datetime.date(int(text[:4]), int(text[4:6]), int(text[6:8])) if text.strip(b"0") else None
    return None if raw[:1] == b"\0" else raw.rstrip(b" \0").decode(encoding, "replace")


def _inside(point: np.ndarray, ring: np.ndarray) -> bool:
    """Whether a ring holds a point, by crossings of the ray to its right."""
    a, b = ring[:-1], ring[1:]
    cross = (a[:, 1] > point[1]) != (b[:, 1] > point[1])
    a, b = a[cross], b[cross]
    x = a[:, 0] + (point[1] - a[:, 1]) * (b[:, 0] - a[:, 0]) / (b[:, 1] - a[:, 1])
    return bool(np.count_nonzero(x > point[0]) % 2)


def _holds(shell: np.ndarray, hole: np.ndarray) -> bool:
    """Whether a shell holds a hole, by most of the middles of its sides, as corners may touch."""
    if (hole.min(axis=0) < shell.min(axis=0)).any() or (hole.max(axis=0) > shell.max(axis=0)).any():
        return False
    middles = (hole[:-1] + hole[1:]) / 2
    return 2 * sum(_inside(p, shell) for p in middles) > len(middles)


def grouped(rings: list[np.ndarray]) -> list[list[np.ndarray]]:
    """Rings in any order as polygons: each shell (clockwise) with its holes, a hole to the least shell that holds it.

    A hole that no shell holds stands as a shell.
    """
    areas = [_area(r) for r in rings]
    shells = sorted((i for i, a in enumerate(areas) if a <= 0), key=lambda i: -areas[i])
    of = {i: [rings[i]] for i in range(len(rings)) if areas[i] <= 0}
    for i, a in enumerate(areas):
        if a > 0:
            to = shells[0] if len(shells) == 1 else next((s for s in shells if -areas[s] >= a and _holds(rings[s], rings[i])), None)
            if to is None:
                of[i] = [rings[i]]
            else:
                of[to].append(rings[i])
    return [of[i] for i in sorted(of)]


def shape_wkb(content: bytes) -> bytes | None:
    """A record's shape as WKB; null for none."""
    (code,) = struct.unpack_from("<i", content, 0)
    if code == NULL:
        return None
    if code in POINTS:
        return struct.pack("<BI", 1, 1) + content[4:20]
    line = lambda xy: struct.pack("<I", len(xy)) + xy.tobytes()
    if code in MULTIPOINTS:
        (n,) = struct.unpack_from("<i", content, 36)
        return struct.pack("<BII", 1, 4, n) + b"".join(struct.pack("<BI", 1, 1) + content[40 + 16 * i : 56 + 16 * i] for i in range(n))
    if code not in (*LINES, *POLYGONS):
        raise ValueError(f"Shapes of type {code} are not supported")
    parts, points = struct.unpack_from("<2i", content, 36)
    starts = [*np.frombuffer(content, "<i4", parts, 44).tolist(), points]
    xy = np.frombuffer(content, "<f8", 2 * points, 44 + 4 * parts).reshape(-1, 2)
    rings = [xy[a:b] for a, b in zip(starts, starts[1:]) if b > a]
    if not rings:
        return None
    if code in LINES:
        one = [struct.pack("<BI", 1, 2) + line(r) for r in rings]
        kind = 5
    else:
        one = [struct.pack("<BII", 1, 3, len(p)) + b"".join(map(line, p)) for p in grouped(rings)]
        kind = 6
    return one[0] if len(one) == 1 else struct.pack("<BII", 1, kind, len(one)) + b"".join(one)


@dataclass
class Records(InputPartition):
    """Records of a part, by number."""

    part: str
    first: int
    last: int

    def __post_init__(self):
        super().__init__((self.part, self.first, self.last))


class ShapefileReader(DataSourceReader):
    def __init__(self, path: str, geometry: str, schema: T.StructType, records: int, encoding: str | None):
        self.path, self.geometry, self.schema, self.records, self.encoding = path, geometry, schema, records, encoding

    def partitions(self) -> list[InputPartition]:
        """Ranges of records by the sizes of the indexes alone."""
        system, parts = _parts(self.path)
        sizes = system.get_file_info([f"{p}.shx" for p in parts])
        if missing := [f.path for f in sizes if f.type != fs.FileType.File]:
            raise ValueError(f"A shapefile without its index: {missing[0]}")
        return [Records(p, a, min(a + self.records, n)) for p, f in zip(parts, sizes) for n in [(f.size - 100) // 8] for a in range(0, n, self.records)] or [Records("", 0, 0)]

    def read(self, partition: Records) -> Iterator[pa.RecordBatch]:
        if partition.last == partition.first:
            return
        (system, _), part = _place(self.path), partition.part
        with system.open_input_file(f"{part}.shx") as index, system.open_input_file(f"{part}.shp") as shapes, system.open_input_file(f"{part}.dbf") as table:
            n = partition.last - partition.first
            at = np.frombuffer(index.read_at(8 * n, 100 + 8 * partition.first), ">i4").reshape(n, 2).astype(np.int64) * 2
            head, length, fields = _table_fields(table.read_at(struct.unpack("<H", table.read_at(2, 8))[0], 0))
            encoding = self.encoding or _encoding(system, part)
            # bytes up to each record, by which ranges of about READ are cut
            upto = np.cumsum(at[:, 1] + 8 + length)
            a = 0
            while a < n:
                b = max(a + 1, int(np.searchsorted(upto, (upto[a - 1] if a else 0) + READ, "right")))
                rows = table.read_at(length * (b - a), head + length * (partition.first + a))
                live = [i for i in range(b - a) if rows[i * length : i * length + 1] != b"*"]
                yield self._batch(shapes, at[a:b], rows, length, fields, live, encoding)
                a = b

    def _batch(self, shapes, at: np.ndarray, rows: bytes, length: int, fields: list, live: list[int], encoding: str) -> pa.RecordBatch:
        out, begin = {}, 1
        for name, letter, width, decimals in fields:
            if name in self.schema.names and name != self.geometry:
                kind = self.schema[name].dataType.simpleString()
                got = [_value(rows[i * length + begin : i * length + begin + width], letter, decimals, encoding) for i in live]
                out[name] = pa.array(got, _ARROW[kind])
            begin += width
        if self.geometry in self.schema.names:
            low, high = int(at[:, 0].min()), int((at[:, 0] + 8 + at[:, 1]).max())
            # the records of a range lie together but for files with gaps
            if high - low <= 2 * int((at[:, 1] + 8).sum()):
                data = shapes.read_at(high - low, low)
                found = [data[x - low + 8 : x - low + 8 + size] for x, size in at[live].tolist()]
            else:
                found = [shapes.read_at(size, x + 8) for x, size in at[live].tolist()]
            out[self.geometry] = pa.array([shape_wkb(x) for x in found], pa.binary())
        for f in self.schema:
            if f.name not in out:
                out[f.name] = pa.nulls(len(live), pa.binary() if f.name == self.geometry else _ARROW[f.dataType.simpleString()])
        return pa.RecordBatch.from_arrays([out[n] for n in self.schema.names], names=self.schema.names)


def _parts(path: str) -> tuple[fs.FileSystem, list[str]]:
    """Paths of a folder's parts, or of the one named, without ending."""
    system, place = _place(path)
    if system.get_file_info(place).type == fs.FileType.File:
        return system, [place[: -len(".shp")]]
    found = system.get_file_info(fs.FileSelector(place))
    return system, sorted(f.path[: -len(".shp")] for f in found if f.path.lower().endswith(".shp"))


@lru_cache(maxsize=64)
def _codec(name: str) -> str:
    """The codec of a code page as ``.cpg`` files name it; UTF-8 where it is unknown."""
    for x in (name, f"cp{name}", name.replace(" ", "-")):
        try:
            return codecs.lookup(x).name
        except LookupError:
            pass
    return "utf-8"


def _encoding(system: fs.FileSystem, part: str) -> str:
    if system.get_file_info(f"{part}.cpg").type != fs.FileType.File:
        return "utf-8"
    with system.open_input_file(f"{part}.cpg") as f:
        return _codec(f.read().decode("latin-1").strip())


class ShapefileSource(DataSource):
    """Options: ``path``, a folder that all executors share or one ``.shp``; ``geometry``, the column of shapes (``geometry``).

    For reading also ``records``, those of a task, and ``encoding``, where ``.cpg`` files are not to be believed.
    """

    @classmethod
    def name(cls) -> str:
        return SHAPEFILE

    @property
    def geometry(self) -> str:
        return self.options.get("geometry", "geometry")

    def schema(self) -> T.StructType:
        system, parts = _parts(self.options["path"])
        if not parts:
            raise ValueError(f"No shapefile in {self.options['path']}")
        with system.open_input_file(f"{parts[0]}.dbf") as f:
            fields = _table_fields(f.read_at(struct.unpack("<H", f.read_at(2, 8))[0], 0))[2]
        return T.StructType([*[T.StructField(n, _type(letter, d)) for n, letter, _, d in fields if n != self.geometry], T.StructField(self.geometry, T.BinaryType())])

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return ShapefileReader(self.options["path"], self.geometry, schema, int(self.options.get("records", RECORDS)), self.options.get("encoding"))

    def writer(self, schema: T.StructType, overwrite: bool) -> ShapefileWriter:
        return ShapefileWriter(self.options["path"], self.geometry, schema, overwrite)


def read(spark: SparkSession, path: str, geometry: str = "geometry", **options) -> DataFrame:
    """Features of a folder of shapefiles or of one; a folder without any is an error."""
    register(spark)
    return spark.read.format(SHAPEFILE).option("geometry", geometry).options(**options).load(path)


def write(df: DataFrame, path: str, geometry: str = "geometry", mode: str = "append") -> None:
    """Write features as shapefile parts into the folder ``path``."""
    register(df.sparkSession)
    df.write.format(SHAPEFILE).option("geometry", geometry).mode(mode).save(path)
