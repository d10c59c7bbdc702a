"""GeoJSON files of any size, read in byte ranges by many tasks.

A range can begin anywhere: within a string, a number, or five brackets deep. A
first pass tells for each range how many quotes it has and how its brackets
change the depth, once for a range that begins outside a string and once for one
that begins inside. Running sums over the ranges of a file, which are rows of a
few numbers, then give the true state at the start of each, and where the
collection's ``features`` begin. In a second pass each task takes the features
that begin in its range and reads on to the end of the last one.

A file without a ``features`` array in a top-level object holds a feature on
each line; a range takes the lines that begin in it. Ranges are rows, so a lost
executor costs only the ranges it had.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.shared import cut

#: Bytes of a range, of a step when reading on, and of a batch of features; tasks at most.
RANGE, STEP, BATCH, MOST_TASKS = 16 << 20, 1 << 20, 4 << 20, 10_000
#: Longest white space looked for between a key, its colon and its bracket.
GAP = 4096
#: Endings of packed files, which have no ranges.
PACKED = r"\.(gz|bz2|zst|lz4|snappy|deflate)$"

_ARRAY = re.compile(rb'"features"\s*:\s*\[')
_STEP_OF = np.zeros(256, np.int8)
_STEP_OF[[ord("{"), ord("[")]] = 1
_STEP_OF[[ord("}"), ord("]")]] = -1


class _File:
    """Bytes of one file."""

    def __init__(self, uri: str):
        system, path = fs.FileSystem.from_uri(uri)
        self.input = system.open_input_file(path)

    def __enter__(self) -> _File:
        return self

    def __exit__(self, *_) -> None:
        self.input.close()

    def bytes(self, start: int, end: int) -> bytes:
        self.input.seek(start)
        return self.input.read(max(0, end - start))

    def escaped(self, at: int) -> bool:
        """Whether the byte there follows an odd run of backslashes."""
        n, step = 0, 64
        while at - n > 0:
            before = self.bytes(max(0, at - n - step), at - n)
            kept = len(before.rstrip(b"\\"))
            n += len(before) - kept
            if kept:
                break
            step *= 2
        return n % 2 == 1


def _quotes(data: bytes, escaped: bool) -> np.ndarray:
    """Places of the quotes that begin or end a string."""
    a = np.frombuffer(data, np.uint8)
    quotes = np.flatnonzero(a == ord('"'))
    back = np.flatnonzero(a == ord("\\"))
    meant = np.array([0] if escaped else [], np.int64)
    if len(back):
        begin = np.flatnonzero(np.append(True, np.diff(back) != 1))
        length = np.diff(np.append(begin, len(back)))
        after = back[begin] + length
        if escaped and back[0] == 0:
            length[0] += 1
            meant = meant[:0]
        meant = np.append(meant, after[length % 2 == 1])
    return quotes[~np.isin(quotes, meant)] if len(meant) else quotes


def _brackets(data: bytes, quotes: np.ndarray, inside: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the brackets outside strings, and +1 or -1 of each."""
    steps = _STEP_OF[np.frombuffer(data, np.uint8)]
    at = np.flatnonzero(steps)
    at = at[(np.searchsorted(quotes, at) & 1) == inside]
    return at, steps[at].astype(np.int64)


def _summary(file: _File, start: int, end: int) -> dict:
    """What a range does to quotes and depth, and its least deep ``features`` array, for both states it may begin in."""
    data = file.bytes(start, end + GAP)
    arrays = [m.start() for m in _ARRAY.finditer(data) if m.start() < end - start]
    data = data[: end - start]
    quotes = _quotes(data, file.escaped(start))
    out: dict = {"odd": len(quotes) % 2}
    for inside in (0, 1):
        at, steps = _brackets(data, quotes, inside)
        depth = np.append(0, np.cumsum(steps))
        k = np.searchsorted(quotes, arrays)
        keys = [p for p, i in zip(arrays, k, strict=True) if i < len(quotes) and quotes[i] == p and i % 2 == inside]
        found = min(((int(depth[np.searchsorted(at, p)]), start + p) for p in keys), default=(None, None))
        out |= {f"by{inside}": int(depth[-1]), f"depth{inside}": found[0], f"array{inside}": found[1]}
    return out


_SUMMARY = "path string, start long, end long, size long, odd int, by0 long, depth0 long, array0 long, by1 long, depth1 long, array1 long"


def _summaries(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in it:
        for r in batch.to_pylist():
            with _File(r["path"]) as file:
                row = r | _summary(file, r["start"], r["end"])
            types = {"path": pa.string(), "odd": pa.int32()}
            yield pa.RecordBatch.from_arrays([pa.array([x], types.get(n, pa.int64())) for n, x in row.items()], names=list(row))


def _objects(file: _File, start: int, end: int, inside: int, depth: int, array: int) -> Iterator[bytes]:
    """Objects two brackets deep that begin in a range, behind the key of the ``features`` array."""
    data = file.bytes(start, end)
    escaped, base, at_level, begun = file.escaped(start), start, 2, None
    rest: list[bytes] = []
    while data:
        quotes = _quotes(data, escaped)
        at, steps = _brackets(data, quotes, inside)
        after = depth + np.cumsum(steps)
        a = np.frombuffer(data, np.uint8)[at]
        opens = at[(a == ord("{")) & (after == at_level + 1) & (at + base > array)]
        closes = at[(a == ord("}")) & (after == at_level)]
        if rest:
            if len(closes):
                yield b"".join([*rest, data[: closes[0] + 1]])
                return
            rest.append(data)
        else:
            ends = np.searchsorted(closes, opens)
            for o, k in zip(opens.tolist(), ends.tolist(), strict=True):
                if k < len(closes):
                    yield data[o : int(closes[k]) + 1]
                else:
                    begun = o
            if begun is None:
                return
            rest = [data[begun:]]
        inside = (inside + len(quotes)) % 2
        depth = int(after[-1]) if len(after) else depth
        base += len(data)
        escaped = file.escaped(base)
        data = file.bytes(base, base + STEP)
    if rest:
        raise ValueError("A GeoJSON file ends within a feature")


def _lines(file: _File, start: int, end: int) -> Iterator[bytes]:
    """Lines that begin in a range."""
    data = file.bytes(max(0, start - 1), end)
    if start:
        first = data.find(b"\n") + 1
        if not first:
            return
        data = data[first:]
    at = end
    while data and not data.endswith(b"\n"):
        more = file.bytes(at, at + STEP)
        if not more:
            break
        stop = more.find(b"\n") + 1
        data += more[:stop] if stop else more
        at += len(more)
        if stop:
            break
    yield from data.split(b"\n")


def _texts(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def packed(rows: list[bytes]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r.decode("utf-8", "replace") for r in rows], pa.string())], names=["value"])

    for batch in it:
        for r in batch.to_pylist():
            with _File(r["path"]) as file:
                found = _lines(file, r["start"], r["end"]) if r["array"] is None else _objects(file, r["start"], r["end"], r["inside"], r["depth"], r["array"])
                rows: list[bytes] = []
                held = 0
                for text in found:
                    rows.append(text)
                    held += len(text)
                    if held >= BATCH:
                        yield packed(rows)
                        rows, held = [], 0
                if rows:
                    yield packed(rows)


def ranges(spark: SparkSession, path: str, size: int = RANGE) -> DataFrame:
    """Ranges of the files with their state: ``path, start, end, inside, depth, array``; written once."""
    files = spark.read.format("binaryFile").load(path).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("size"))
    files = files.where(~F.lower("path").rlike(PACKED) & (F.col("size") > 0))
    count = files.agg(F.sum(F.ceil(F.col("size") / size))).first()[0] or 1  # type: ignore[index]
    start = F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(size).cast("long")))
    cuts = files.select("path", start.alias("start"), "size").select("path", "start", F.least(F.col("start") + size, "size").alias("end"), "size")
    told = cuts.repartition(min(int(count), MOST_TASKS)).mapInArrow(_summaries, _SUMMARY)
    before = Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    of = lambda name: F.when(F.col("inside") == 0, F.col(f"{name}0")).otherwise(F.col(f"{name}1"))
    told = told.withColumn("inside", (F.coalesce(F.sum("odd").over(before), F.lit(0)) % 2).cast("int"))
    told = told.select("path", "start", "end", "inside", of("by").alias("by"), of("depth").alias("deep"), of("array").alias("at"))
    told = told.withColumn("depth", F.coalesce(F.sum("by").over(before), F.lit(0)))
    array = F.min(F.when(F.col("depth") + F.col("deep") == 1, F.col("at"))).over(Window.partitionBy("path"))
    return cut(told.select("path", "start", "end", "inside", "depth", array.alias("array")), "gj-ranges")


def features(spark: SparkSession, path: str, size: int = RANGE) -> DataFrame:
    """The text of each feature of GeoJSON files, ``value``: of collections in any layout, or one on each line.

    Files can be mixed, kinds within a file can't. Text that is no feature is
    passed over; a collection that ends within a feature is an error, and other
    arrays behind ``features`` are taken for more of it where they hold objects
    of type ``Feature``. Null bytes, empty files and an empty folder give no
    rows. Packed files (``.gz`` and others) are read whole, each by one task.
    """
    told = ranges(spark, path, size)
    tasks = max(1, min(told.count(), MOST_TASKS))
    out = told.repartition(tasks).mapInArrow(_texts, "value string")
    out = out.where(F.get_json_object("value", "$.type") == "Feature")
    files = spark.read.format("binaryFile").load(path).select(F.col("_metadata.file_path").alias("path"))
    if files.where(F.lower("path").rlike(PACKED)).limit(1).count():
        out = out.unionAll(_packed(spark, path))
    return out


def _packed(spark: SparkSession, path: str) -> DataFrame:
    """The text of each feature of packed files."""
    text = spark.read.option("pathGlobFilter", "*.{gz,bz2,zst,lz4,snappy,deflate}").text(path, wholetext=True)
    kind = F.get_json_object("value", "$.type")
    whole = text.where(kind == "FeatureCollection").select(F.explode(F.from_json(F.get_json_object("value", "$.features"), "array<string>")).alias("value"))
    lines = text.where((kind != "FeatureCollection") | kind.isNull()).select(F.explode(F.split("value", "\n")).alias("value")).where(F.get_json_object("value", "$.type") == "Feature")
    return whole.unionAll(lines)
