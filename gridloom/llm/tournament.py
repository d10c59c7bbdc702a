"""Sorted runs in the shared folder, merged by k-way tournament trees.

Tasks write sorted runs of bounded length as Arrow files of small blocks. The
order's whole range is cut into key ranges, and each range of all runs is
merged by a task of its own, which holds one block of each run. A range of
more than ``Sizes.fan`` runs is merged in rounds, each run of a round from that
many of the round before.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, drop_cut


@dataclass(frozen=True)
class Sizes:
    """Runs that one tree merges at most, rows of a block, of a run (40 bytes each), and of a key range that is aimed at."""

    fan: int = 64
    block: int = 8192
    run_rows: int = 1 << 20
    range_rows: int = 1 << 20


Key = tuple[int, int]


def merge(sources: list[Iterator[tuple]]) -> Iterator[tuple]:
    """Rows of sorted sources in order, by a tree of losers: a winner is replaced by its source's next row, which plays the losers on its way up."""
    end = (float("inf"),)
    k = 1 << max(0, len(sources) - 1).bit_length()
    heads = [next(s, end) for s in sources] + [end] * (k - len(sources))
    best, losers = [0] * k + list(range(k)), [0] * k
    for node in range(k - 1, 0, -1):
        a, b = best[2 * node], best[2 * node + 1]
        best[node], losers[node] = (a, b) if heads[a] <= heads[b] else (b, a)
    w = best[1]
    while heads[w] is not end:
        yield heads[w]
        heads[w] = next(sources[w], end)
        node = (w + k) >> 1
        while node:
            if heads[losers[node]] < heads[w]:
                losers[node], w = w, losers[node]
            node >>= 1


def write_run(folder: str, blocks: Iterator[list[np.ndarray]]) -> tuple[str, int]:
    """Write blocks of sorted rows, equally many in all but the last, (columns of longs) as a file; its URI and its count of rows."""
    system, path = fs.FileSystem.from_uri(folder)
    system.create_dir(path, recursive=True)
    name, n, out = f"{uuid.uuid4().hex}.run", 0, None
    with system.open_output_stream(f"{path}/{name}") as sink:
        for columns in blocks:
            batch = pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=[f"c{i}" for i in range(len(columns))])
            out = out or pa.ipc.new_file(sink, batch.schema)
            out.write_batch(batch)
            n += batch.num_rows
        if out:
            out.close()
    return f"{folder}/{name}", n


def read_run(uri: str, first: int, count: int) -> Iterator[tuple]:
    """Rows of a part of a run, a block at a time."""
    system, path = fs.FileSystem.from_uri(uri)
    with system.open_input_file(path) as f, pa.ipc.open_file(f) as blocks:
        at, last, block = first, first + count, blocks.get_batch(0).num_rows
        while at < last:
            a = at % block
            batch = blocks.get_batch(at // block).slice(a, min(block - a, last - at))
            yield from zip(*(c.to_pylist() for c in batch.columns))
            at += batch.num_rows


def _blocks(rows: Iterator[tuple], block: int) -> Iterator[list[np.ndarray]]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == block:
            yield [np.array(c, np.int64) for c in zip(*held)]
            held = []
    if held:
        yield [np.array(c, np.int64) for c in zip(*held)]


_INDEX = "part int, uri string, first long, count long"
_INDEX_SCHEMA = pa.schema([("part", pa.int32()), ("uri", pa.string()), ("first", pa.int64()), ("count", pa.int64())])


def _places(columns: list[np.ndarray], bounds: list[Key]) -> list[int]:
    """Where each bound, a key of the first two columns, would stand in a sorted run."""
    out = []
    for s, d in bounds:
        a, b = np.searchsorted(columns[0], s), np.searchsorted(columns[0], s, side="right")
        out.append(int(a + np.searchsorted(columns[1][a:b], d)))
    return out


def write_runs(rows: DataFrame, folder: str, bounds: list[Key], sizes: Sizes) -> DataFrame:
    """Write ``rows`` (columns of longs, the order's first) as sorted runs; a row for each run's part of each key range between ``bounds``."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        size = 0

        def flush() -> pa.RecordBatch:
            columns = [np.concatenate(c) for c in zip(*held)]
            order = np.lexsort(columns[::-1])
            columns = [c[order] for c in columns]
            uri, n = write_run(folder, ([c[i : i + sizes.block] for c in columns] for i in range(0, size, sizes.block)))
            ends = [0, *_places(columns, bounds), n]
            found = [(j, uri, a, b - a) for j, (a, b) in enumerate(zip(ends, ends[1:])) if b > a]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), _INDEX_SCHEMA.types)], schema=_INDEX_SCHEMA)

        for batch in it:
            a = 0
            while a < batch.num_rows:
                part = batch.slice(a, sizes.run_rows - size)
                held.append([c.to_numpy() for c in part.columns])
                size += part.num_rows
                a += part.num_rows
                if size == sizes.run_rows:
                    yield flush()
                    held, size = [], 0
        if size:
            yield flush()

    return cut(rows.mapInArrow(run, _INDEX), "rs-index")


def _grouped(index: DataFrame, fan: int) -> DataFrame:
    """Runs of each range by ``fan`` to a group; the groups are dealt to tasks by number, as their few bytes say nothing of their work."""
    numbered = index.withColumn("run", F.row_number().over(Window.partitionBy("part").orderBy("uri", "first")) - 1)
    groups = numbered.groupBy("part", F.floor(F.col("run") / fan).alias("group")).agg(F.collect_list(F.struct("uri", "first", "count")).alias("runs"))
    wide = index.groupBy("part").agg(F.ceil(F.count("*") / fan).alias("n")).agg(F.sum("n")).first()[0] or 1
    return groups.repartition(min(wide, MOST_TASKS), "part", "group")


#: Tasks that the groups of a round are dealt to at most.
MOST_TASKS = 20_000


def merge_runs(index: DataFrame, folder: str, sizes: Sizes) -> DataFrame:
    """Rounds of merging until each range has ``fan`` runs at most."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for part, runs in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                uri, n = write_run(folder, _blocks(merge([read_run(r["uri"], r["first"], r["count"]) for r in runs]), sizes.block))
                yield pa.RecordBatch.from_pydict({"part": [part], "uri": [uri], "first": [0], "count": [n]}, schema=_INDEX_SCHEMA)

    while (index.groupBy("part").count().agg(F.max("count")).first()[0] or 0) > sizes.fan:
        new = cut(_grouped(index, sizes.fan).select("part", "runs").mapInArrow(run, _INDEX), "rs-index")
        drop_cut(index)
        index = new
    return index


def ranked_rows(index: DataFrame, draw: int, names: list[str], sizes: Sizes) -> DataFrame:
    """The first ``draw`` rows of all runs as columns ``names`` and their ``rank``; each range stops at its share, ranges beyond are never read."""
    totals = index.groupBy("part").agg(F.sum("count").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range of a million rows
    starts = totals.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before")).where(F.col("before") < draw)
    schema = pa.schema([*((n, pa.int64()) for n in names), ("rank", pa.int64())])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for runs, skipped in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rank, most = skipped, draw - skipped
                rows = merge([read_run(r["uri"], r["first"], r["count"]) for r in runs])
                for columns in _blocks((row for _, row in zip(range(most), rows)), sizes.block):
                    n = len(columns[0])
                    yield pa.RecordBatch.from_arrays([*(pa.array(c) for c in columns), pa.array(np.arange(rank + 1, rank + n + 1))], schema=schema)
                    rank += n

    ddl = ", ".join(f"{n} long" for n in [*names, "rank"])
    wanted = _grouped(index, sizes.fan).join(F.broadcast(starts), "part")
    return wanted.select("runs", "before").mapInArrow(run, ddl)
