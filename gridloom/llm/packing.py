"""Packing documents into token windows by multiway differencing (operator 7).

Each task packs its own documents, shard after shard of about 256 windows, so
no text and no ids are shuffled and a lost task is simply run again. A
document's ids get its end id; a document longer than a window fills whole
windows, and what remains is cut into pieces of at most :data:`PIECE` ids. The
pieces of a shard are dealt by the Karmarkar-Karp multiway differencing method:
the two partial partitions with the widest spread are merged, largest sum to
smallest, so their imbalances oppose; the windows end near-equal. The count of
windows starts at the least possible and rises whenever a window exceeds
capacity. Neighbouring pieces of a few ids go as one.

A task's last shard is mostly not full. Its pieces (their places, sizes and
checksums, never ids) go on to a next round, where :data:`FAN` tasks' pieces
meet in one, are packed in the same way, and leave one last shard again; so the
rounds grow with the logarithm of the count of tasks, a task holds one shard at
a time, and only the last shard of the last round has room to spare.

Rows: a null or empty text has its end id alone. Null and repeated ``doc_id``
values are carried as they are; each row is packed once. Empty input: no rows.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens
from .common import cut, small

WINDOW = 4096
#: Ids of a piece at most, of the documents that don't fill a window.
PIECE = 1024
#: Neighbouring pieces are dealt as one until they have so many ids.
LEAST_ITEM = 32
#: Windows of a shard.
SHARD = 256
#: Tasks of one round whose last shards meet in one task of the next.
FAN = 16


def differencing(sizes: list[int], k: int) -> tuple[np.ndarray, np.ndarray]:
    """Karmarkar-Karp: a part of 0..k-1 for each size, and the sums of the parts."""
    n = len(sizes)
    heap = [(-s, i) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    made: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def of(i: int) -> tuple[np.ndarray, np.ndarray]:
        if i in made:
            return made.pop(i)
        sums, slots = np.zeros(k, np.int64), np.full(k, -1, np.int64)
        sums[0], slots[0] = sizes[i], i
        return sums, slots

    # a slot is a node; a merged node (numbered from n on) has two below it
    joins: list[tuple[int, np.ndarray, np.ndarray]] = []
    nodes, key = n, n
    while len(heap) > 1:
        a_sums, a_slots = of(heapq.heappop(heap)[1])
        b_sums, b_slots = of(heapq.heappop(heap)[1])
        sums, other = a_sums + b_sums[::-1], b_slots[::-1]
        slots = np.where(a_slots < 0, other, a_slots)
        two = np.flatnonzero((a_slots >= 0) & (other >= 0))
        if len(two):
            joins.append((nodes, a_slots[two], other[two]))
            slots[two] = np.arange(nodes, nodes + len(two))
            nodes += len(two)
        order = np.argsort(-sums, kind="stable")
        made[key] = sums[order], slots[order]
        heapq.heappush(heap, (-int(sums[order[0]] - sums[order[-1]]), key))
        key += 1
    part = np.zeros(max(nodes, 1), np.int64)
    sums, slots = of(heap[0][1])
    part[slots[slots >= 0]] = np.flatnonzero(slots >= 0)
    for first, left, right in reversed(joins):
        up = part[first : first + len(left)]
        part[left], part[right] = up, up
    return part[:n], sums


def pack(sizes: list[int], capacity: int = WINDOW) -> tuple[np.ndarray, int]:
    """A window for each size, and the count of windows; no window over capacity."""
    if not sizes:
        return np.empty(0, np.int64), 0
    k = -(-sum(sizes) // capacity)
    while True:
        part, sums = differencing(sizes, k)
        if sums.max() <= capacity:
            return part, k
        k += max(1, k // 128)


_COLUMNS = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "task")
_PIECES = pa.schema([(c, pa.int64()) for c in _COLUMNS])
_DDL = ", ".join(f"{c} long" for c in _COLUMNS)


class _Shard:
    """Pieces ``(doc_id, start, length, crc32, tokens of the document)`` until there are enough for a shard of windows."""

    def __init__(self, window: int, windows: int, round_: int, task: int):
        self.window, self.windows, self.task = window, windows, task
        # a number of its own for each round, task and window
        self.sequence = (round_ << 56) + (task << 28)
        self.rows: list[tuple] = []
        self.loose: list[tuple] = []
        self.tokens = 0

    def whole(self, piece: tuple) -> None:
        """A piece that fills a window."""
        self.rows.append((*piece, self.sequence, 0, self.task))
        self.sequence += 1

    def add(self, piece: tuple) -> None:
        self.loose.append(piece)
        self.tokens += piece[2]
        if self.tokens >= self.windows * self.window:
            self.flush()

    def flush(self) -> None:
        """Deal the loose pieces to windows."""
        items: list[list[tuple]] = []
        sizes: list[int] = []
        for x in self.loose:
            if items and sizes[-1] < LEAST_ITEM and sizes[-1] + x[2] <= self.window:
                items[-1].append(x)
                sizes[-1] += x[2]
            else:
                items.append([x])
                sizes.append(x[2])
        part, k = pack(sizes, self.window)
        filled = [0] * k
        for item, p in zip(items, part.tolist(), strict=True):
            for x in item:
                self.rows.append((*x, self.sequence + p, filled[p], self.task))
                filled[p] += x[2]
        self.sequence += k
        self.loose, self.tokens = [], 0

    def leave(self) -> None:
        """Give the loose pieces as they are, without a window."""
        self.rows += [(*x, None, None, self.task) for x in self.loose]
        self.loose, self.tokens = [], 0

    def take(self) -> pa.RecordBatch:
        rows, self.rows = self.rows, []
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], schema=_PIECES)


def _pieces(docs: DataFrame, tokenizer: str, end_id: int, window: int, piece: int, shard: int) -> DataFrame:
    """Encode ``docs`` and pack what fills shards; the pieces of each task's last shard have no window yet."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, s = tokens.encoder(tokenizer), _Shard(window, shard, 0, TaskContext.get().partitionId())
        for batch in small(it):
            doc_ids = batch.column(0).to_pylist()
            for row, ids, bounds in encoder.column(batch.column(1), end_id):
                raw, ends = memoryview(ids).cast("B"), bounds.tolist()
                for j in range(len(ends) - 1):
                    first, total, at = ends[j], ends[j + 1] - ends[j], 0
                    of = lambda a, b: (doc_ids[row + j], a, b - a, zlib.crc32(raw[4 * (first + a) : 4 * (first + b)]), total)  # noqa: B023, E731
                    while total - at >= window:
                        s.whole(of(at, at + window))
                        at += window
                    rest = total - at
                    parts = -(-rest // piece)
                    for i in range(parts):
                        s.add(of(at + rest * i // parts, at + rest * (i + 1) // parts))
                if len(s.rows) >= 20_000:
                    yield s.take()
        s.leave()
        if s.rows:
            yield s.take()

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, _DDL)


def _next_round(loose: DataFrame, round_: int, window: int, shard: int, last: bool) -> DataFrame:
    """Pack pieces whose ``task`` is that of this round; each task's last shard is packed too if this is the ``last`` round."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = None
        for batch in it:
            for *piece, _, _, task in zip(*(c.to_pylist() for c in batch.columns)):
                if s is None or s.task != task:
                    if s is not None:
                        s.leave()
                        yield s.take()
                    s = _Shard(window, shard, round_, task)
                s.add(tuple(piece))
                if len(s.rows) >= 20_000:
                    yield s.take()
        if s is not None:
            s.flush() if last else s.leave()
            if s.rows:
                yield s.take()

    # the order makes a task that runs again give the same windows
    return loose.repartition("task").sortWithinPartitions("task", "doc_id", "start", "ids_crc32", "doc_tokens").mapInArrow(run, _DDL)


def pack_documents(docs: DataFrame, tokenizer: str = tokens.DEFAULT, end_id: int = 2, window: int = WINDOW, piece: int = PIECE, shard: int = SHARD) -> DataFrame:
    """``docs(doc_id, text)`` -> a row for each piece, with its place in a window.

    ``sequence_id`` holds the round, the task and a running number; it is unique, but has gaps.
    """
    made = cut(_pieces(docs, tokenizer, end_id, window, piece, shard), "pk-pieces")
    done, round_ = made.where("sequence_id is not null"), 0
    while True:
        loose = made.where("sequence_id is null")
        tasks = loose.agg(F.max("task")).first()[0]
        if tasks is None:
            return done.select(*_COLUMNS[:-1])
        round_ += 1
        meet = loose.withColumn("task", F.floor(F.col("task") / FAN))
        made = cut(_next_round(meet, round_, window, shard, last=tasks < FAN), "pk-pieces")
        done = done.unionAll(made.where("sequence_id is not null"))
