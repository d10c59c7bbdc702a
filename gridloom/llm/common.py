"""Helpers shared by the training-data operators.

Everything an operator leaves for a later step goes to the folder that all
executors share (``gridloom.shared``); nothing is kept on one machine.
"""

from __future__ import annotations

import contextvars
import ctypes
import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom import shared
from gridloom.shared import drop_cut, drop_path, fresh, shared_path

__all__ = ["drop_cut", "drop_path", "fresh", "shared_path"]

#: A-Z to a-z and the white space of a word boundary to blanks, for ``translate``.
FOLD_FROM = "ABCDEFGHIJKLMNOPQRSTUVWXYZ\t\n\x0b\x0c\r"
FOLD_TO = "abcdefghijklmnopqrstuvwxyz     "


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the input folder, through Spark's reader only."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


#: Rows that a step over texts gets at once. Texts are long: Spark's usual 10 000 would be tens of megabytes, held twice by the JVM and twice by Python.
BATCH_ROWS = 1000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def cut(df: DataFrame, label: str) -> DataFrame:
    """:func:`gridloom.shared.cut`, in batches of at most :data:`BATCH_ROWS` rows for steps in Python.

    What is cut already stays as it is.
    """
    if "_gridloom_path" in df.__dict__:
        return df
    conf = df.sparkSession.conf
    was = conf.get(_BATCH)
    conf.set(_BATCH, str(min(BATCH_ROWS, int(was) if int(was) > 0 else BATCH_ROWS)))
    try:
        out = shared.cut(df, label)
    finally:
        conf.set(_BATCH, was)
    for made in _made.get()[-1:]:
        made.append(out)
    return out


def distilled(result: DataFrame, ids: DataFrame, label: str) -> DataFrame:
    """``ids``, which come from ``result``, cut; and then ``result`` deleted."""
    out = cut(ids, label)
    drop_cut(result)
    return out


#: Tables that the tidy steps under way have cut, the innermost step's last.
_made: contextvars.ContextVar[tuple[list[DataFrame], ...]] = contextvars.ContextVar("made", default=())


def tidy(label: str):
    """Wrap a step whose result is small: the result is cut, and all that the step has cut on the way is deleted."""

    def wrap(step):
        @functools.wraps(step)
        def run(*args, **options) -> DataFrame:
            made: list[DataFrame] = []
            token = _made.set((*_made.get(), made))
            try:
                out = cut(step(*args, **options), label)
            finally:
                _made.reset(token)
            for df in made:
                if df is not out:
                    drop_cut(df)
            for outer in _made.get()[-1:]:
                outer.append(out)
            return out

        return run

    return wrap


#: Ids that are broadcast at most (some 16 bytes each); beyond, both sides are shuffled.
MOST_BROADCAST = 2_000_000


def keep_ids(docs: DataFrame, ids: DataFrame, key: str = "doc_id", how: str = "left_semi") -> DataFrame:
    """Rows of ``docs`` whose key is among ``ids``, or with ``left_anti`` is not; all columns stay as they are.

    ``ids`` has one column and was written by :func:`cut`, so its rows are
    counted from file footers: up to :data:`MOST_BROADCAST` they are broadcast
    and no text moves; more are joined by shuffle.
    """
    (other,) = fresh(docs, "key")
    ids = ids.select(F.col(ids.columns[0]).alias(other))
    if ids.count() <= MOST_BROADCAST:
        ids = F.broadcast(ids)
    return docs.join(ids, F.col(key) == F.col(other), how)


def utf8(column: pa.Array) -> list:
    """The bytes of each string of an Arrow column; null stays None."""
    if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
        return column.cast(pa.large_binary()).to_pylist()
    return column.cast(pa.binary()).to_pylist()


#: Bytes of texts that are worked on at once; a longer text is a slice of its own.
SLICE_BYTES = 2 << 20


def text_slices(texts: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """A column's texts in slices: number of the first row, UTF-8 bytes, and where each text begins and the last one ends.

    A null is an empty text. Nothing is copied unless the column has nulls.
    """
    if texts.null_count:
        texts = texts.fill_null("")
    if not len(texts):
        return
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, ends, raw = texts.buffers()
    bounds = np.frombuffer(ends, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.empty(0, np.uint8)
    a = 0
    while a < len(texts):
        b = max(a + 1, int(np.searchsorted(bounds, bounds[a] + most, side="right")) - 1)
        yield a, data[bounds[a] : bounds[b]], bounds[a : b + 1] - bounds[a]
        a = b


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words with good avalanche (shift, multiply, shift)."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


_STEP = np.uint64(0x9E3779B97F4A7C15)
#: Base of the polynomial word hash (odd, so that it has an inverse), and a random value for each byte.
_BASE = 0x5851F42D4C957F2D
_BYTE = np.random.default_rng(64).integers(0, 1 << 64, 256, dtype=np.uint64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
#: Bytes of texts whose shingles are made at once (some 50 times as much memory); a longer text is a slice of its own.
SHINGLE_BYTES = 1 << 18


@functools.lru_cache(1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of the base and of its inverse."""
    pair = []
    for base in (_BASE, pow(_BASE, -1, 1 << 64)):
        p = np.full(n, base, np.uint64)
        p[0] = 1
        pair.append(np.cumprod(p, dtype=np.uint64))
    return pair[0], pair[1]


def word_hashes(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words ``[^\\x20\\x09-\\x0D]+`` of texts, A-Z lower-cased, and where each text's begin and the last one's end."""
    if len(data) > 2 * SHINGLE_BYTES:
        return _long_text(data, bounds)
    return _word_hashes(data, bounds)


def _long_text(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """:func:`word_hashes` in steps that end at a blank or a text's begin."""
    parts, counts, a = [], np.zeros(len(bounds), np.int64), 0
    while a < len(data):
        b = min(len(data), a + SHINGLE_BYTES)
        if b < len(data):
            blanks = np.flatnonzero(_BLANK[data[a:b]])
            while not len(blanks) and b < len(data):  # a word longer than a step
                b = min(len(data), b + SHINGLE_BYTES)
                blanks = np.flatnonzero(_BLANK[data[a:b]])
            if b < len(data):
                b = a + int(blanks[-1]) + 1
        inside = np.clip(bounds - a, 0, b - a)
        h, at = _word_hashes(data[a:b], inside)
        parts.append(h)
        counts += at
        a = b
    return np.concatenate(parts), counts


def _word_hashes(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    solid = ~_BLANK[data]
    if not solid.any():
        return np.empty(0, np.uint64), np.zeros(len(bounds), np.int64)
    first = np.zeros(len(data) + 1, bool)
    first[bounds] = True
    begin = solid & first[:-1]
    begin[1:] |= solid[1:] & ~solid[:-1]
    stop = solid & first[1:]
    stop[-1] = solid[-1]
    stop[:-1] |= solid[:-1] & ~solid[1:]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(stop)
    size = max(len(data), SHINGLE_BYTES)
    up, down = _powers(1 << (size - 1).bit_length())
    sums = np.cumsum(_BYTE[_LOWER[data]] * up[: len(data)], dtype=np.uint64)
    before = np.where(starts > 0, sums[starts - 1], np.uint64(0))
    return mix64((sums[ends] - before) * down[starts] + (ends - starts).astype(np.uint64)), np.searchsorted(starts, bounds)


def shingle_sets(data: np.ndarray, bounds: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct 64-bit hashes of the k-word shingles of texts, and where each text's begin and the last one's end.

    Fewer than k words: the whole sequence is one shingle. No word: none.
    """
    h, at = word_hashes(data, bounds)
    n = np.diff(at)
    made = np.where(n > 0, np.maximum(n - k + 1, 1), 0)
    ends = np.concatenate(([0], np.cumsum(made)))
    out = np.empty(ends[-1], np.uint64)
    # windows of k words; those that reach into the next text are left out
    own = np.repeat(n >= k, made)
    if own.any():
        last = np.zeros(len(h) + 1, bool)
        last[at] = True
        cross = last[1:].copy()
        roll = np.full(len(h) - k + 1, k, np.uint64)
        for j in range(k):
            roll = roll * _STEP + h[j : j + len(roll)]
        bad = np.zeros(len(roll), bool)
        for j in range(k - 1):
            bad |= cross[j : j + len(roll)]
        out[own] = roll[~bad]
    for i in np.flatnonzero((n > 0) & (n < k)).tolist():
        x = int(n[i])
        for w in h[at[i] : at[i + 1]].tolist():
            x = (x * int(_STEP) + w) % (1 << 64)
        out[ends[i]] = x
    out = mix64(out)
    for a, b in zip(ends.tolist(), ends[1:].tolist()):
        out[a:b].sort()
    new = np.ones(len(out), bool)
    np.not_equal(out[1:], out[:-1], out=new[1:])
    new[ends[:-1][made > 0]] = True
    return out[new], np.concatenate(([0], np.cumsum(new)))[ends]


def small(it: Iterator[pa.RecordBatch], rows: int = BATCH_ROWS) -> Iterator[pa.RecordBatch]:
    """Batches of at most ``rows`` rows; one that came is let go before the next is read.

    A Python worker serves many tasks and keeps what it once had, so at a
    task's end unused memory goes back to the system.
    """
    while (batch := next(it, None)) is not None:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)
        batch = None
    pa.default_memory_pool().release_unused()
    _trim(0)


def _trim(keep: int) -> None:
    """Let the C library give back its free memory, where it can."""
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(keep)


def batches(fn, schema: pa.Schema):
    """Wrap ``fn(batch) -> dict of columns`` for ``mapInArrow``."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(it):
            yield pa.RecordBatch.from_pydict(fn(batch), schema=schema)

    return run


def sliced(fn, schema: pa.Schema, most: int = SHINGLE_BYTES):
    """Wrap ``fn(other columns, bytes, bounds) -> columns`` for ``mapInArrow`` on batches whose last column is the text.

    ``fn`` sees a slice of :func:`text_slices` at a time, so a worker's memory
    follows the slice, not the batch.
    """

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(it):
            for row, data, bounds in text_slices(batch.columns[-1], most):
                others = [c.slice(row, len(bounds) - 1) for c in batch.columns[:-1]]
                yield pa.RecordBatch.from_arrays(fn(others, data, bounds), schema=schema)

    return run


def lists(flat: np.ndarray, offsets: np.ndarray) -> pa.ListArray:
    """A column of lists of 64-bit words."""
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(flat.view(np.int64)))
