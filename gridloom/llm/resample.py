"""Resampling towards a target distribution by importance weights (operator 12).

Features are hashed runs of one and two words. A bucket's gain says how much
more frequent it is in the target; a document's weight is the mean gain of its
features, read from an array of all gains. Gumbel noise from the document's id
makes the highest scores a draw without replacement in proportion to the
exponential of the weights.

The draw is exact and stops after its count: eligible rows that may be drawn
become sorted runs (``tournament.py``), whose key ranges are merged by trees
of their own; ranks go on from range to range. The counts of scores, which
set the ranges and the least score drawn, are bounded by the scores there can
be (some 110 000: gains of at most 42 000 either way, noise of 26 000).

Rows: null and empty texts have no features and weight 0. A row with null
``doc_id`` has no score and is not drawn, nor does it count as a document; its
text counts in the corpus. Rows that repeat a ``doc_id`` are drawn each by
itself, ties by place in the table. An empty target weighs all buckets against
nothing. Other columns of the tables are not read.
"""

from __future__ import annotations

import functools
import hashlib
import math
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.shared import numbered

from . import tournament
from .common import cut, drop_cut, drop_path, fresh, shared_path, small, utf8
from .tournament import Sizes

BUCKETS = 10_000
#: Percent of the eligible documents that are drawn, words that an eligible one has at least, seed of the noise.
PERCENT, LEAST_WORDS, SEED = 25, 20, 7
#: Bytes of a text whose words are listed at once.
STEP = 1 << 20

_PLAIN = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: The byte table of crc32, for the blank that joins two words.
_CRC = np.zeros(256, np.uint32)
for _b in range(256):
    _CRC[_b ^ 0xFF] = crc32(bytes([_b])) ^ 0xFFFFFFFF ^ 0x00FFFFFF


def _with_blank(crc: np.ndarray) -> np.ndarray:
    """crc32 of the same bytes and a blank."""
    c = ~crc
    return ~(_CRC[(c ^ np.uint32(32)) & np.uint32(255)] ^ (c >> np.uint32(8)))


def features(text: bytes | None, buckets: int = BUCKETS, step: int = STEP) -> Iterator[tuple[int, np.ndarray]]:
    """Words and buckets of all features of a text, some ``step`` bytes at a time."""
    last, rest = None, b""
    for a in range(0, len(text or b""), step):
        part = rest + text[a : a + step].translate(_PLAIN)
        if a + step < len(text):
            end = part.rfind(b" ") + 1
            part, rest = part[:end], part[end:]
        words = part.split()
        if not words:
            continue
        one = np.fromiter(map(crc32, words), np.uint32, len(words))
        heads, tails = (one[:-1], words[1:]) if last is None else (np.concatenate((last, one[:-1])), words)
        two = np.fromiter(map(crc32, tails, _with_blank(heads).tolist()), np.uint32, len(tails))
        last = one[-1:]
        yield len(words), np.concatenate((one, two)) % np.uint32(buckets)


def bucket_counts(texts: DataFrame, column: str = "text", buckets: int = BUCKETS) -> np.ndarray:
    """Features of all texts in each bucket; tasks send one row for each bucket that they met."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(buckets, np.int64)
        for batch in small(it):
            for text in utf8(batch.column(0)):
                for _, found in features(text, buckets):
                    n += np.bincount(found, minlength=buckets)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at])], names=["bucket", "n"])

    rows = texts.select(F.col(column).cast("string")).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(buckets, np.int64)
    for r in rows:
        out[r.bucket] = r.n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Gain of each bucket in thousandths, rounded down."""
    k, all_s, all_t = len(source), int(source.sum()), int(target.sum())
    share = lambda s, t: float(t + 1) * float(all_s + k) / (float(s + 1) * float(all_t + k))
    return np.array([math.floor(1000 * math.log(share(s, t))) for s, t in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def noise(doc_id: int, seed: int = SEED) -> int:
    """Gumbel noise in thousandths, rounded down, from the id alone."""
    h = int(hashlib.sha256(f"{seed}:{doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


_SCORED = "row long, doc_id long, n_words long, n_features long, weight long, score long"
_SCORED_SCHEMA = pa.schema([(x.split()[0], pa.int64()) for x in _SCORED.split(", ")])


def scored(docs: DataFrame, row: str, gain: np.ndarray, seed: int = SEED, text: str = "text") -> DataFrame:
    """A row for each of ``docs``: number, id, counts of words and features, weight and score."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(it):
            ids, out = batch.column(1).to_pylist(), []
            for doc_id, text_ in zip(ids, utf8(batch.column(2)), strict=True):
                words = n = total = 0
                for w, found in features(text_, len(gain)):
                    words, n, total = words + w, n + len(found), total + int(gain[found].sum())
                weight = total // n if n else 0
                out.append((words, n, weight, None if doc_id is None else weight + noise(doc_id, seed)))
            columns = [pa.array(c, pa.int64()) for c in zip(*out)] if out else [pa.array([], pa.int64())] * 4
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], schema=_SCORED_SCHEMA)

    return docs.select(F.col(row), F.col("doc_id").cast("long"), F.col(text).cast("string")).mapInArrow(run, _SCORED)


def _bounds(counts: list, draw: int, most: int) -> tuple[int, list[tournament.Key]]:
    """The least score that is drawn, and where key ranges of some ``most`` rows begin; a frequent score is cut by ids too."""
    bounds: list[tournament.Key] = []
    seen = held = 0
    for r in sorted(counts, key=lambda r: -r.score):
        if held and held + r.n > most:
            bounds.append((-r.score, r.low))
            held = 0
        parts = -(-r.n // most)
        wide = (r.high - r.low) // parts + 1
        bounds += [(-r.score, r.low + wide * i) for i in range(1, parts)]
        held += r.n if parts == 1 else r.n // parts
        seen += r.n
        if seen >= draw:
            return r.score, bounds
    raise AssertionError("fewer rows than are drawn")


def _drawn(table: DataFrame, percent: int, least_words: int, sizes: Sizes = Sizes()) -> DataFrame:
    """``row, doc_id, n_features, weight, score, rank`` of the rows that are drawn, cut; ``table`` is."""
    spark = table.sparkSession
    eligible = table.where(F.col("score").isNotNull() & (F.col("n_words") >= least_words))
    counts = eligible.groupBy("score").agg(F.count("*").alias("n"), F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).collect()
    draw = percent * sum(r.n for r in counts) // 100
    names = ["lack", "doc_id", "row", "n_features", "weight"]
    if not draw:
        return spark.createDataFrame([], ", ".join(f"{n} long" for n in ("row", "doc_id", "n_features", "weight", "score", "rank")))
    least, bounds = _bounds(counts, draw, sizes.range_rows)
    folder = shared_path(spark, "rs-runs")
    index = tournament.write_runs(eligible.where(F.col("score") >= least).select((-F.col("score")).alias("lack"), *names[1:]), folder, bounds, sizes)
    index = tournament.merge_runs(index, folder, sizes)
    out = cut(tournament.ranked_rows(index, draw, names, sizes).select("row", "doc_id", "n_features", "weight", (-F.col("lack")).alias("score"), "rank"), "rs-drawn")
    drop_path(spark, folder)
    drop_cut(index)
    return out


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED, sizes: Sizes = Sizes()) -> DataFrame:
    """``doc_id, n_features, weight, score, rank`` of every row of ``docs``; rank null where it isn't drawn."""
    (row,) = fresh(docs, "row")
    table, drawn = _ranked(numbered(docs, row, "rs-docs"), row, target, percent, least_words, seed, sizes)
    rest = table
    last = drawn.orderBy(F.desc("rank")).first()
    if last is not None:
        behind = functools.reduce(lambda later, c: (c[0] > c[1]) | (c[0] == c[1]) & later, [(F.col("row"), F.lit(last.row)), (F.col("doc_id"), F.lit(last.doc_id)), (-F.col("score"), F.lit(-last.score))], F.lit(False))
        rest = table.where(F.col("score").isNull() | (F.col("n_words") < least_words) | behind)
    names = ["doc_id", "n_features", "weight", "score"]
    return drawn.select(*names, "rank").unionByName(rest.select(*names, F.lit(None).cast("long").alias("rank")))


def draw_documents(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED, sizes: Sizes = Sizes()) -> DataFrame:
    """The rows of ``docs`` that are drawn, all columns as they are."""
    row, other = fresh(docs, "row", "drawn")
    rows = numbered(docs, row, "rs-docs")
    _, drawn = _ranked(rows, row, target, percent, least_words, seed, sizes)
    return rows.join(drawn.select(F.col("row").alias(other)), F.col(row) == F.col(other), "left_semi").drop(row)


def _ranked(rows: DataFrame, row: str, target: DataFrame, percent: int, least_words: int, seed: int, sizes: Sizes) -> tuple[DataFrame, DataFrame]:
    gain = gains(bucket_counts(rows), bucket_counts(target))
    table = cut(scored(rows, row, gain, seed), "rs-scored")
    return table, _drawn(table, percent, least_words, sizes)
