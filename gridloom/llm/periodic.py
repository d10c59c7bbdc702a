"""Periodic runs of words and texts collapsed to one period of each (operator 13).

A run is a stretch of ``LEAST`` words and of two periods at least, in which
words a period apart are the same and which no neighbouring word continues.
``tandem.py`` finds all runs of a sequence. It sees only the parts of texts
where a run can be: of a run's first words, each ``LEAST // 2`` in a row come
again a period on or back, but for less than that many places in its middle.
Parts of the texts of one slice (:data:`SLICE`) are one sequence, with a symbol
of its own after each part, so that no run crosses from one to the next.

Rows: each by itself, whatever its ``doc_id``; null and empty texts have no
words and collapse to the empty text, and null ``doc_id`` is a row like others.
Memory follows a slice, or the longest text (some 200 bytes a word).
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix64, sliced
from .tandem import tandem_runs

#: Words of a run at least; bytes of texts that are searched at once (a longer text is a slice of its own).
LEAST = 12
SLICE = 1 << 19

_STEP = np.uint64(0x9E3779B97F4A7C15)
Runs = tuple[np.ndarray, np.ndarray, np.ndarray]
#: The words of a document in another order: numbers of its words, from its id and count of words; None leaves it.
Edit = Callable[[int | None, int], np.ndarray | None]


def candidates(words: np.ndarray, docs: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, np.ndarray]:
    """Parts of sequences, given one after the other as numbers of words and of their documents, that hold all runs of ``least`` words and more: where they begin and end."""
    w = max(1, least // 2)
    n = len(words) - w + 1
    if n < 2:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    h = mix64(docs[:n].astype(np.uint64) + np.uint64(1))
    for j in range(w):
        h = h * _STEP + words[j : j + n].astype(np.uint64)
    h = mix64(h)
    own = np.flatnonzero(docs[:n] == docs[w - 1 :])
    order = own[np.argsort(h[own], kind="stable")]
    same = h[order[1:]] == h[order[:-1]]
    again = np.zeros(n, bool)
    again[order[1:][same]] = again[order[:-1][same]] = True
    at = np.flatnonzero(again)
    if not len(at):
        return at, at
    new = np.ones(len(at), bool)
    new[1:] = (np.diff(at) > w) | (docs[at[1:]] != docs[at[:-1]])
    first = np.flatnonzero(new)
    return at[first], at[np.append(first[1:], len(at)) - 1] + w


def runs_of(words: np.ndarray, docs: np.ndarray, least: int = LEAST) -> Runs:
    """Start, length and period of all runs of sequences that follow each other; starts are places among all words."""
    a, b = candidates(words, docs, least)
    if not len(a):
        return a, a, a
    size = b - a + 1
    ends = np.cumsum(size)
    place = np.arange(ends[-1]) - np.repeat(ends - size - a, size)
    s = words[np.minimum(place, len(words) - 1)].astype(np.int64)
    s[ends - 1] = words.max() + 1 + np.arange(len(a))
    start, length, period = tandem_runs(s)
    ok = length >= least
    return place[start[ok]], length[ok], period[ok]


def _kept(n: int, runs: Runs) -> np.ndarray:
    """Which of ``n`` words no run holds behind its first period."""
    start, length, period = runs
    steps = np.zeros(n + 1, np.int64)
    np.add.at(steps, start + period, 1)
    np.add.at(steps, start + length, -1)
    return np.cumsum(steps)[:n] == 0


_RUN = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
_SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("runs", _RUN), ("collapsed", pa.string())])


def _run_slice(others: list[pa.Array], data: np.ndarray, bounds: np.ndarray, least: int, edit: Edit | None) -> list[pa.Array]:
    ids = others[0].to_pylist()
    raw, vocab = data.tobytes(), {}
    words, numbers = [], []
    for doc_id, a, b in zip(ids, bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        own = raw[a:b].split()
        if edit and own and (order := edit(doc_id, len(own))) is not None:
            own = [own[j] for j in order.tolist()]
        words.append(own)
        numbers += [vocab.setdefault(w, len(vocab)) for w in own]
    counts = np.array([len(x) for x in words], np.int64)
    ends = np.cumsum(counts)
    start, length, period = runs_of(np.array(numbers, np.int64), np.repeat(np.arange(len(words)), counts), least)
    order = np.lexsort((period, start))
    start, length, period = start[order], length[order], period[order]
    firsts = np.searchsorted(start, np.append(ends - counts, ends[-1:]))
    texts = []
    for i, own in enumerate(words):
        x = slice(firsts[i], firsts[i + 1])
        start[x] -= ends[i] - counts[i]
        if firsts[i + 1] > firsts[i]:
            keep = _kept(len(own), (start[x], length[x], period[x]))
            own = [own[j] for j in np.flatnonzero(keep).tolist()]
        texts.append(b" ".join(own))
    fields = [pa.array(x, pa.int64()) for x in (start, length, period)]
    runs = pa.ListArray.from_arrays(pa.array(firsts.astype(np.int32)), pa.StructArray.from_arrays(fields, fields=list(_RUN.value_type)))
    return [others[0], pa.array(counts), runs, pa.array(texts, pa.binary()).cast(pa.string())]


def periodic_runs(docs: DataFrame, least: int = LEAST, edit: Edit | None = None) -> DataFrame:
    """``doc_id, n_words, runs, collapsed`` of each row of ``docs(doc_id, text)``.

    ``runs`` (start, length and period in words) are in order of start, then
    period. ``collapsed`` has the words that no run holds behind its first
    period, joined by blanks. With ``edit`` the words are put in another order
    first.
    """
    named = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return named.mapInArrow(sliced(functools.partial(_run_slice, least=least, edit=edit), _SCHEMA, SLICE), "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")


def repeated_tail(doc_id: int | None, n: int) -> np.ndarray | None:
    """Every tenth document, by its id's crc32, ends in copies of one piece: the cases that the query plants."""
    if doc_id is None:
        return None
    h = crc32(str(doc_id).encode())
    if h % 10:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    order = np.arange(n)
    order[a:] = a + (order[a:] - a) % p
    return order


def run_digests(runs: DataFrame) -> DataFrame:
    """Counts, the longest run and digests of what :func:`periodic_runs` gives."""
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))), "")
    out = runs.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    length, period = F.col("best.length"), -F.col("best.period")
    return out.select("doc_id", "n_runs", (-F.col("best.start")).alias("start"), length.alias("length"), period.alias("period"), F.expr("best.length * 1000 div -best.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
