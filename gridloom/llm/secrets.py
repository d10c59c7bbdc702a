"""Secrets in texts: fixed patterns, and formats inferred from what they find (operator 11).

Base patterns of three kinds find labelled credentials. From a bounded sample
of each kind's distinct strings (:data:`SAMPLE`, by least hash) and of other
words a probabilistic automaton is inferred (``grammar.py``). Then every
candidate, a maximal run of :data:`CANDIDATE` characters beside the base spans,
is scored: it is a secret of the kind that gives it the greatest likelihood if
that is more than ``exp(MARGIN)`` times its likelihood as another word and as
a string of random characters, which keeps out what is like neither. Base
spans always stay.

Strings of more than :data:`LONGEST` characters are no examples, but scored
like the others; a kind with fewer than :data:`FEWEST` examples adds nothing.

Rows: each by itself, whatever its ``doc_id``; null and empty texts have no
spans. Places are code points, ends exclusive.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, drop_cut, small
from .grammar import Automaton, infer

# The base patterns, in the order of their kinds; which group is the secret and how long it is at least.
KINDS = ("assign", "access", "hex")
PATTERNS = (
    (re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII), 1, 12),
    (re.compile(r"AKIA[A-Z0-9]+"), 0, 18),
    (re.compile(r"[0-9a-f]{16,}"), 0, 16),
)
#: Characters of a candidate, and how many it has at least.
CANDIDATE, LEAST = re.compile(r"[A-Za-z0-9+/_=-]{12,}"), 12
#: Distinct examples of a kind (and of other words) that an automaton is made of at most, the fewest that make one, and the characters of one at most.
SAMPLE, FEWEST, LONGEST = 2000, 20, 256
#: How much likelier a secret is by its format than otherwise, in natural logarithms; characters that a random string is made of.
MARGIN, RANDOM = 10.0, 64
_OTHER = len(KINDS)


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """Start, end, kind and secret of the base patterns' matches, by start, then kind."""
    out = []
    for kind, (pattern, group, least) in enumerate(PATTERNS):
        for m in pattern.finditer(text):
            if len(m[group]) >= least:
                out.append((m.start(), m.end(), kind, m[group]))
    return sorted(out)


def candidates(text: str, spans: list[tuple[int, int, int, str]]) -> list[tuple[int, str]]:
    """Start and characters of the candidates that no span touches."""
    out, k = [], 0
    ends: list[tuple[int, int]] = []
    for a, b, *_ in spans:  # by start, as one list without overlaps
        if ends and a <= ends[-1][1]:
            ends[-1] = (ends[-1][0], max(b, ends[-1][1]))
        else:
            ends.append((a, b))
    for m in CANDIDATE.finditer(text):
        while k < len(ends) and ends[k][1] <= m.start():
            k += 1
        if k == len(ends) or ends[k][0] >= m.end():
            out.append((m.start(), m[0]))
    return out


_SPAN = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.int32())])
_FOUND = pa.schema([("doc_id", pa.int64()), ("base", pa.list_(_SPAN)), ("secrets", pa.list_(pa.string())), ("starts", pa.list_(pa.int64())), ("words", pa.list_(pa.string()))])
_BASE_DDL = "array<struct<start:long,end:long,kind:int>>"


def _find(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in small(it):
        base, secrets, starts, words = [], [], [], []
        for text in batch.column(1).to_pylist():
            spans = base_spans(text or "")
            others = candidates(text or "", spans)
            base.append([{"start": a, "end": b, "kind": k} for a, b, k, _ in spans])
            secrets.append([s for *_, s in spans])
            starts.append([a for a, _ in others])
            words.append([w for _, w in others])
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, t) for x, t in zip((base, secrets, starts, words), _FOUND.types[1:]))], schema=_FOUND)


def _hash(text: Column) -> Column:
    """A hash that has nothing to do with the one that sketches of distinct strings use."""
    return F.xxhash64(F.lit("level"), text)


def _level(text: Column) -> Column:
    """Leading zero bits of the hash: each level has half as many strings as the one before."""
    return 64 - F.length(F.bin(_hash(text)))


def examples(found: DataFrame) -> dict[int, list[str]]:
    """Distinct strings of each kind and of other words, at most :data:`SAMPLE` of each, those of least hash.

    Levels of the hash are counted first (by sketches), so that only about as
    many strings as are wanted come to the driver.
    """
    labelled = found.select(F.explode(F.arrays_zip(F.col("base.kind").alias("kind"), F.col("secrets").alias("text"))).alias("e")).select("e.kind", "e.text")
    rows = labelled.unionByName(found.select(F.lit(_OTHER).alias("kind"), F.explode("words").alias("text"))).where(F.length("text") <= LONGEST)
    rows = rows.withColumn("level", _level(F.col("text")))
    counts = rows.groupBy("kind", "level").agg(F.approx_count_distinct("text").alias("n")).collect()
    least: dict[int, int] = {}
    for kind in {r.kind for r in counts}:
        n, least[kind] = 0, 64
        for r in sorted((r for r in counts if r.kind == kind), key=lambda r: -r.level):
            n += r.n
            if n > SAMPLE and least[kind] < 64:
                break
            least[kind] = r.level
    out: dict[int, list[tuple[int, str]]] = {k: [] for k in least}
    if least:
        wanted = F.lit(False)
        for kind, level in least.items():
            wanted = wanted | (F.col("kind") == kind) & (F.col("level") >= level)
        for r in rows.where(wanted).select("kind", "text").distinct().withColumn("h", _hash(F.col("text"))).collect():
            out[r.kind].append((r.h % (1 << 64), r.text))
    return {k: [t for _, t in sorted(v)[:SAMPLE]] for k, v in out.items()}


@dataclass
class Formats:
    """An automaton for each kind that has one, and one for other words."""

    kinds: dict[int, Automaton]
    other: Automaton | None

    @classmethod
    def fit(cls, by_kind: dict[int, list[str]]) -> Formats:
        enough = {k: infer(v) for k, v in by_kind.items() if len(v) >= FEWEST}
        other = enough.pop(_OTHER, None)
        return cls(enough, other)

    def scores(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Best kind of each string, and by how much it is likelier than another word or random characters."""
        if not self.kinds or self.other is None or not texts:
            return np.zeros(len(texts), np.int64), np.full(len(texts), -np.inf)
        ks = sorted(self.kinds)
        by = np.stack([self.kinds[k].likelihoods(texts) for k in ks])
        chance = np.maximum(self.other.likelihoods(texts), -math.log(RANDOM) * np.array([len(t) for t in texts]))
        return np.array(ks)[by.argmax(axis=0)], by.max(axis=0) - chance


_ADDED = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.int32()), ("score", pa.float64())])
_OUT = pa.schema([("doc_id", pa.int64()), ("base", pa.list_(_SPAN)), ("added", pa.list_(_ADDED))])


def _score(formats: Formats, margin: float):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(it):
            flat = batch.column(3).flatten().to_pylist()
            distinct = sorted(set(flat))
            kind, score = formats.scores(distinct)
            hits = {distinct[j]: (int(kind[j]), float(score[j])) for j in np.flatnonzero(score >= margin).tolist()}
            added = []
            for starts, words in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                added.append([{"start": a, "end": a + len(w), "kind": hits[w][0], "score": hits[w][1]} for a, w in zip(starts, words, strict=True) if w in hits])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(added, pa.list_(_ADDED))], schema=_OUT)

    return run


def find_secrets(docs: DataFrame, margin: float = MARGIN, formats: Formats | None = None) -> DataFrame:
    """``doc_id, base, added`` of each row of ``docs(doc_id, text)``: spans of the base patterns and of the inferred formats.

    A span has start, end and kind (a number into :data:`KINDS`), an added one
    its score too. Formats are inferred from ``docs`` unless given.
    """
    named = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    found = cut(named.mapInArrow(_find, f"doc_id long, base {_BASE_DDL}, secrets array<string>, starts array<long>, words array<string>"), "gi-found")
    formats = formats or Formats.fit(examples(found))
    scored = found.select("doc_id", "base", "starts", "words").mapInArrow(_score(formats, margin), f"doc_id long, base {_BASE_DDL}, added array<struct<start:long,end:long,kind:int,score:double>>")
    out = cut(scored, "gi-spans")
    drop_cut(found)
    return out


def span_digests(spans: DataFrame) -> DataFrame:
    """Counts of base spans by kind, their digest, and all spans as text."""
    named = lambda s: F.concat(F.element_at(F.array(*map(F.lit, KINDS)), s["kind"] + 1), F.lit(":"), s["start"].cast("string"), F.lit(":"), s["end"].cast("string"))
    plain = lambda c: F.transform(c, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))
    text = lambda c: F.array_join(F.transform(F.array_sort(c), named), ",")
    of_kind = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    counts = [of_kind(k).alias(f"n_{name}") for k, name in enumerate(KINDS)]
    return spans.select("doc_id", *counts, F.sha2(text(plain("base")), 256).alias("base_sha256"), text(F.concat(plain("base"), plain("added"))).alias("spans"))
