"""Substring dedup by content-defined chunks (operator 1).

A gear rolling hash over the UTF-8 bytes (16-byte window) ends a chunk where
its top five bits are zero, or where it is least if that is nowhere within 96
bytes, so boundaries move with the text and an insertion disturbs only the
chunks it touches. Chunks have 12 to 96 bytes (but for the
last of a text). Each chunk goes by its 64-bit digest; the first
place of a digest, by ``doc_id`` and then by position, owns it. Everywhere
else, later in the same document too, the chunk is an anchor only: from the outer :data:`OUTER` chunks of a run of
:data:`ANCHOR` bytes or more the match is extended byte by byte against the
owner's text, up to :data:`CONTEXT` bytes from the anchor (a match runs past a
chunk only where the two texts are cut out of step). The extended run is
removed if it has :data:`LEAST_WORDS` whole words or more.

What is removed stays at an earlier place; where that one loses a part of it in
turn, at one earlier still. A passage that a document repeats stays there once.

Rows: null texts stay null, empty texts empty. A row with null ``doc_id``
neither owns nor loses text. Rows that repeat a ``doc_id`` count as one
document: of places with equal positions neither loses text to the other.
Other columns pass through unchanged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import batches, cut, drop_cut, fresh, keep_ids, small, utf8

LEAST, MOST = 12, 96
#: Whole words that a removed run has at least: some 50 tokens, as is usual for exact substrings.
LEAST_WORDS = 40
#: Bytes of a run of common chunks that is extended at least, chunks at each end to extend from, bytes of the owner's text to compare.
ANCHOR, OUTER, CONTEXT = 32, 3, 256

_GEAR = np.random.default_rng(1999).integers(0, 1 << 16, 256, dtype=np.uint16)


def gear_cuts(data: bytes) -> list[int]:
    """Ends of the chunks of ``data``, the last one ``len(data)``; none for empty data."""
    n = len(data)
    if not n:
        return []
    h = _GEAR[np.frombuffer(data, np.uint8)]
    for s in (1, 2, 4, 8):
        if n > s:
            g = h.copy()
            g[s:] += h[:-s] << np.uint16(s)
            h = g
    ends, last = [], 0
    for c in (np.flatnonzero(h < 2048) + 1).tolist():
        while c - last > MOST:
            last += LEAST + int(h[last + LEAST - 1 : last + MOST].argmin())
            ends.append(last)
        if c - last >= LEAST:
            ends.append(c)
            last = c
    while n - last > MOST:
        last += LEAST + int(h[last + LEAST - 1 : last + MOST].argmin())
        ends.append(last)
    if last < n:
        ends.append(n)
    return ends


_CHUNK = pa.schema([("digest", pa.int64()), ("doc_id", pa.int64()), ("start", pa.int32()), ("end", pa.int32())])


def _chunk_batch(batch: pa.RecordBatch) -> dict:
    ids, digests, starts, ends, counts = batch.column(0), [], [], [], []
    digest = xxhash.xxh3_64_intdigest
    for text in utf8(batch.column(1)):
        cuts = gear_cuts(text) if text else []
        counts.append(len(cuts))
        a = 0
        for e in cuts:
            digests.append(digest(text[a:e]))
            starts.append(a)
            a = e
        ends += cuts
    return {
        "digest": np.array(digests, np.uint64).view(np.int64),
        "doc_id": np.repeat(ids.to_numpy(zero_copy_only=False), counts),
        "start": np.array(starts, np.int32),
        "end": np.array(ends, np.int32),
    }


def chunks(docs: DataFrame) -> DataFrame:
    """``docs(doc_id, text)`` -> a row for each chunk: digest, doc_id, byte span."""
    named = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).where("doc_id is not null and text <> ''")
    return named.mapInArrow(batches(_chunk_batch, _CHUNK), "digest long, doc_id long, start int, end int")


def _whole_words(text: bytes, start: int, end: int) -> tuple[int, int]:
    """The span without the words that its ends cut in two."""
    blank = b" \t\n\x0b\x0c\r"
    if start and text[start - 1] not in blank:
        while start < end and text[start] not in blank:
            start += 1
    while start < end and text[start] in blank:
        start += 1
    if end < len(text) and text[end] not in blank:
        while end > start and text[end - 1] not in blank:
            end -= 1
    elif end < len(text):
        end += 1
    return start, end


def _runs(found: list[dict]) -> list[list[dict]]:
    """Runs of adjacent chunks owned elsewhere, in order; equal chunks of rows with one ``doc_id`` count once."""
    runs: list[list[dict]] = []
    for f in sorted({(f["start"], f["end"]): f for f in found}.values(), key=lambda f: (f["start"], f["end"])):
        if runs and runs[-1][-1]["end"] == f["start"]:
            runs[-1].append(f)
        else:
            runs.append([f])
    return runs


_WANT = pa.schema([("doc_id", pa.int64()), ("at", pa.int32()), ("owner", pa.int64()), ("place", pa.int32()), ("size", pa.int32()), ("digest", pa.int64()), ("side", pa.int32())])


def _want_batch(batch: pa.RecordBatch) -> dict:
    """For each outer chunk of a run, which side of it in the owner's text is wanted (0 before, 1 after)."""
    out: dict[str, list] = {n: [] for n in _WANT.names}
    for doc, found in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
        # rows with one doc_id may have chunks that overlap: each chunk is an anchor then
        seen = sorted(found, key=lambda f: (f["start"], f["end"]))
        mixed = any(x["end"] > y["start"] for x, y in zip(seen, seen[1:]))
        for run in [[f] for f in seen] if mixed else _runs(found):
            if not mixed and run[-1]["end"] - run[0]["start"] < ANCHOR:
                continue
            for side, chunks_ in ((0, run[:OUTER]), (1, run[-OUTER:])):
                for f in chunks_:
                    row = (doc, f["start"], f["owner"], f["place"], f["end"] - f["start"], f["digest"], side)
                    for n, x in zip(_WANT.names, row, strict=True):
                        out[n].append(x)
    return out


_SIDE = pa.schema([("owner", pa.int64()), ("place", pa.int32()), ("digest", pa.int64()), ("side", pa.int32()), ("bytes", pa.binary())])


def _side_batch(batch: pa.RecordBatch) -> dict:
    """The owner's bytes before or after each wanted chunk."""
    out: dict[str, list] = {n: [] for n in _SIDE.names}
    for doc, text, wants in zip(batch.column(0).to_pylist(), utf8(batch.column(1)), batch.column(2).to_pylist(), strict=True):
        for w in wants:
            a, b = w["place"], w["place"] + w["size"]
            if text and b <= len(text) and xxhash.xxh3_64_intdigest(text[a:b]) == w["digest"] % (1 << 64):
                row = (doc, a, w["digest"], w["side"], text[max(0, a - CONTEXT) : a] if w["side"] == 0 else text[b : b + CONTEXT])
                for n, x in zip(_SIDE.names, row, strict=True):
                    out[n].append(x)
    return out


def _common(a: bytes, b: bytes) -> int:
    """Length of the common prefix."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    return next(i for i in range(n) if a[i] != b[i])


def removed_spans(text: bytes, found: list[dict], sides: list[dict] | None = None) -> list[tuple[int, int, int]]:
    """Byte spans to remove and the least owner of each, from the chunks owned elsewhere and their owners' bytes beside them."""
    mine = [f for f in found if xxhash.xxh3_64_intdigest(text[f["start"] : f["end"]]) == f["digest"] % (1 << 64)]
    at = {(f["start"], f["digest"]): f for f in mine}
    spans = [(f["start"], f["end"], f["owner"]) for f in mine]
    for x in sides or []:
        f = at.get((x["at"], x["digest"]))
        if f and x["side"] == 0:
            a = f["start"]
            n = _common(text[max(0, a - CONTEXT) : a][::-1], x["bytes"][::-1])
            spans.append((a - n, f["end"], f["owner"]))
        elif f:
            spans.append((f["start"], f["end"] + _common(text[f["end"] : f["end"] + CONTEXT], x["bytes"]), f["owner"]))
    out: list[tuple[int, int, int]] = []
    run: list[int] = []
    for x in [*sorted(set(spans)), (1 << 40, 1 << 40, 0)]:
        if run and x[0] <= run[1]:
            run = [run[0], max(run[1], x[1]), min(run[2], x[2])]
            continue
        if run:
            a, b = _whole_words(text, run[0], run[1])
            if b > a and len(text[a:b].split()) >= LEAST_WORDS:
                out.append((a, b, run[2]))
        run = list(x)
    return out


def substring_dedup(docs: DataFrame, detail: bool = True) -> DataFrame:
    """``docs`` with repeated passages removed from ``text``.

    With ``detail`` also ``removed_chars`` and ``removed`` (list of start and
    end byte in the old text, and the document that keeps the passage), in
    place of columns that ``docs`` has under these names.
    """
    if detail:
        docs = docs.drop(*[c for c in docs.columns if c.lower() in ("removed", "removed_chars")])
    ch = chunks(docs)
    owners = ch.groupBy("digest").agg(F.min(F.struct("doc_id", "start")).alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", F.col("first.doc_id").alias("owner"), F.col("first.start").alias("place"))
    # cut, so that the join below stands alone in its stage and a common digest's rows can be dealt to several tasks
    owners = cut(owners, "sd-firsts")
    taken = ch.join(owners, "digest").where("doc_id > owner or doc_id = owner and start > place")
    key, found, beside = fresh(docs, "id", "found", "sides")
    lists = cut(taken.groupBy(F.col("doc_id").alias(key)).agg(F.collect_list(F.struct("start", "end", "owner", "digest", "place")).alias(found)), "sd-found")
    found_lists = lists
    want = cut(lists.mapInArrow(batches(_want_batch, _WANT), "doc_id long, at int, owner long, place int, size int, digest long, side int"), "sd-want")
    asked = want.select("owner", "place", "size", "digest", "side").distinct().groupBy("owner").agg(F.collect_list(F.struct("place", "size", "digest", "side")).alias("wants"))
    owner_ids = cut(want.select("owner").distinct(), "sd-owners")
    named = keep_ids(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), owner_ids)
    given = named.join(asked, F.col("doc_id") == F.col("owner")).select("doc_id", "text", "wants").mapInArrow(batches(_side_batch, _SIDE), "owner long, place int, digest long, side int, bytes binary")
    sides = want.join(given, ["owner", "place", "digest", "side"]).groupBy(F.col("doc_id").alias("sides_of")).agg(F.collect_set(F.struct("at", "digest", "side", "bytes")).alias(beside))
    lists = lists.join(sides, F.col(key) == F.col("sides_of"), "left").drop("sides_of")
    joined = docs.join(lists, F.col("doc_id").cast("long") == F.col(key), "left").drop(key)
    names = docs.columns
    at = names.index("text")
    has_n = "n_chars" in names
    schema = T.StructType(list(docs.schema.fields))
    if detail:
        schema = T.StructType([*schema.fields, T.StructField("removed_chars", T.LongType()), T.StructField("removed", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("owner", T.LongType())])))])
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("owner", pa.int64())]))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(it):
            texts = batch.column(at)
            old = utf8(texts)
            lost, spans = [0] * len(old), [[] for _ in old]
            nexts = batch.column(len(names) + 1).to_pylist()
            for i, f in enumerate(batch.column(len(names)).to_pylist()):
                if not f or not old[i]:
                    continue
                keep, last = [], 0
                for a, b, owner in removed_spans(old[i], f, nexts[i]):
                    keep.append(old[i][last:a])
                    lost[i] += len(old[i][a:b].decode("utf-8", "ignore"))
                    spans[i].append({"start": a, "end": b, "owner": owner})
                    last = b
                if last:
                    old[i] = b"".join([*keep, old[i][last:]])
            columns = [batch.column(j) for j in range(len(names))]
            columns[at] = pa.array(old, pa.binary()).cast(texts.type)
            if has_n:
                j = names.index("n_chars")
                was = columns[j].to_pylist()
                columns[j] = pa.array([n if n is None or not x else n - x for n, x in zip(was, lost, strict=True)], columns[j].type)
            fields = [batch.schema.field(j) for j in range(len(names))]
            if detail:
                columns += [pa.array(lost, pa.int64()), pa.array(spans, span)]
                fields += [pa.field("removed_chars", pa.int64()), pa.field("removed", span)]
            yield pa.RecordBatch.from_arrays(columns, schema=pa.schema(fields))

    # written here, in small batches; then nothing reads the lists any more
    out = cut(joined.mapInArrow(run, schema), "sd-texts")
    for done in (owners, found_lists, want, owner_ids):
        drop_cut(done)
    return out
