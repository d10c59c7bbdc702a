"""WARC archives: writer with revisit records, and a salvage reader (operator 2).

Writer: every record is a gzip member of its own. Of rows with equal payloads
of at least 100 bytes the one with the least id is a ``response``; the others
are ``revisit`` records that carry the HTTP head only and refer to it.

Reader: a record counts when its gzip member is whole, its version line,
headers and length fit, and its block and payload digests agree. After a
failed check the reader looks for the next place, byte by byte, where a gzip
member or a version line starts a record that counts, goes on from there, and
logs the bytes between as a gap. A member with a bad end still yields the
whole records before it, and one that holds a bad record those after it, from
the next version line in the decompressed bytes on; its gap has the place of
the member and names the decompressed bytes.

Rows: a null payload is empty. A null url is left out of the headers; one that
an address header can't carry as it is (blanks, other scripts, control
characters) stands there escaped, and whole in a header of its own. A null
id refers to the least id of its payload. Repeated rows are written each.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, shared_path, utf8
from .files import write_file

#: Payloads of fewer bytes are always written whole.
LEAST_SHARED = 100
#: Bytes after which a task begins another archive.
ARCHIVE_BYTES = 24 << 20
_DATE = "2000-01-01T00:00:00Z"
_START = re.compile(rb"\x1f\x8b\x08|WARC/1\.[01]\r\n")
_VERSION = re.compile(rb"WARC/1\.[01]\r\n")
#: Header with the exact url, every byte but letters, digits and ``_.-~`` escaped.
_EXACT = "X-Exact-Target-URI"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


@dataclass
class Record:
    """One record: byte span in the file, named fields, block."""

    start: int
    end: int
    fields: dict[str, str]
    block: bytes

    def payload(self) -> bytes:
        """The block without its HTTP head."""
        return self.block.partition(b"\r\n\r\n")[2] if "http" in self.fields.get("content-type", "") else self.block

    def http_length(self) -> int | None:
        """Length of the payload by the HTTP head."""
        m = re.search(rb"(?im)^content-length:\s*(\d+)\s*$", self.block.partition(b"\r\n\r\n")[0])
        return int(m[1]) if m else None


@dataclass
class Gap:
    """Bytes that belong to no valid record."""

    start: int
    end: int
    reason: str


class Broken(Exception):
    """A record fails a check."""


def make_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None = None) -> bytes:
    """One record as a gzip member."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if refers_to is not None else head + payload
    fields = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", f"<urn:page:{'' if page_id is None else page_id}>"),
        ("WARC-Date", _DATE),
    ]
    if url is not None:
        plain = quote(url, safe="%:/?#[]@!$&'()*+,;=~-._|{}^`\"\\")
        fields.append(("WARC-Target-URI", plain))
        if plain != url:
            fields.append((_EXACT, quote(url, safe="")))
    if refers_to is not None:
        fields += [("WARC-Profile", _PROFILE), ("WARC-Refers-To", f"<urn:page:{refers_to}>")]
    fields += [
        ("WARC-Payload-Digest", f"sha256:{digest}"),
        ("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}"),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    text = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(text.encode() + block + b"\r\n\r\n") + packer.flush()


def parse(data: bytes, at: int = 0) -> tuple[Record, int]:
    """The plain record at ``at`` and where it ends."""
    if not re.match(rb"WARC/1\.[01]\r\n", data[at : at + 10]):
        raise Broken("no version line")
    stop = data.find(b"\r\n\r\n", at)
    if stop < 0:
        raise Broken("headers have no end")
    fields: dict[str, str] = {}
    for line in data[at:stop].split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            raise Broken("header without a colon")
        fields[name.decode("latin-1").strip().lower()] = value.decode("utf-8", "replace").strip()
    length = fields.get("content-length", "")
    if not length.isdigit():
        raise Broken("no length")
    a, b = stop + 4, stop + 4 + int(length)
    if data[b : b + 4] != b"\r\n\r\n":
        raise Broken("block is not as long as said")
    record = Record(at, b + 4, fields, bytes(data[a:b]))
    for field, content in (("warc-block-digest", record.block), ("warc-payload-digest", record.payload())):
        kind, _, digest = fields.get(field, "").partition(":")
        if kind == "sha256" and not (field == "warc-payload-digest" and fields.get("warc-type") == "revisit") and hashlib.sha256(content).hexdigest() != digest:
            raise Broken(f"{field} differs")
    return record, b + 4


def _member(data: bytes, at: int) -> tuple[bytes, int, str]:
    """What the gzip member at ``at`` holds, where it ends, and what is wrong with it."""
    d, out, view, i = zlib.decompressobj(31), [], memoryview(data), at
    try:
        while not d.eof and i < len(data):
            out.append(d.decompress(view[i : i + 65536]))
            i += 65536
    except zlib.error as e:
        # the failing call gives nothing: once more, byte by byte
        d, out = zlib.decompressobj(31), [b""]
        try:
            out += [d.decompress(view[j : min(j + 65536, i)]) for j in range(at, i, 65536)]
            for j in range(i, min(i + 65536, len(data))):
                out.append(d.decompress(view[j : j + 1]))
        except zlib.error:
            pass
        return b"".join(out), -1, f"gzip: {e}"
    if not d.eof:
        return b"".join(out), -1, "gzip member is cut short"
    return b"".join(out), min(i, len(data)) - len(d.unused_data), ""


def _counts(data: bytes, at: int) -> bool:
    """Whether a plain record that counts starts at ``at``."""
    try:
        parse(data, at)
    except Broken:
        return False
    return True


def _at(data: bytes, at: int) -> tuple[list[Record | Gap], int, str]:
    """Records that start at ``at`` and gaps among them, where they end (-1: not whole), and why."""
    if data[at : at + 2] != b"\x1f\x8b":
        try:
            record, end = parse(data, at)
        except Broken as e:
            return [], -1, str(e)
        return [record], end, ""
    raw, end, wrong = _member(data, at)
    items: list[Record | Gap] = []
    inner, some = 0, False
    while inner < len(raw):
        try:
            record, inner = parse(raw, inner)
        except Broken as e:
            why = str(e)
            to = next((m.start() for m in _VERSION.finditer(raw, inner + 1) if _counts(raw, m.start())), -1)
            if to < 0:
                wrong = wrong or why
                break
            items.append(Gap(at, max(at, end), f"{why} (bytes {inner} to {to} of the member)"))
            inner = to
            continue
        record.start, record.end = at, end
        items.append(record)
        some = True
    if not some:
        return [], -1, wrong or "empty member"
    return items, end, wrong


def salvage(data: bytes) -> Iterator[Record | Gap]:
    """All records of an archive that count, and the gaps between them, in order."""
    at = 0
    while at < len(data):
        items, end, wrong = _at(data, at)
        yield from items
        if end >= 0:
            if wrong:
                yield Gap(at, end, wrong)
            at = end
            continue
        to = len(data)
        for m in _START.finditer(data, at + 1):
            found, _, _ = _at(data, m.start())
            if found:
                to = m.start()
                break
        yield Gap(at, to, wrong)
        at = to


_FILES = pa.schema([("name", pa.string()), ("n_records", pa.int64()), ("n_bytes", pa.int64())])


def write_warc(pages: DataFrame, folder: str, key: str = "page_id", url: str = "url", payload: str = "html") -> DataFrame:
    """Write ``pages`` as ``folder/<part>-<number>.warc.gz``; a row for each archive."""
    body = F.encode(F.coalesce(F.col(payload).cast("string"), F.lit("")), "UTF-8")
    p = pages.select(F.col(key).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), body.alias("body"), F.sha2(body, 256).alias("digest"))
    shared = p.where(F.octet_length("body") >= LEAST_SHARED).groupBy(F.col("digest").alias("d")).agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("d", "first")
    # short payloads need no partner; each has a key of its own, so that they don't meet in one task
    own = F.when(F.octet_length("body") >= LEAST_SHARED, F.col("digest")).otherwise(F.concat(F.lit("-"), F.xxhash64("page_id", "url")))
    p = p.join(shared, own == F.col("d"), "left").select("page_id", "url", "body", "digest", F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")).alias("refers_to"))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, held, size = TaskContext.get().partitionId(), 0, [], 0

        def flush() -> pa.RecordBatch:
            name = f"{part:06d}-{number:06d}.warc.gz"
            write_file(folder, name, b"".join(held))
            return pa.RecordBatch.from_pydict({"name": [name], "n_records": [len(held)], "n_bytes": [size]}, schema=_FILES)

        for batch in it:
            ids, urls, digests, refers = (batch.column(i).to_pylist() for i in (0, 1, 3, 4))
            for i, body in enumerate(batch.column(2)):
                held.append(make_record(ids[i], urls[i], body.as_py(), digests[i], refers[i]))
                size += len(held[-1])
                if size >= ARCHIVE_BYTES:
                    yield flush()
                    number, held, size = number + 1, [], 0
        if held:
            yield flush()

    return cut(p.mapInArrow(run, "name string, n_records long, n_bytes long"), "warc-files")


_READ = pa.schema([
    ("path", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("gap", pa.string()), ("page_id", pa.int64()), ("url", pa.string()),
    ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary()),
])
_DDL = "path string, start long, end long, gap string, page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"


def _number(urn: str | None) -> int | None:
    m = re.fullmatch(r"<urn:page:(-?\d+)>", urn or "")
    return int(m[1]) if m else None


def read_warc(spark: SparkSession, folder: str, payloads: bool = True, pattern: str = "*.warc*", strict: bool = False) -> DataFrame:
    """A row for each record of the archives of ``folder``, and one with ``gap`` set for each quarantined span.

    With ``strict`` a gap is an error instead. An archive is read whole, so archives should stay below some 100 MB.
    """

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows, size = [], 0
                for x in salvage(content.as_py()):
                    if isinstance(x, Gap) and strict:
                        raise ValueError(f"{path}, bytes {x.start} to {x.end}: {x.reason}")
                    if isinstance(x, Gap):
                        rows.append((path, x.start, x.end, x.reason, None, None, None, None, None, None, None))
                        continue
                    f, kind = x.fields, x.fields.get("warc-type")
                    payload = b"" if kind == "revisit" else x.payload()
                    n = x.http_length() if kind == "revisit" else len(payload)
                    digest = f.get("warc-payload-digest", "").removeprefix("sha256:") if kind == "revisit" else hashlib.sha256(payload).hexdigest()
                    exact = f.get(_EXACT.lower())
                    uri = f.get("warc-target-uri") if exact is None else unquote(exact)
                    rows.append((path, x.start, x.end, None, _number(f.get("warc-record-id")), uri, kind, _number(f.get("warc-refers-to")), n, digest, payload if payloads else None))
                    size += len(payload)
                    if len(rows) >= 5000 or size > 8 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _READ.types)], schema=_READ)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _READ.types)], schema=_READ)

    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
    return files.select("path", "content").mapInArrow(run, _DDL)


def archive(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Write ``pages`` to archives and read them back, each record or none: ``page_id, payload_bytes, payload_digest, record_type, refers_to, url``."""
    spark = pages.sparkSession
    folder = folder or shared_path(spark, "warc")
    written = write_warc(pages, folder)
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url"]
    if not written.limit(1).count():
        return spark.createDataFrame([], "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string")
    return read_warc(spark, folder, payloads=False, strict=True).select(*names)


#: The registered query in DuckDB.
ORACLE = """
WITH p AS (SELECT page_id, url, coalesce(html, '') h FROM pages),
q AS (SELECT page_id, url, octet_length(encode(h)) AS payload_bytes, sha256(h) AS payload_digest FROM p),
r AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) first FROM q)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to, url FROM r
"""
