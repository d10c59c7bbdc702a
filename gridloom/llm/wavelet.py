"""Token ids in one compressed wavelet-matrix file per shard (operator 9).

A shard's distinct ids are renumbered 0..s-1; the numbers are kept as
``ceil(log2 s)`` bit planes of a wavelet matrix, top bit first, each plane in
the order left by the stable partition on the planes above it. A plane is cut
into chunks of 2**18 bits, each compressed by itself together with a directory
of the ones before each of its 512-bit blocks; the ones before each chunk stand
beside them. So ``access`` (the id at a place), ``rank`` (occurrences before a
place) and ``select`` (the place of the n-th occurrence) inflate one chunk of
each plane and count within one block of it; nothing else is unpacked.

File: ``GWM2``, then 8-byte little-endian counts (ids, documents, distinct
ids, planes), the sizes of all sections (u8), then the sections: distinct ids
(u4), document ids (i8), which of them are null (bits), document lengths (u4),
each zlib data; and for each plane the ones before each chunk and in all (u8,
plain), then its chunks (zlib: bits in little order, then the directory, u4).

Rows: a null or empty text has its end id alone; null ``doc_id`` sorts first;
repeated ids are kept, in any order among themselves. Empty input: no rows.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import tokens
from .common import cut, shared_path, small
from .files import write_file

MAGIC, BLOCK, CHUNK = b"GWM2", 512, 1 << 18
#: Ids of a shard, but for its last document.
SHARD_IDS = 1 << 21
#: Bytes of texts that are encoded at once: larger slices repeat fewer words, and a shard takes more memory anyway.
SLICE = 1 << 22


def _split(values: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Stable partition of ``values``: those with bit 0, then those with bit 1."""
    n, packed = len(values), np.packbits(bits, bitorder="little")
    column = pa.array(values)
    pick = lambda b: column.filter(pa.Array.from_buffers(pa.bool_(), n, [None, pa.py_buffer(b)])).to_numpy(zero_copy_only=False)
    return np.concatenate((pick(~packed), pick(packed)))


class Plane:
    """Bits with the ones before each chunk; a chunk is its bytes and the ones in it before each block."""

    def __init__(self, ones: np.ndarray, chunks: list):
        #: Chunks are pairs of arrays, or bytes that are inflated when looked at; the last one looked at is kept.
        self.ones, self.chunks, self.inflated = ones, chunks, 0
        self._last: tuple[int, tuple[np.ndarray, np.ndarray]] | None = None

    def chunk(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        if not isinstance(self.chunks[k], memoryview):
            return self.chunks[k]
        if not self._last or self._last[0] != k:
            raw = zlib.decompress(self.chunks[k])
            blocks = len(raw) // (BLOCK // 8 + 4)
            self.inflated += 1
            self._last = k, (np.frombuffer(raw, np.uint8, blocks * (BLOCK // 8)), np.frombuffer(raw, "<u4", blocks, blocks * (BLOCK // 8)))
        return self._last[1]

    def look(self, i: int) -> tuple[int, int]:
        """The bit at place ``i`` (0 at the end) and the ones before it."""
        k, i = divmod(i, CHUNK)
        if k == len(self.chunks):
            return 0, int(self.ones[k])
        bits, before = self.chunk(k)
        if i >> 3 >= len(bits):
            return 0, int(self.ones[k + 1])
        whole = bits[i // BLOCK * (BLOCK // 8) : i >> 3]
        byte = int(bits[i >> 3])
        ones = int(self.ones[k]) + int(before[i // BLOCK]) + int(np.bitwise_count(whole).sum()) + (byte & ((1 << (i & 7)) - 1)).bit_count()
        return byte >> (i & 7) & 1, ones

    def place(self, bit: int, nth: int) -> int:
        """Place of the ``nth`` (from 0) ``bit``."""
        have = self.ones.astype(np.int64) if bit else np.arange(len(self.ones), dtype=np.int64) * CHUNK - self.ones.astype(np.int64)
        k = int(np.searchsorted(have, nth, side="right")) - 1
        k, nth = min(k, len(self.chunks) - 1), nth - int(have[min(k, len(self.chunks) - 1)])
        bits, before = self.chunk(k)
        have = before.astype(np.int64) if bit else np.arange(len(before), dtype=np.int64) * BLOCK - before
        b = int(np.searchsorted(have, nth, side="right")) - 1
        block = np.unpackbits(bits[b * (BLOCK // 8) : (b + 1) * (BLOCK // 8)], bitorder="little")
        return k * CHUNK + b * BLOCK + int(np.flatnonzero(block == bit)[nth - int(have[b])])

    def bits(self, n: int) -> np.ndarray:
        """All bits."""
        return np.unpackbits(np.concatenate([self.chunk(k)[0] for k in range(len(self.chunks))]), count=n, bitorder="little").view(bool)


class WaveletMatrix:
    """Succinct sequence of ids, with the documents it is made of."""

    def __init__(self, n: int, alphabet: np.ndarray, doc_ids: np.ndarray, nulls: np.ndarray, lengths: np.ndarray, planes: list[Plane]):
        self.n, self.alphabet, self.doc_ids, self.nulls, self.lengths, self.planes = n, alphabet, doc_ids, nulls, lengths, planes
        self.zeros = [n - int(p.ones[-1]) for p in planes]

    @classmethod
    def build(cls, ids: np.ndarray, doc_ids: np.ndarray, lengths: np.ndarray, nulls: np.ndarray | None = None) -> WaveletMatrix:
        """Of ids, and of the documents' ids (``nulls``: which have none) and lengths."""
        n = len(ids)
        if n and int(ids.max()) < 1 << 22:
            seen = np.bincount(ids)
            alphabet = np.flatnonzero(seen).astype("<u4")
            number = np.zeros(len(seen), np.uint32)
            number[alphabet] = np.arange(len(alphabet))
            codes = number[ids]
        else:
            alphabet, codes = np.unique(ids, return_inverse=True)
        levels = max(1, int(len(alphabet) - 1).bit_length()) if n else 0
        codes = codes.astype(np.uint16 if levels <= 16 else np.uint32)
        planes = []
        for b in range(levels - 1, -1, -1):
            bits = ((codes >> codes.dtype.type(b)) & codes.dtype.type(1)).astype(bool)
            if b:
                codes = _split(codes, bits)
            packed = np.zeros(-(-n // BLOCK) * (BLOCK // 8), np.uint8)
            packed[: -(-n // 8)] = np.packbits(bits, bitorder="little")
            ones = np.cumsum(np.bitwise_count(packed.view(np.uint64)).reshape(-1, BLOCK // 64).sum(axis=1, dtype=np.uint64))
            before = np.concatenate(([0], ones[:-1])).astype(np.int64)
            chunks, firsts = [], [*range(0, len(before), CHUNK // BLOCK)]
            for f in firsts:
                to = f + CHUNK // BLOCK
                chunks.append((packed[f * (BLOCK // 8) : to * (BLOCK // 8)], (before[f:to] - before[f]).astype("<u4")))
            planes.append(Plane(np.append(before[firsts], int(ones[-1])).astype("<u8"), chunks))
        nulls = np.zeros(len(doc_ids), bool) if nulls is None else nulls
        return cls(n, alphabet.astype("<u4"), doc_ids.astype("<i8"), nulls, lengths.astype("<u4"), planes)

    def to_bytes(self) -> bytes:
        pack = lambda *xs: zlib.compress(b"".join(x.tobytes() for x in xs), 1)
        sections = [pack(self.alphabet), pack(self.doc_ids), pack(np.packbits(self.nulls)), pack(self.lengths)]
        for p in self.planes:
            sections += [p.ones.tobytes(), *(pack(*p.chunk(k)) for k in range(len(p.chunks)))]
        head = MAGIC + struct.pack("<4Q", self.n, len(self.doc_ids), len(self.alphabet), len(self.planes))
        return b"".join([head, np.array([len(x) for x in sections], "<u8").tobytes(), *sections])

    @classmethod
    def from_bytes(cls, data: bytes) -> WaveletMatrix:
        """A file's matrix. Its planes stay compressed; a look-up inflates the chunks that it needs."""
        if data[:4] != MAGIC:
            raise ValueError("not a wavelet-matrix file")
        n, docs, _, levels = struct.unpack_from("<4Q", data, 4)
        each = 1 + -(-n // CHUNK)
        count = 4 + levels * each
        if len(data) < 36 + 8 * count:
            raise ValueError("wavelet-matrix file is cut short")
        ends = 36 + 8 * count + np.cumsum(np.concatenate(([0], np.frombuffer(data, "<u8", count, 36)))).astype(np.int64)
        if len(data) != int(ends[-1]):
            raise ValueError("wavelet-matrix file is cut short")
        view = memoryview(data)
        parts = [view[a:b] for a, b in zip(ends.tolist(), ends[1:].tolist())]
        alphabet, doc_ids, nulls, lengths = (np.frombuffer(zlib.decompress(x), t) for x, t in zip(parts, ("<u4", "<i8", np.uint8, "<u4")))
        planes = [Plane(np.frombuffer(parts[k], "<u8"), parts[k + 1 : k + each]) for k in range(4, count, each)]
        return cls(n, alphabet, doc_ids, np.unpackbits(nulls, count=docs).view(bool), lengths, planes)

    def access(self, i: int) -> int:
        """The id at place ``i``."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        code = 0
        for level in range(len(self.planes)):
            bit, ones = self.planes[level].look(i)
            code = code << 1 | bit
            i = self.zeros[level] + ones if bit else i - ones
        return int(self.alphabet[code])

    def _code(self, token: int) -> int | None:
        k = int(np.searchsorted(self.alphabet, token))
        return k if k < len(self.alphabet) and self.alphabet[k] == token else None

    def _range(self, code: int, i: int) -> tuple[int, int]:
        """Where the code's occurrences start below the last plane, and where those before ``i`` end."""
        a = 0
        for level in range(len(self.planes)):
            if code >> (len(self.planes) - 1 - level) & 1:
                a, i = (self.zeros[level] + self.planes[level].look(x)[1] for x in (a, i))
            else:
                a, i = (x - self.planes[level].look(x)[1] for x in (a, i))
        return a, i

    def rank(self, token: int, i: int | None = None) -> int:
        """Occurrences of ``token`` before place ``i`` (all of them by default)."""
        code = self._code(token)
        if code is None:
            return 0
        a, b = self._range(code, self.n if i is None else i)
        return b - a

    def select(self, token: int, k: int) -> int:
        """Place of the k-th occurrence (from 0) of ``token``."""
        code = self._code(token)
        if code is None or not 0 <= k < self.rank(token):
            raise IndexError(k)
        i = self._range(code, 0)[0] + k
        for level in range(len(self.planes) - 1, -1, -1):
            bit = code >> (len(self.planes) - 1 - level) & 1
            i = self.planes[level].place(bit, i - self.zeros[level] if bit else i)
        return i

    def decode(self) -> np.ndarray:
        """All ids, in order."""
        kind = np.uint16 if len(self.planes) <= 16 else np.uint32
        values = np.zeros(self.n, kind)
        for level in range(len(self.planes) - 1, -1, -1):
            one = self.planes[level].bits(self.n)
            z, up = self.zeros[level], np.empty(self.n, kind)
            up[~one] = values[:z]
            up[one] = values[z:] | kind(1 << (len(self.planes) - 1 - level))
            values = up
        return self.alphabet[values]


_SHARDS = pa.schema([("part", pa.int64()), ("shard", pa.int64()), ("n_ids", pa.int64()), ("n_docs", pa.int64())])


def write_shards(docs: DataFrame, folder: str, tokenizer: str = tokens.DEFAULT, end_id: int = 1, shard_ids: int = SHARD_IDS) -> DataFrame:
    """Encode ``docs(doc_id, text)`` and write ``folder/<part>-<shard>.gwm``.

    Files in the order of their names hold the documents in ascending
    ``doc_id``. Gives a row for each file.
    """

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, shard = tokens.encoder(tokenizer), TaskContext.get().partitionId(), 0
        held: list[tuple[np.ndarray, ...]] = []
        size = 0

        def flush() -> pa.RecordBatch:
            ids, lengths, doc_ids, nulls = (np.concatenate(x) for x in zip(*held))
            wm = WaveletMatrix.build(ids, doc_ids, lengths, nulls)
            write_file(folder, f"{part:06d}-{shard:06d}.gwm", wm.to_bytes())
            return pa.RecordBatch.from_pydict({"part": [part], "shard": [shard], "n_ids": [wm.n], "n_docs": [len(lengths)]}, schema=_SHARDS)

        for batch in small(it):
            nulls = batch.column(0).is_null().to_numpy(zero_copy_only=False)
            doc_ids = batch.column(0).fill_null(0).to_numpy()
            for row, ids, at in encoder.column(batch.column(1), end_id, SLICE):
                a, last = 0, len(at) - 1
                while a < last:
                    # the rows up to the one that fills the shard
                    b = min(last, int(np.searchsorted(at, at[a] + shard_ids - size)))
                    own = slice(row + a, row + b)
                    held.append((ids[at[a] : at[b]], np.diff(at[a : b + 1]), doc_ids[own], nulls[own]))
                    size += int(at[b] - at[a])
                    a = b
                    if size >= shard_ids:
                        yield flush()
                        held, size, shard = [], 0, shard + 1
        if held:
            yield flush()

    spread = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    return cut(spread.mapInArrow(run, "part long, shard long, n_ids long, n_docs long"), "wm-shards")


_READ = pa.schema([("part", pa.int64()), ("shard", pa.int64()), ("doc_id", pa.int64()), ("before", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])


def read_shards(spark, folder: str) -> DataFrame:
    """Each document of the files of ``folder``, decoded: its place in the shard, count and crc32 of its ids."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                part, shard = (int(x) for x in path.rsplit("/", 1)[1].split(".")[0].split("-"))
                wm = WaveletMatrix.from_bytes(content.as_py())
                raw, ends = memoryview(wm.decode().tobytes()), np.cumsum(wm.lengths, dtype=np.int64)
                starts = ends - wm.lengths
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                doc_ids = pa.array(wm.doc_ids, mask=wm.nulls)
                yield pa.RecordBatch.from_arrays([pa.array([part] * len(crc)), pa.array([shard] * len(crc)), doc_ids, pa.array(starts), pa.array(wm.lengths.astype(np.int64)), pa.array(crc, pa.int64())], schema=_READ)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gwm").load(folder)
    return files.select("path", "content").mapInArrow(run, "part long, shard long, doc_id long, before long, n_tokens long, ids_crc32 long")


def encode_corpus(docs: DataFrame, tokenizer: str = tokens.DEFAULT, end_id: int = 1, folder: str | None = None) -> DataFrame:
    """Write all of ``docs`` as wavelet-matrix files and give, read back from them, ``doc_id, start, n_tokens, ids_crc32``."""
    spark = docs.sparkSession
    folder = folder or shared_path(spark, "token-files")
    shards = write_shards(docs, folder, tokenizer, end_id)
    if not shards.limit(1).count():
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")
    # one row for each file of some two million ids, so one task can number them
    order = Window.orderBy("part", "shard").rowsBetween(Window.unboundedPreceding, -1)
    firsts = shards.select("part", "shard", F.coalesce(F.sum("n_ids").over(order), F.lit(0)).alias("first"))
    return read_shards(spark, folder).join(firsts, ["part", "shard"]).select("doc_id", (F.col("first") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")
