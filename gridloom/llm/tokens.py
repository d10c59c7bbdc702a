"""Token ids of a public tokenizer, a column at a time.

``Encoder`` gives exactly the ids of ``Tokenizer.encode(text,
add_special_tokens=False)`` for the tokenizer named by :data:`DEFAULT`: it
drops white space, lower-cases, and encodes each run of letters, each digit
and each run of other signs by itself. So a column's bytes are cut into such
segments at once, equal segments become one (Arrow's dictionary), and only
distinct segments that this worker has not met lately go to the library. A
word with any byte whose treatment isn't plain (apostrophes, ``<``, control
characters, most of what lies beyond ASCII) goes to the library as a whole.
"""

from __future__ import annotations

import itertools
import os
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc

from .common import SLICE_BYTES, text_slices

#: Path of the tokenizer file unless a caller names another.
DEFAULT = public_tokenizers.path("word_bpe_49k.json")
#: Segments after which a worker's memo (some 40 bytes each) loses those not used for longest.
MEMO = 400_000

_ODD, _BLANK, _LETTER, _DIGIT, _SIGN = range(5)
_CLASS = np.full(256, _ODD, np.uint8)
_CLASS[33:127] = _SIGN
_CLASS[[39, 60]] = _ODD
_CLASS[48:58] = _DIGIT
_CLASS[65:91] = _CLASS[97:123] = _LETTER
_CLASS[[9, 10, 13, 32]] = _BLANK
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Byte-level alphabet: bytes without a printable character of their own follow from U+0100 on.
_BARE = [b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255)]
_BYTE_CHARS = {b: chr(256 + i) for i, b in enumerate(_BARE)}


def segments(data: np.ndarray, bounds: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Segments of the texts ``data[bounds[i]:bounds[i+1]]``: their bytes, which are odd words, and where each text's begin."""
    kind, low = _CLASS[data], _LOWER[data]
    # the letters of two bytes that start with C3; upper case has 20 hex less
    lead = np.flatnonzero(data == 0xC3)
    second = data[lead + 1]
    lead, second = lead[(second != 0x97) & (second != 0xB7)], second[(second != 0x97) & (second != 0xB7)]
    kind[lead] = kind[lead + 1] = _LETTER
    low[lead[second <= 0x9E] + 1] += 32
    first = np.zeros(len(data) + 1, bool)
    first[bounds] = True
    first = first[:-1]
    solid = kind != _BLANK
    word = solid & first
    word[1:] |= solid[1:] & ~solid[:-1]
    new = word | (kind == _DIGIT)
    new[1:] |= (kind[1:] != kind[:-1]) & solid[1:]
    odd_at = np.flatnonzero(kind == _ODD)
    odd_starts = np.empty(0, np.int64)
    if len(odd_at):
        starts = np.flatnonzero(word)
        odd = np.unique(np.searchsorted(starts, odd_at, side="right") - 1)
        odd_starts = starts[odd]
        # an odd word ends where no solid byte follows it within its text
        stop = np.flatnonzero(np.append(~solid | first, True))
        ends = stop[np.searchsorted(stop, odd_starts, side="right")]
        inside = np.zeros(len(data) + 1, np.int8)
        inside[odd_starts] += 1
        np.subtract.at(inside, ends, 1)
        inside = np.cumsum(inside[:-1], dtype=np.int8).astype(bool)
        new[inside] = False
        new[odd_starts] = True
        low[inside] = data[inside]
    starts = np.flatnonzero(new)
    solids = np.concatenate(([0], np.cumsum(solid, dtype=np.int32)))
    offsets = np.append(solids[starts], solids[-1]).astype(np.int32)
    column = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(low[solid])])
    is_odd = np.zeros(len(starts), bool)
    is_odd[np.searchsorted(starts, odd_starts)] = True
    return column, is_odd, np.searchsorted(starts, bounds)


class Encoder:
    """Ids of texts as unsigned 32-bit words."""

    def __init__(self, path: str = DEFAULT):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        # the memo: segments met, the slice that last held each, the count of ids of each, and all these ids
        self.known, self.last = pa.array([], pa.binary()), np.empty(0, np.int32)
        self.sizes, self.ids, self.slice = np.empty(0, np.int32), np.empty(0, np.uint32), 0

    def _new(self, keys: list[bytes], odd: list[bool]) -> list[list[int]]:
        """Ids of segments: of plain ones by the library's model, of odd words by all of it."""
        tokenize, out = self.tokenizer.model.tokenize, []
        odd_ids = iter(self.tokenizer.encode_batch([k.decode() for k, o in zip(keys, odd, strict=True) if o], add_special_tokens=False))
        for k, o in zip(keys, odd, strict=True):
            if o:
                out.append(next(odd_ids).ids)
            else:
                out.append([t.id for t in tokenize(k.decode() if k.isascii() else k.decode("latin-1").translate(_BYTE_CHARS))])
        return out

    def _forget(self) -> None:
        """Keep the half of the memo that was used last."""
        keep = self.last > np.partition(self.last, len(self.last) // 2)[len(self.last) // 2]
        self.ids = self.ids[np.repeat(keep, self.sizes)]
        self.known, self.last, self.sizes = self.known.filter(pa.array(keep)), self.last[keep], self.sizes[keep]

    def encode(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts ``data[bounds[i]:bounds[i+1]]``, and where each text's begin and the last one's end."""
        if not len(data):
            return np.empty(0, np.uint32), np.zeros(len(bounds), np.int64)
        column, is_odd, firsts = segments(data, bounds)
        coded = column.dictionary_encode()
        keys, index = coded.dictionary, coded.indices.to_numpy()
        if len(self.known) > MEMO:
            self._forget()
        self.slice += 1
        place = pc.index_in(keys, self.known).fill_null(-1).to_numpy().copy()
        unknown = np.flatnonzero(place < 0)
        if len(unknown):
            odd = np.zeros(len(keys), bool)
            odd[index[is_odd]] = True
            new = keys.take(pa.array(unknown))
            got = self._new(new.to_pylist(), odd[unknown].tolist())
            place[unknown] = np.arange(len(self.known), len(self.known) + len(unknown))
            self.known = pa.concat_arrays([self.known, new])
            self.last = np.append(self.last, np.zeros(len(new), np.int32))
            self.sizes = np.append(self.sizes, np.fromiter(map(len, got), np.int32, len(got)))
            self.ids = np.append(self.ids, np.fromiter(itertools.chain.from_iterable(got), np.uint32))
        self.last[place] = self.slice
        begins = (np.cumsum(self.sizes, dtype=np.int64) - self.sizes)[place]
        counts = self.sizes[place][index]
        ends = np.concatenate(([0], np.cumsum(counts, dtype=np.int64)))
        at = np.repeat(begins[index] - ends[:-1], counts)
        at += np.arange(len(at))
        return self.ids[at], ends[firsts]

    def __call__(self, text: str | None) -> bytes:
        """Ids of one text, little-endian; none for null."""
        raw = np.frombuffer((text or "").encode(), np.uint8)
        return self.encode(raw, np.array([0, len(raw)]))[0].astype("<u4").tobytes()

    def column(self, texts: pa.Array, end_id: int, most: int = SLICE_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Ids of a column's texts, each with ``end_id`` at its end; a null is an empty text.

        In slices of about ``most`` bytes: number of the first row, ids, and where
        each row's begin and the last one's end.
        """
        for row, data, bounds in text_slices(texts, most):
            ids, at = self.encode(data, bounds)
            at = at + np.arange(len(at))
            out = np.empty(at[-1], "<u4")
            own = np.ones(len(out), bool)
            own[at[1:] - 1] = False
            out[own] = ids
            out[at[1:] - 1] = end_id
            yield row, out, at


_encoders: dict[str, Encoder] = {}


def encoder(path: str = DEFAULT) -> Encoder:
    """This worker's encoder for ``path``; kept between tasks."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
