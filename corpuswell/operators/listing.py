"""Words of texts by their bytes and their hashes, for Python tasks over Arrow batches."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa

#: Which bytes are white space of `text.words`; there are two characters of two bytes more, which begin with 0xC2.
_BLANK = np.isin(np.arange(256), list(b" \t\n\x0b\f\r\x1c\x1d\x1e\x1f"))


def listed(texts: pa.Array) -> pa.Array:
    """`text.words` of texts that are in lower case and not null, by their bytes."""
    texts = texts.cast(pa.string())
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    offsets -= offsets[0]
    blank = _BLANK[data]
    wide = np.flatnonzero(data[:-1] == 0xC2)
    wide = wide[np.isin(data[wide + 1], (0x85, 0xA0))]
    blank[wide] = blank[wide + 1] = True
    inside, edges = ~blank, offsets[(offsets > 0) & (offsets < len(data))]
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= blank[:-1]
    begins[edges] = inside[edges]
    ends[:-1] &= blank[1:]
    ends[edges - 1] = inside[edges - 1]
    first = np.flatnonzero(begins)
    cells = np.append(0, np.cumsum(np.flatnonzero(ends) + 1 - first)).astype(np.int32)
    found = pa.Array.from_buffers(pa.string(), len(first), [None, pa.py_buffer(cells), pa.py_buffer(data[inside])])
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(first, offsets).astype(np.int32)), found)


#: Of MD5: how far each step rotates, its constant and which four bytes of a block it takes; words that are hashed side by side.
_TURNS = np.array([7, 12, 17, 22] * 4 + [5, 9, 14, 20] * 4 + [4, 11, 16, 23] * 4 + [6, 10, 15, 21] * 4, np.uint32)
_ADDED = np.floor(np.abs(np.sin(np.arange(1, 65))) * 2**32).astype(np.uint64).astype(np.uint32)
_TAKEN = [k if k < 16 else (5 * k + 1) % 16 if k < 32 else (3 * k + 5) % 16 if k < 48 else 7 * k % 16 for k in range(64)]
_START = [np.uint32(x) for x in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)]
_SIDE = 1 << 13


def hashed(words: pa.Array) -> np.ndarray:
    """The first 32 bits of the MD5 of each word. Words of up to 55 bytes, which are one block of MD5, go through its steps side by side."""
    offsets = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
    data, sizes, out = np.frombuffer(words.buffers()[2] or b"", np.uint8), np.diff(offsets), np.empty(len(words), np.int64)
    for k in np.flatnonzero(sizes > 55):
        out[k] = int.from_bytes(hashlib.md5(data[offsets[k] : offsets[k + 1]].tobytes()).digest()[:4], "big")
    short = np.flatnonzero(sizes <= 55)
    for lo in range(0, len(short), _SIDE):
        at = short[lo : lo + _SIDE]
        n, cells = sizes[at], np.zeros((len(at), 64), np.uint8)
        own = np.repeat(np.arange(len(at)), n)
        place = np.arange(len(own)) - np.repeat(np.cumsum(n) - n, n)
        cells[own, place] = data[np.repeat(offsets[at], n) + place]
        cells[np.arange(len(at)), n] = 0x80
        block = np.ascontiguousarray(cells.view("<u4").T)
        block[14] = 8 * n
        a, b, c, d = (np.full(len(at), x) for x in _START)
        for k in range(64):
            f = d ^ (b & (c ^ d)) if k < 16 else c ^ (d & (b ^ c)) if k < 32 else b ^ c ^ d if k < 48 else c ^ (b | ~d)
            f += a
            f += _ADDED[k]
            f += block[_TAKEN[k]]
            a, d, c, b = d, c, b, b + ((f << _TURNS[k]) | (f >> (np.uint32(32) - _TURNS[k])))
        out[at] = (a + _START[0]).byteswap()
    return out
