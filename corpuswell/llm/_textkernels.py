"""Numpy kernels over the texts of an Arrow batch: hashes of segments, words, pre-tokens, ragged gathers."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_powers = [np.ones(1, _U), np.ones(1, _U)]


def _power_tables(n: int) -> list[np.ndarray]:
    """BASE**j and BASE**-j modulo 2**64 for j < n."""
    if len(_powers[0]) < n:
        for k, b in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            steps = np.full(max(n, 1 << 16), b, _U)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits in which each bit of h moves every bit of the result."""
    h = h ^ (h >> _U(32))
    h *= _U(0xD6E8FEB86659FD93)
    h ^= h >> _U(32)
    h *= _U(0xD6E8FEB86659FD93)
    h ^= h >> _U(32)
    return h


def segment_hashes(symbols: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each symbols[start:end], from one running polynomial over all symbols."""
    up, down = _power_tables(len(symbols) + 1)
    total = np.zeros(len(symbols) + 1, _U)
    terms = (symbols.astype(_U) + _U(1)) * _U(0xFF51AFD7ED558CCD)
    terms ^= terms >> _U(29)
    terms *= up[: len(symbols)]
    np.cumsum(terms, out=total[1:])
    h = (total[ends] - total[starts]) * down[starts]
    return mix(h ^ (ends - starts).astype(_U) * _U(0xC4CEB9FE1A85EC53))


_WORD_BYTE = np.ones(256, bool)
_WORD_BYTE[[9, 10, 11, 12, 13, 32]] = False


#: Lower-case ASCII letters, digits, and all bytes of other characters.
LETTER_BYTE = np.zeros(256, bool)
LETTER_BYTE[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def space_words(buffer: bytes, word_byte: np.ndarray = _WORD_BYTE) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of word bytes; by default of those without ASCII white space."""
    inside = np.zeros(len(buffer) + 2, np.int8)
    inside[1:-1] = word_byte[np.frombuffer(buffer, np.uint8)]
    edge = np.diff(inside)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


@lru_cache(1)
def _classes() -> np.ndarray:
    """For each code point 0 other, 1 white space, 2 letter, 3 number."""
    import regex

    points = [*range(0xD800), *range(0xE000, 0x110000)]
    chars, kinds = "".join(map(chr, points)), np.zeros(0x110000, np.uint8)
    for kind, pattern in ((1, r"\s+"), (2, r"\p{L}+"), (3, r"\p{N}+")):
        for m in regex.finditer(pattern, chars):
            kinds[points[m.start()] : points[m.end() - 1] + 1] = kind
    kinds[0xD800:0xE000] = 0
    return kinds


def pretoken_starts(joined: str, doc_starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(code points, starts): where the matches of the byte-level BPE pattern start in texts that are joined.

    doc_starts are the places where texts start; matches never cross them. The pattern tells
    apart contractions, runs of letters, numbers and other characters (each with the space before it), and white
    space, whose last character before other text is left to the next match.
    """
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    n = len(points)
    if not n:
        return points, np.zeros(0, np.int64)
    kind = _classes()[points]
    first = np.zeros(n + 1, bool)
    first[doc_starts] = True
    first[n] = True
    start = np.empty(n + 1, bool)
    start[0] = start[n] = True
    np.not_equal(kind[1:], kind[:-1], out=start[1:n])
    start |= first
    space = kind == 1
    left = np.flatnonzero(space[:-1] & ~space[1:] & ~first[1:n])  # the last white space before other text
    start[left] = True
    start[left[points[left] == 32] + 1] = False
    quote = np.flatnonzero((points == 39) & start[:n])
    quote = quote[~first[quote + 1]]
    if len(quote):
        one = points[quote + 1]
        more = ~first[np.minimum(quote + 2, n)]
        two = np.where(more, points[np.minimum(quote + 2, n - 1)], 0)
        short = np.isin(one, [ord(c) for c in "stmd"])
        long = ((one == 114) | (one == 118)) & (two == 101) | (one == 108) & (two == 108)
        start[quote[short | long] + 1] = False
        start[quote[short] + 2] = True
        start[quote[long] + 2] = False
        start[quote[long] + 3] = True
    return points, np.flatnonzero(start[:n])


def ragged_take(data: np.ndarray, offsets: np.ndarray, picks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Joins data[offsets[p]:offsets[p + 1]] for each p of picks; with the ends of the joined pieces."""
    sizes = (offsets[1:] - offsets[:-1])[picks]
    ends = np.cumsum(sizes)
    places = np.ones(int(ends[-1]) if len(ends) else 0, np.int64)
    full = sizes > 0
    begin, at = offsets[picks][full], (ends - sizes)[full]
    if len(begin):
        places[at] = begin
        places[at[1:]] -= begin[:-1] + sizes[full][:-1] - 1
        np.cumsum(places, out=places)
    return data[places], ends
