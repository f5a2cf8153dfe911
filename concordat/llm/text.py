"""Vectorised views of text columns inside Arrow tasks.

Texts are handled in blocks of neighbouring rows, so that temporary arrays stay at a few megabytes
whatever the batch; a text longer than a block forms a block of its own. All hashes are 64-bit and
the same on every machine.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Callable, Iterator
from functools import cache, wraps

import numpy as np
import pyarrow as pa

#: Bytes of neighbouring rows that are handled at once, and codes of which prefix arrays are held at once.
BLOCK, STRETCH = 1 << 19, 1 << 17

U = np.uint64
#: The prime modulus of polynomial hashes, and a base for each of two of them.
P = (1 << 31) - 1
_BASES = (1_768_517_381, 926_388_673)
_powers: dict[int, np.ndarray] = {}
_ODD = U(0x9E3779B97F4A7C15)
_wide = [np.ones(1, U), np.ones(1, U)]

#: The ASCII white space that bounds words: space, tab, line feed, vertical tab, form feed, return.
SPACES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
_SPACE = np.zeros(256, bool)
_SPACE[list(SPACES)] = True
#: A-Z to a-z on UTF-8 bytes; bytes of other characters stay.
ASCII_LOWER = np.arange(256, dtype=np.uint8)
ASCII_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values (SplitMix64)."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def fold(x: np.ndarray) -> np.ndarray:
    """x modulo 2**31 - 1."""
    x = (x & U(P)) + (x >> U(31))
    x = (x & U(P)) + (x >> U(31))
    return np.where(x >= U(P), x - U(P), x)


def powers(base: int, n: int) -> np.ndarray:
    """base**i modulo P for i < n, by doubling."""
    have = _powers.get(base, np.ones(1, U))
    while len(have) < n:
        have = np.concatenate([have, fold(have * U(pow(base, len(have), P)))])
    _powers[base] = have
    return have[:n]


def _wide_powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64, at least n of each."""
    if len(_wide[0]) < n:
        size = max(n, 2 * len(_wide[0]), BLOCK)
        for k, base in enumerate((_ODD, U(pow(int(_ODD), -1, 1 << 64)))):
            steps = np.full(size, base, U)
            steps[0] = 1
            _wide[k] = np.cumprod(steps)
    return _wide[0], _wide[1]


def _by_stretch(hashes: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]) -> Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]:
    """The hashes with arrays of bounded size: ascending spans are taken by stretches of the codes (a hash doesn't depend on the place)."""

    @wraps(hashes)
    def run(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        if len(codes) <= 2 * STRETCH or (starts[1:] < starts[:-1]).any():
            return hashes(codes, starts, ends)
        out, lo = np.zeros(len(starts), U), 0
        while lo < len(starts):
            base = int(starts[lo])
            hi = int(np.searchsorted(starts, base + STRETCH, "left"))
            top = int(ends[lo:hi].max())
            out[lo:hi] = hashes(codes[base:top], starts[lo:hi] - base, ends[lo:hi] - base)
            lo = hi
        return out

    return run


@_by_stretch
def span_hashes(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of codes[s:e] for each span, from prefix arrays of two polynomials modulo 2**31 - 1.

    Together they are 62 bits, and a prime modulus has no family of texts that collide for every base,
    as a power of two has.
    """
    n = len(codes)
    out = np.zeros(len(starts), U)
    wide = codes.astype(U)
    wide += U(1)
    # Terms of bytes are below 2**40, those of code points below 2**52, folded ones below 2**31: sums stay below 2**63.
    small = n <= 1 << (23 if codes.itemsize == 1 else 11)
    for base in _BASES:
        up, down = powers(base, max(n, 1)), powers(pow(base, -1, P), n + 1)
        prefix = np.zeros(n + 1, U)
        terms = wide * up[:n]
        np.cumsum(terms if small else fold(terms), out=prefix[1:])
        own = prefix[ends] - prefix[starts]
        own = ((own & U(P)) + (own >> U(31))) * down[starts]
        out = (out << U(31)) | fold(own)
    return mix(out ^ (ends - starts).astype(U) * U(0xD6E8FEB86659FD93))


@_by_stretch
def quick_hashes(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of codes[s:e] from one polynomial modulo 2**64: faster, for tables that compare what they find."""
    n = len(codes)
    up, down = _wide_powers(n + 1)
    prefix = np.zeros(n + 1, U)
    np.cumsum((codes.astype(U) + U(1)) * up[:n], out=prefix[1:])
    h = (prefix[ends] - prefix[starts]) * down[starts]
    return mix(h ^ ((ends - starts).astype(U) * U(0xD6E8FEB86659FD93)))


def pair_hashes(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """An order-sensitive hash of two hashes."""
    return mix(a * U(0xC2B2AE3D27D4EB4F) + mix(b ^ U(0x165667B19E3779F9)))


def blocks(column: pa.Array, limit: int = BLOCK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, UTF-8 bytes, offsets of the rows in them); null counts as empty."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = column.fill_null("") if column.null_count else column
    column = column.cast(pa.large_string())
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64, n + 1, column.offset * 8)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def word_spans(data: np.ndarray, offsets: np.ndarray, solid: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first word of each row and the end) of maximal runs without ASCII white space, or of ``solid`` bytes."""
    solid = ~_SPACE[data] if solid is None else solid
    first, last = solid.copy(), solid.copy()
    first[1:] &= ~solid[:-1]
    last[:-1] &= ~solid[1:]
    inner = offsets[(offsets > 0) & (offsets < len(data))]
    first[inner] = solid[inner]
    last[inner - 1] = solid[inner - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def places_of(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The places of all spans' items, one span after the other."""
    before = np.cumsum(lengths) - lengths
    return np.repeat(starts - before, lengths) + np.arange(int(lengths.sum()))


def rows_of(bounds: np.ndarray) -> np.ndarray:
    """The row of each item, from the first item of each row and the end."""
    return np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))


#: Unicode's White_Space characters.
WHITE_SPACE = (
    0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20, 0x85, 0xA0, 0x1680, 0x2000, 0x2001, 0x2002, 0x2003, 0x2004, 0x2005,
    0x2006, 0x2007, 0x2008, 0x2009, 0x200A, 0x2028, 0x2029, 0x202F, 0x205F, 0x3000,
)
OTHER, LETTER, NUMBER, SPACE = 0, 1, 2, 3


@cache
def classes() -> np.ndarray:
    """Class of each code point: letter (L*), number (N*), white space or other."""
    kinds = {"L": LETTER, "N": NUMBER}
    out = np.fromiter((kinds.get(unicodedata.category(chr(i))[0], OTHER) for i in range(sys.maxunicode + 1)), np.uint8, sys.maxunicode + 1)
    out[list(WHITE_SPACE)] = SPACE
    return out


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


#: Byte classes of tokens: 1 for ASCII letters, digits and all bytes of other characters, 2 for punctuation.
_TOKEN = np.full(256, 2, np.uint8)
_TOKEN[list(range(0x30, 0x3A)) + list(range(0x41, 0x5B)) + list(range(0x61, 0x7B)) + list(range(0x80, 0x100))] = 1
_TOKEN[list(SPACES)] = 0


def token_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first token of each row and the end) of runs of word characters or of punctuation."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    kind = _TOKEN[data]
    flag = np.empty(n, bool)
    flag[0] = True
    np.not_equal(kind[1:], kind[:-1], out=flag[1:])
    flag[offsets[:-1][np.diff(offsets) > 0]] = True
    starts = np.flatnonzero(flag)
    ends = np.append(starts[1:], n)
    keep = kind[starts] > 0
    starts, ends = starts[keep], ends[keep]
    return starts, ends, np.searchsorted(starts, offsets)


def sums_by_row(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of the items of each row, from the first item of each row and the end.

    Each row is summed for itself, so that a sum of floats doesn't depend on the rows beside it.
    """
    out = np.zeros(len(bounds) - 1, np.float64 if values.dtype.kind == "f" else np.int64)
    some = np.flatnonzero(np.diff(bounds) > 0)
    if len(some):
        out[some] = np.add.reduceat(values[: bounds[-1]], bounds[:-1][some], dtype=out.dtype)
    return out
