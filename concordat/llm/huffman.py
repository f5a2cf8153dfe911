"""Canonical length-limited Huffman codes, with array-wise coding and table-driven decoding."""

from __future__ import annotations

import numpy as np


def code_lengths(counts: np.ndarray, limit: int) -> np.ndarray:
    """Optimal code lengths of at most ``limit`` bits by package-merge; 0 for a count of 0.

    At each level, the packages are sums of neighbours of the level before, sorted in with the
    leaves. Going back from the last level, the number of leaves among those taken says which
    (least frequent) symbols get one more bit.
    """
    symbols = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.uint8)
    n = len(symbols)
    if n <= 1:
        out[symbols] = 1
        return out
    if n > 1 << limit:
        raise ValueError(f"{n} symbols need more than {limit} bits")
    symbols = symbols[np.argsort(counts[symbols], kind="stable")]
    leaves = counts[symbols].astype(np.int64)
    levels, packages = [], np.zeros(0, np.int64)
    for _ in range(limit):
        items = np.concatenate([leaves, packages])
        order = np.argsort(items, kind="stable")
        levels.append(order < n)
        items = items[order]
        even = len(items) // 2 * 2
        packages = items[0:even:2] + items[1:even:2]
    lengths, take = np.zeros(n, np.uint8), 2 * n - 2
    for is_leaf in reversed(levels):
        own = int(is_leaf[:take].sum())
        lengths[:own] += 1
        take = 2 * (take - own)
    out[symbols] = lengths
    return out


class Codec:
    """Codes in canonical order: by length, then by symbol."""

    def __init__(self, lengths: np.ndarray, every: int = 64):
        self.lengths, self.every = lengths.astype(np.int64), every
        symbols = np.lexsort((np.arange(len(lengths)), lengths))
        symbols = symbols[lengths[symbols] > 0]
        lens = self.lengths[symbols]
        self.bits = int(lens[-1]) if len(lens) else 1
        # Canonical codes, left-aligned to the greatest length, are running sums of 2**(bits - length).
        steps = np.left_shift(1, self.bits - lens)
        left = np.cumsum(steps) - steps
        self.codes = np.zeros(len(lengths), np.uint64)
        self.codes[symbols] = (left >> (self.bits - lens)).astype(np.uint64)
        self.table = np.zeros(1 << self.bits, np.uint32)
        entries = (symbols.astype(np.uint32) << np.uint32(5)) | lens.astype(np.uint32)
        filled = np.repeat(entries, steps)
        self.table[: len(filled)] = filled

    def encode(self, ids: np.ndarray, bounds: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray]:
        """Bit streams of several documents, each from a byte border.

        ids: all tokens; bounds: first token of each document and the end. Returns (bytes, first
        byte of each document and the end, first bit of every token).
        """
        if not len(ids):
            return b"", np.zeros(len(bounds), np.int64), np.zeros(0, np.int64)
        lens = self.lengths[ids]
        ends = np.concatenate([np.zeros(1, np.int64), np.cumsum(lens)])
        own = np.diff(ends[bounds])
        first = np.concatenate([np.zeros(1, np.int64), np.cumsum((own + 7) >> 3)])
        at = ends[:-1] + np.repeat(first[:-1] * 8 - ends[bounds[:-1]], np.diff(bounds))
        word = at >> 5
        value = self.codes[ids] << (64 - lens - (at & 31)).astype(np.uint64)
        cuts = np.flatnonzero(np.diff(word, prepend=-1))
        words = np.zeros(int(word[-1]) + 2, np.uint64)
        where = word[cuts]
        words[where] = np.add.reduceat(value >> np.uint64(32), cuts)
        words[where + 1] += np.add.reduceat(value & np.uint64(0xFFFFFFFF), cuts)
        return words.astype(">u4").tobytes()[: int(first[-1])], first, at

    def decode(self, data: bytes, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Tokens of all lanes in order; lane k begins at bit starts[k] and has counts[k] tokens.

        The lanes advance together, one token a step, each by one look-up in the table.
        """
        total = int(counts.sum())
        out = np.zeros(total, np.uint32)
        if not total:
            return out
        raw = np.frombuffer(data + b"\0\0\0\0", np.uint8).astype(np.uint32)
        windows = (raw[:-3] << np.uint32(24)) | (raw[1:-2] << np.uint32(16)) | (raw[2:-1] << np.uint32(8)) | raw[3:]
        order = np.argsort(-counts, kind="stable")
        at, left = starts[order].astype(np.int64), counts[order]
        to = (np.cumsum(counts) - counts)[order]
        down = np.uint32(32 - self.bits)
        for k in range(int(left[0])):
            live = int(np.searchsorted(-left, -k, "left"))
            p = at[:live]
            entry = self.table[(windows[p >> 3] << (p & 7).astype(np.uint32)) >> down]
            out[to[:live] + k] = entry >> np.uint32(5)
            p += entry & np.uint32(31)
        return out
