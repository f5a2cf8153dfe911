"""Splitting of texts into tokenizer pieces by array operations, and a table of pieces already met."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from concordat.llm.text import LETTER, NUMBER, SPACE, U, classes, places_of, quick_hashes

#: What follows an apostrophe in the contractions that both public patterns cut off.
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")


def _run_starts(codes: np.ndarray, kind: np.ndarray, heads: np.ndarray) -> np.ndarray:
    flag = np.empty(len(codes), bool)
    flag[:1] = True
    np.not_equal(kind[1:], kind[:-1], out=flag[1:])
    flag[heads] = True
    return flag


def _contractions(codes: np.ndarray, kind: np.ndarray, flag: np.ndarray, ends: np.ndarray, quotes: np.ndarray) -> None:
    """Joins each apostrophe of ``quotes`` that starts a piece with its contraction; ``ends``: row end of each."""
    for tail in CONTRACTIONS:
        n = len(tail)
        ok = quotes + n < ends
        for k, c in enumerate(tail, 1):
            ok[ok] = codes[quotes[ok] + k] == ord(c)
        at = quotes[ok]
        flag[at + 1] = False
        after = at + n + 1
        flag[after[after < ends[ok]]] = True
        quotes, ends = quotes[~ok], ends[~ok]


def _row_ends(at: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    return offsets[np.searchsorted(offsets, at, "right")]


def byte_bpe_spans(codes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pieces of the byte-level pattern: contractions, then runs of letters, numbers or others with one
    space before, then white space, of which the last goes with what follows.

    Returns (starts, ends, first piece of each row and the end).
    """
    n = len(codes)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    kind = classes()[codes]
    heads = offsets[:-1][np.diff(offsets) > 0]
    flag = _run_starts(codes, kind, heads)
    is_head = np.zeros(n, bool)
    is_head[heads] = True
    solid = np.flatnonzero(flag & (kind != SPACE) & ~is_head)
    solid = solid[kind[solid - 1] == SPACE]
    flag[solid - 1] = True
    flag[solid[codes[solid - 1] == 0x20]] = False
    quotes = np.flatnonzero(flag & (codes == 0x27))
    _contractions(codes, kind, flag, _row_ends(quotes, offsets), quotes)
    starts = np.flatnonzero(flag)
    return starts, np.append(starts[1:], n), np.searchsorted(starts, offsets)


def word_bpe_spans(codes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pieces of the word-end pattern: contractions, letter runs, single numbers, runs of others; no white space."""
    n = len(codes)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    kind = classes()[codes]
    flag = _run_starts(codes, kind, offsets[:-1][np.diff(offsets) > 0])
    flag |= kind == NUMBER
    quotes = np.flatnonzero(flag & (codes == 0x27))
    _contractions(codes, kind, flag, _row_ends(quotes, offsets), quotes)
    starts = np.flatnonzero(flag)
    ends = np.append(starts[1:], n)
    keep = kind[starts] != SPACE
    starts, ends = starts[keep], ends[keep]
    return starts, ends, np.searchsorted(starts, offsets)


class PieceTable:
    """Token ids of pieces, in an open-addressing table by 64-bit hash that array operations probe.

    A hit counts only if the piece's code points are those of the entry, so pieces with one hash are
    entries of their own. ``encode`` turns a list of pieces into their id lists; it is called once for
    each piece that is new to this worker. The table empties itself at ``limit`` pieces, or at 8 times
    as many code points of them, so its memory is bounded.
    """

    def __init__(self, encode: Callable[[list[str]], list[list[int]]], limit: int = 1 << 20):
        self.encode, self.limit = encode, limit
        self.clear()

    def clear(self) -> None:
        self.size, self.n = 1 << 16, 0
        self.slots = np.full(self.size, -1, np.int32)
        self.keys = np.zeros(1 << 14, U)
        self.off, self.len = np.zeros(1 << 14, np.int32), np.zeros(1 << 14, np.int32)
        self.flat, self.used = np.zeros(1 << 16, np.uint32), 0
        self.code_off, self.code_len = np.zeros(1 << 14, np.int32), np.zeros(1 << 14, np.int32)
        self.codes, self.written = np.zeros(1 << 16, np.uint32), 0

    def _same(self, entry: np.ndarray, codes: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
        """Whether each entry's code points are those of its span."""
        same = self.code_len[entry] == lens
        if not same.all():
            at = np.flatnonzero(same)
            same[at] = self._same(entry[at], codes, starts[at], lens[at])
        elif len(entry):
            before = np.cumsum(lens) - lens
            place = np.arange(int(lens.sum()), dtype=np.int64)
            equal = codes[place + np.repeat(starts - before, lens)] == self.codes[place + np.repeat(self.code_off[entry] - before, lens)]
            if not equal.all():
                same = np.logical_and.reduceat(equal, before)
        return same

    def _find(self, h: np.ndarray, codes: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
        out = np.full(len(h), -1, np.int64)
        open_, slot = np.arange(len(h)), (h & U(self.size - 1)).astype(np.int64)
        while len(open_):
            got = self.slots[slot]
            filled = got >= 0
            hit = filled & (self.keys[got] == h[open_])
            at = np.flatnonzero(hit)
            hit[at] = self._same(got[at], codes, starts[open_[at]], lens[open_[at]])
            out[open_[hit]] = got[hit]
            go = filled & ~hit
            open_, slot = open_[go], (slot[go] + 1) & (self.size - 1)
        return out

    def _place(self, ids: np.ndarray) -> None:
        mask = self.size - 1
        for i, s in zip(ids.tolist(), (self.keys[ids] & U(mask)).tolist()):
            while self.slots[s] >= 0:
                s = (s + 1) & mask
            self.slots[s] = i

    def _add(self, h: np.ndarray, pieces: list[str], codes: np.ndarray, starts: np.ndarray, code_lens: np.ndarray) -> None:
        lists = self.encode(pieces)
        lens = np.fromiter(map(len, lists), np.int64, len(lists))
        flat = np.fromiter((x for y in lists for x in y), np.uint32, int(lens.sum()))
        letters = codes[places_of(starts, code_lens)]
        new = self.n + len(h)
        while new > len(self.keys):
            for name in ("keys", "off", "len", "code_off", "code_len"):
                own = getattr(self, name)
                setattr(self, name, np.concatenate([own, np.zeros_like(own)]))
        while self.used + len(flat) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while self.written + len(letters) > len(self.codes):
            self.codes = np.concatenate([self.codes, np.zeros_like(self.codes)])
        self.keys[self.n : new], self.len[self.n : new], self.code_len[self.n : new] = h, lens, code_lens
        self.off[self.n : new] = self.used + np.cumsum(lens) - lens
        self.code_off[self.n : new] = self.written + np.cumsum(code_lens) - code_lens
        self.flat[self.used : self.used + len(flat)] = flat
        self.codes[self.written : self.written + len(letters)] = letters
        self.used += len(flat)
        self.written += len(letters)
        fresh = np.arange(self.n, new)
        self.n = new
        if 2 * self.n > self.size:
            while 2 * self.n > self.size:
                self.size *= 4
            self.slots = np.full(self.size, -1, np.int32)
            fresh = np.arange(self.n)
        self._place(fresh)

    def tokens(self, text: str, codes: np.ndarray, spans: tuple[np.ndarray, np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all pieces in order, first id of each row and the end)."""
        starts, ends, bounds = spans
        if self.n > self.limit or self.written > 8 * self.limit:
            self.clear()
        h, code_lens = quick_hashes(codes, starts, ends), ends - starts
        at = self._find(h, codes, starts, code_lens)
        missing = np.flatnonzero(at < 0)
        while len(missing):
            # One piece of each new hash; others with that hash, if they differ, stay missing and come next.
            fresh, first = np.unique(h[missing], return_index=True)
            where = missing[first]
            pieces = [text[s:e] for s, e in zip(starts[where].tolist(), ends[where].tolist())]
            self._add(fresh, pieces, codes, starts[where], code_lens[where])
            at[missing] = self._find(h[missing], codes, starts[missing], code_lens[missing])
            missing = missing[at[missing] < 0]
        lens = self.len[at].astype(np.int64)
        ids = self.flat[places_of(self.off[at], lens)]
        return ids, np.concatenate([np.zeros(1, np.int64), np.cumsum(lens)])[bounds]
