"""String similarities that Spark has no expression for, as Arrow-batched functions."""

from __future__ import annotations

import unicodedata

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType


def lcs_length(a: str, b: str) -> int:
    """Length of the longest common subsequence, one machine-word-parallel step for each character of ``b``."""
    if not a or not b:
        return 0
    where: dict[str, int] = {}
    for k, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << k
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        hit = row & where.get(c, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


#: Cells of the tables that one block of pairs may have.
_CELLS = 1 << 22


def lcs_lengths(a: list[str], b: list[str]) -> np.ndarray:
    """``lcs_length`` of each pair, all pairs of a block stepping through their longer strings together."""
    out = np.zeros(len(a), np.int64)
    short = [x if len(x) <= len(y) else y for x, y in zip(a, b, strict=True)]
    long = [y if len(x) <= len(y) else x for x, y in zip(a, b, strict=True)]
    n_short = np.fromiter(map(len, short), np.int64, len(a))
    n_long = np.fromiter(map(len, long), np.int64, len(a))
    for k in np.flatnonzero(n_short > 64):
        out[k] = lcs_length(short[k], long[k])
    order = np.flatnonzero((n_short > 0) & (n_short <= 64))
    order = order[np.argsort(n_long[order], kind="stable")]
    lo = 0
    while lo < len(order):
        block = order[lo : lo + 4096]
        block = block[: max(1, _CELLS // int(n_long[block[-1]]))]
        codes = np.frombuffer("".join(short[k] for k in block).encode("utf-32-le", "surrogatepass"), np.uint32)
        symbols = np.unique(codes)
        block = block[: max(1, _CELLS // (len(symbols) + 1))]
        out[block] = _lcs_block([short[k] for k in block], [long[k] for k in block], n_short[block], n_long[block], symbols)
        lo += len(block)
    return out


def _lcs_block(short: list[str], long: list[str], n_short: np.ndarray, n_long: np.ndarray, symbols: np.ndarray) -> np.ndarray:
    """One machine word is a row of a pair's table; a symbol that no short string has leaves it as it is."""
    n, width = len(short), len(symbols) + 1
    flat = lambda texts: np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    rows = np.repeat(np.arange(n), n_short)
    bits = np.arange(len(rows)) - np.repeat(np.cumsum(n_short) - n_short, n_short)
    where = np.zeros(n * width, np.uint64)
    np.bitwise_or.at(where, rows * width + np.searchsorted(symbols, flat(short)), np.uint64(1) << bits.astype(np.uint64))
    codes = flat(long)
    found = np.minimum(np.searchsorted(symbols, codes), width - 2)
    found = np.where(symbols[found] == codes, found, width - 1)
    steps = np.full((n, int(n_long.max())), width - 1, np.int64)
    steps[np.arange(steps.shape[1]) < n_long[:, None]] = found
    steps = (steps + (np.arange(n) * width)[:, None]).T
    full = np.uint64(0xFFFFFFFFFFFFFFFF) >> (64 - n_short).astype(np.uint64)
    row = full.copy()
    for step in steps:
        hit = row & where[step]
        row = ((row + hit) | (row - hit)) & full
    return n_short - np.bitwise_count(row)


def indel_ratios(a: pd.Series, b: pd.Series) -> pd.Series:
    """2 * LCS / (len a + len b) of each pair; 1 for two empty strings, missing if either is."""
    there = (a.notna() & b.notna()).to_numpy()
    x, y = a[there].tolist(), b[there].tolist()
    total = np.fromiter((len(p) + len(q) for p, q in zip(x, y, strict=True)), np.float64, len(x))
    out = np.full(len(a), np.nan)
    out[there] = np.where(total > 0, 2.0 * lcs_lengths(x, y) / np.maximum(total, 1), 1.0)
    return pd.Series(out)


@F.pandas_udf(DoubleType())
def _indel_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return indel_ratios(a, b)


def matched(a: str, b: str) -> int:
    """Characters in matching blocks: the longest common substring (the first in ``a``, then in ``b``), then those on either side of it."""
    where: dict[str, list[int]] = {}
    for j, c in enumerate(b):
        where.setdefault(c, []).append(j)
    total, open_ = 0, [(0, len(a), 0, len(b))]
    while open_:
        a_lo, a_hi, b_lo, b_hi = open_.pop()
        size, a_at, b_at = 0, a_lo, b_lo
        runs: dict[int, int] = {}
        for i in range(a_lo, a_hi):
            here = {}
            for j in where.get(a[i], ()):
                if b_lo <= j < b_hi:
                    here[j] = n = runs.get(j - 1, 0) + 1
                    if n > size:
                        size, a_at, b_at = n, i - n + 1, j - n + 1
            runs = here
        if size:
            total += size
            open_ += [(a_lo, a_at, b_lo, b_at), (a_at + size, a_hi, b_at + size, b_hi)]
    return total


def _blocks(a: str | None, b: str | None) -> float | None:
    if a is None or b is None:
        return None
    return 2.0 * matched(a, b) / (len(a) + len(b)) if a or b else 1.0


@F.pandas_udf(DoubleType())
def _block_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([_blocks(x, y) for x, y in zip(a, b)], dtype="float64")


@F.pandas_udf(StringType())
def _plain(a: pd.Series) -> pd.Series:
    def one(x: str | None) -> str | None:
        if x is None or x.isascii():
            return x
        return "".join(c for c in unicodedata.normalize("NFD", x) if not unicodedata.combining(c))

    return a.map(one, na_action="ignore")


def indel_ratio(a: Column, b: Column) -> Column:
    """2 * LCS / (len a + len b); 1 for two empty strings, null if either is null."""
    return _indel_ratio(a, b)


def matching_blocks_ratio(a: Column, b: Column) -> Column:
    """Ratcliff-Obershelp similarity, with the longest matching blocks found recursively."""
    return _block_ratio(a, b)


def strip_accents(a: Column) -> Column:
    """The string in canonical decomposition without its combining marks."""
    return _plain(a)


def edit_similarity(a: Column, b: Column) -> Column:
    """1 - levenshtein / longer length; 1 for two empty strings."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, F.lit(1.0)).otherwise(1 - F.levenshtein(a, b) / longest)


def indel_bound(a: Column, b: Column) -> Column:
    """The most that ``indel_ratio`` can be for strings of these lengths; a cheap filter before it."""
    total = F.length(a) + F.length(b)
    return F.when(total == 0, F.lit(1.0)).otherwise(2.0 * F.least(F.length(a), F.length(b)) / total)
