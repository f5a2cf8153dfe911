"""Operator 1: document fingerprints from prefix arrays of polynomial hashes."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from concordat.llm.order import LOWEST, ranges
from concordat.llm.text import P, U, code_points, fold, mix, powers

#: The bases, one for each of three independent hashes of 31 bits modulo P.
BASES = (1_103_515_249, 747_796_405, 1_664_525_013)
#: Spans of the sketch in code points, hashes kept in it, and the most prefix marks.
SPAN, KEPT, MARKS = 16, 64, 64

class Prefixes:
    """Prefix array of one text for one base: at[i] is the sum of (c[j] + 1) * base**j over j < i, modulo P."""

    def __init__(self, codes: np.ndarray, base: int = BASES[0]):
        n = len(codes)
        self.n, self.base = n, base
        self.at = np.zeros(n + 1, U)
        # A sum of 2**31 terms below 2**31 stays below 2**62.
        np.cumsum(fold((codes.astype(U) + U(1)) * powers(base, n)), out=self.at[1:])
        self.at = fold(self.at)

    def spans(self, starts: np.ndarray, length: int, to: int) -> np.ndarray:
        """Hashes of the spans of one length, each shifted to the power ``to`` (at least every start) to be comparable."""
        diff = fold(self.at[starts + length] + U(P) - self.at[starts])
        return fold(diff * powers(self.base, to + 1)[to - starts])


    @classmethod
    def marked(cls, at: np.ndarray, base: int) -> Prefixes:
        """The array known at marks only: for spans between marks it is one of larger steps, with a power of the base."""
        out = cls.__new__(cls)
        out.n, out.base, out.at = len(at) - 1, base, at
        return out


def equal_spans(a: list[Prefixes], i: int, b: list[Prefixes], j: int, length: int) -> bool:
    """Whether a[i:i+length] and b[j:j+length] are the same text, by all bases."""
    if i + length > a[0].n or j + length > b[0].n:
        return False
    to = max(i, j)
    for x, y in zip(a, b):
        up = powers(x.base, to + 1)
        one = (int(x.at[i + length]) - int(x.at[i])) * int(up[to - i])
        if (one - (int(y.at[j + length]) - int(y.at[j])) * int(up[to - j])) % P:
            return False
    return True


def common_extension(a: list[Prefixes], i: int, b: list[Prefixes], j: int) -> int:
    """Length of the longest common extension from a[i] and b[j], by binary search on span equality."""
    lo, hi = 0, min(a[0].n - i, b[0].n - j)
    while lo < hi:
        mid = (lo + hi + 1) // 2
        if equal_spans(a, i, b, j, mid):
            lo = mid
        else:
            hi = mid - 1
    return lo


def shared_length(a: list[Prefixes], b: list[Prefixes]) -> int:
    """How much of ``a`` lies in common extensions with ``b``: from the left, each place takes its longest, and the next follows it."""
    n, m = a[0].n, b[0].n
    if not n or not m:
        return 0
    to = max(n, m) - 1
    where: dict[tuple[int, ...], list[int]] = {}
    for j, key in enumerate(zip(*(x.spans(np.arange(m), 1, to).tolist() for x in b))):
        where.setdefault(key, []).append(j)
    keys = list(zip(*(x.spans(np.arange(n), 1, to).tolist() for x in a)))
    i = total = 0
    while i < n:
        longest = max((common_extension(a, i, b, j) for j in where.get(keys[i], ())), default=0)
        total += longest
        i += max(1, longest)
    return total


def _step(n: int) -> int:
    """Code points between prefix marks: the least power of two that needs at most MARKS of them."""
    return 1 << max(0, ((n - 1) // MARKS).bit_length())


class Fingerprint:
    """What a text's prefix arrays are reduced to.

    whole: length and the three hashes of the whole text, equal for equal texts. marks: the prefix arrays
    of two bases at multiples of a power-of-two step, with which two fingerprints compare any spans
    between marks and extend them by binary search. sketch: the least hashes of all spans of 16 code points.
    """

    def __init__(self, n: int, whole: tuple[int, ...], marks: np.ndarray, sketch: np.ndarray):
        self.n, self.whole, self.marks, self.sketch = n, whole, marks, sketch

    @classmethod
    def of(cls, codes: np.ndarray) -> Fingerprint:
        n = len(codes)
        arrays = [Prefixes(codes, b) for b in BASES]
        whole = tuple(int(p.at[n]) for p in arrays)
        marks = np.stack([p.at[:: _step(n)] for p in arrays[:2]])
        if n >= SPAN:
            starts = np.arange(n - SPAN + 1)
            spans = mix(fold(arrays[0].spans(starts, SPAN, n - SPAN) * U(pow(BASES[0], SPAN - n, P))))
        elif n:
            spans = mix(np.array([whole[0]], U))
        else:
            spans = np.zeros(0, U)
        spans = (spans >> U(32)).astype(np.uint32)
        least = np.unique(np.partition(spans, 4 * KEPT)[: 4 * KEPT]) if len(spans) > 4 * KEPT else np.unique(spans)
        if len(least) < KEPT:
            least = np.unique(spans)
        return cls(n, whole, marks, least[:KEPT])

    def text(self) -> str:
        head = f"{self.n:x}-" + "".join(f"{h:08x}" for h in self.whole)
        return "-".join([head, self.marks[:, 1:].T.astype(">u4").tobytes().hex(), self.sketch.astype(">u4").tobytes().hex()])

    def arrays(self, step: int) -> list[Prefixes]:
        """The prefix arrays at multiples of ``step``, itself a multiple of the fingerprint's own."""
        own = self.marks[:, :: step // _step(self.n)]
        return [Prefixes.marked(at, pow(base, step, P)) for at, base in zip(own, BASES)]

    def likeness(self, other: Fingerprint) -> float:
        """1 for equal texts; else the larger of the share in common extensions between marks and the share of common spans.

        The latter is the Dice coefficient that the two sketches estimate.
        """
        if (self.n, self.whole) == (other.n, other.whole):
            return 1.0
        if not self.n or not other.n:
            return 0.0
        step = max(_step(self.n), _step(other.n))
        shared = step * shared_length(self.arrays(step), other.arrays(step)) / max(self.n, other.n)
        both = np.union1d(self.sketch, other.sketch)[: max(len(self.sketch), len(other.sketch))]
        common = np.isin(both, self.sketch) & np.isin(both, other.sketch)
        jaccard = float(common.sum()) / max(1, len(both))
        return min(1.0, max(shared, 2 * jaccard / (1 + jaccard)))


def fingerprint_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of each text, and of the text whose last quarter gives way to the start of the next one.

    The next row is the one with the next larger id (rows of the same id: by hash of the text), after the
    last the first; null ids come first. Returns (doc_id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next). Texts move once, to ranges of that order, rows of one id
    to several if they are many; the first row of each range also goes to the range before, so no range
    needs another. Null texts count as empty, texts of any length count whole, a table of one row has
    itself as the next, an empty table gives no rows, and other columns of ``docs`` are not read.
    """
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), F.coalesce(docs[text_col], F.lit("")).alias("text"))
    parts = ranges(rows, "doc_id")

    @F.pandas_udf("int")
    def part(ids: pd.Series, hashes: pd.Series) -> pd.Series:
        return pd.Series(parts.of(ids.to_numpy(np.int64), hashes.to_numpy(np.int64)))

    order = rows.withColumn("low", F.coalesce("doc_id", F.lit(LOWEST))).withColumn("h", F.xxhash64("text"))
    placed = order.withColumn("part", part("low", "h"))
    heads = sorted(tuple(r) for r in placed.groupBy("part").agg(F.min(F.struct("low", "h")).alias("x")).select("part", "x.low", "x.h").collect())
    # One row for each range: a fixed number, so this side can be broadcast.
    to = [(low, h, heads[k - 1][0]) for k, (_, low, h) in enumerate(heads)]
    to = F.broadcast(docs.sparkSession.createDataFrame(to, "low long, h long, part int"))
    # Of rows of one id and hash, however many, one is lent: the first of the order.
    lent = order.join(to, ["low", "h"]).groupBy("part", "h").agg(F.min(F.struct(F.col("doc_id").isNotNull().alias("some"), "doc_id", "text")).alias("x"))
    lent = lent.select("part", "x.doc_id", "h", "x.text")
    cols = ["part", "doc_id", "h", "text"]
    both = placed.select(*cols, F.lit(False).alias("lent")).unionByName(lent.select(*cols, F.lit(True).alias("lent")))
    dealt = both.repartition("part").sortWithinPartitions("part", "lent", F.col("doc_id").asc_nulls_first(), "h", "text")
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None

        def answer(now: tuple, text: str, own: Fingerprint) -> tuple:
            doc_id, mine, codes, fp = now
            k = len(codes) // 4
            head = text[:k]
            new = mine[: len(mine) - k] + head
            edited = Fingerprint.of(code_points(new))
            return doc_id, fp.n, hashlib.sha256(new.encode()).hexdigest(), fp.text(), edited.text(), fp.likeness(edited), fp.likeness(own)

        for batch in batches:
            out = []
            for p, lent_row, doc_id, text in zip(*(batch.column(k).to_pylist() for k in range(4))):
                codes = code_points(text)
                fp = Fingerprint.of(codes)
                if held and held[0] == p and not held[2]:
                    out.append(answer(held[1], text, fp))
                held = (p, (doc_id, text, codes, fp), lent_row)
            yield pa.RecordBatch.from_pydict({n: [r[k] for r in out] for k, n in enumerate(names)}, schema)

    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    schema = pa.schema(list(zip(names, kinds)))
    spec = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return dealt.select("part", "lent", "doc_id", "text").mapInArrow(run, spec)
