"""Contiguous ranges of ids, so that an order over the whole table needs no single task."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LOWEST = -(1 << 63)


class Ranges:
    """Ranges of the order by (id, hash), null ids first, from the ids that bound them.

    An id that bounds several ranges is held by many rows; these are dealt by hash to as many ranges.
    """

    def __init__(self, bounds: list[int]):
        self.bounds = np.array(sorted(bounds), np.int64)
        self.count = len(bounds) + 1

    def of(self, ids: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        """The range of each row, from its id (LOWEST for null) and the 64-bit hash that orders rows of one id."""
        first, last = np.searchsorted(self.bounds, ids, "left"), np.searchsorted(self.bounds, ids, "right")
        shared = last - first
        at = np.flatnonzero(shared > 1)
        place = hashes[at].astype(np.int64).view(np.uint64) ^ np.uint64(1 << 63)
        width = np.uint64((1 << 64) - 1) // shared[at].astype(np.uint64) + np.uint64(1)
        last[at] = first[at] + 1 + (place // width).astype(np.int64)
        return last.astype(np.int32)


def ranges(docs: DataFrame, id_col: str, per_partition: int = 4, sampled: int = 200) -> Ranges:
    """Ranges of ``docs`` with about the same number of rows, ``per_partition`` for each shuffle partition.

    The bounds come from about ``sampled`` ids a range, drawn by hash; only the ranges' sizes depend on
    the draw. Only the bounds reach the driver.
    """
    n = max(1, per_partition * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    probs = [k / n for k in range(1, n)]
    if not probs:
        return Ranges([])
    ids = docs.select(F.coalesce(docs[id_col].cast("long"), F.lit(LOWEST)).alias("id"), F.monotonically_increasing_id().alias("row"))
    total = ids.count()
    if total > 2 * sampled * n:
        ids = ids.where(F.pmod(F.xxhash64("id", "row"), F.lit(1 << 40)) < int((1 << 40) * sampled * n / total))
    return Ranges(ids.agg(F.percentile_approx("id", probs, 20 * n).alias("q")).first()["q"] or [])
