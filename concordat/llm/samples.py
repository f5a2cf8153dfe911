"""Bounded samples of labelled rows, the only place where a bound is set on what a model sees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def remainder(id_col: Column, m: int) -> Column:
    """crc32 of an id as text, modulo m; null for a null id."""
    return F.crc32(id_col.cast("string").cast("binary")) % m


def least_hashed(rows: DataFrame, limit: int) -> DataFrame:
    """At most ``limit`` of ``rows``: those of least hash of ``doc_id``, in that order.

    Rows are first thinned by the hash to about twice the limit, so the task that puts them in order reads
    a bounded number, however many rows there are. ``rows`` is read twice.
    """
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40))
    n = rows.count()
    if n > 4 * limit:
        rows = rows.where(place < int((1 << 40) * 2 * limit / n))
    return rows.orderBy(place, "doc_id").limit(limit)
