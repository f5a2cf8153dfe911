"""Operator 8: mixing sources to target weights by entropy balancing."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from concordat.llm.stage import discard, free_names, table, types_of
from concordat.llm.text import blocks, word_spans

WEIGHTS, MOST = (5.0, 2.0, 1.0), 3
#: Parts, by hash of the id, in which the rows of one source and size are ranked.
PARTS = 4096


def sizes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, source, size) and the columns ``keep``: the number of words of each row; 0 for null.

    Texts may be of any length; null and repeated ids are returned as they are. An empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.diff(word_spans(data, offsets)[2]) for _, _, data, offsets in blocks(batch.column(2))]
            n = np.concatenate(found) if found else np.zeros(0, np.int64)
            cols = [batch.column(0), batch.column(1), pa.array(n, pa.int64()), *[batch.column(3 + k) for k in range(len(keep))]]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "source", "size", *keep])

    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[source_col].cast("string").alias("source"), docs[text_col].alias("text"), *[docs[c] for c in keep])
    return rows.mapInArrow(run, ", ".join(["doc_id long, source string, size long", *types_of(docs, keep)]))


def targets(totals: np.ndarray, weights: np.ndarray, most: float = MOST) -> np.ndarray:
    """Shares of the sum of ``totals`` by weight, none above ``most`` times its own total.

    What is above a limit is dealt by weight to those below theirs, until none is above.
    """
    out, free = np.zeros(len(totals)), totals > 0
    left = float(totals.sum())
    while free.any() and left > 0:
        share = left * weights / weights[free].sum()
        above = free & (share > most * totals)
        if not above.any():
            out[free] = share[free]
            break
        out[above] = most * totals[above]
        left -= float(out[above].sum())
        free &= ~above
    return out


def tilts(cells: DataFrame, totals: np.ndarray, wanted: np.ndarray, scale: np.ndarray, most: float = MOST, rounds: int = 60) -> np.ndarray:
    """The multiplier of each source (column ``k`` of ``cells``), so that its rates meet its target.

    Entropy balancing seeks the rates that differ least from 1, in relative entropy, among those
    under the token constraints. The dual is convex, with one multiplier for a source, and gives the
    rates exp(multiplier * size / scale), here at most ``most``. Each Newton step takes the
    constraints' values and slopes from one distributed sum over the cells; a step that leaves the
    bracket known so far is halved instead. Multipliers that are off by more than 1e-4 of their target
    after ``rounds`` steps are an error.
    """
    spark, n = cells.sparkSession, len(totals)
    at, low, high = np.zeros(n), np.full(n, -math.inf), np.full(n, math.inf)
    full = wanted >= most * totals * (1 - 1e-12)
    open_ = (totals > 0) & ~full
    at[full] = math.inf
    off = np.zeros(n)
    for _ in range(rounds):
        if not open_.any():
            break
        now = spark.createDataFrame([(int(k), float(at[k]), float(scale[k])) for k in np.flatnonzero(open_)], "k int, at double, scale double")
        x = F.col("size") / F.col("scale")
        rate = F.exp(F.least(F.col("at") * x, F.lit(50.0)))
        sums = cells.join(now, "k").groupBy("k").agg(
            F.sum(F.col("n") * F.col("size") * F.least(rate, F.lit(float(most)))).alias("value"),
            F.sum(F.when(rate < most, F.col("n") * F.col("size") * x * rate).otherwise(0.0)).alias("slope"),
        )
        for r in sums.collect():
            k, gap = r["k"], r["value"] - wanted[r["k"]]
            off[k] = abs(gap) / wanted[k]
            if off[k] <= 1e-9:
                open_[k] = False
                continue
            if gap > 0:
                high[k] = at[k]
            else:
                low[k] = at[k]
            step = at[k] - gap / r["slope"] if r["slope"] > 0 else math.nan
            if not low[k] < step < high[k]:
                step = (low[k] + high[k]) / 2 if math.isfinite(low[k] + high[k]) else at[k] + math.copysign(1 + abs(at[k]), -gap)
            at[k] = step
    if (off[open_] > 1e-4).any():
        raise RuntimeError("the multipliers did not settle; raise rounds")
    # Sums of floats depend on the order of tasks in their last digits; eight digits do not.
    return np.array([float(f"{a:.8g}") for a in at])


def rounded(size: np.ndarray, n: np.ndarray, rate: np.ndarray, wanted: float, most: int = MOST) -> np.ndarray:
    """Whole copies of each size of a source, the sizes descending, so that their words come near ``wanted``.

    From the longest size down, each takes the number of copies that best makes up for what the sizes
    before left over, between the whole numbers about its rate. What is left then, as where the longest
    text alone is dropped, goes to the longest sizes that it still fills, up to ``most`` copies of a row:
    less than the shortest size with room is left.
    """
    copies, left = np.zeros(len(size), np.int64), 0.0
    for i in range(len(size)):
        exact = n[i] * rate[i]
        best = round(exact + (left / size[i] if size[i] else 0.0))
        copies[i] = min(max(best, n[i] * math.floor(rate[i])), n[i] * math.ceil(rate[i]))
        left += (exact - copies[i]) * size[i]
    left = wanted - float((copies * size).sum())
    for i in np.flatnonzero(size > 0).tolist():
        step = min(max(int(left / size[i]), -int(copies[i])), most * int(n[i]) - int(copies[i]))
        copies[i] += step
        left -= step * size[i]
    return copies


def mix_sources(
    docs: DataFrame,
    weights: tuple[float, ...] = WEIGHTS,
    most: int = MOST,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """(doc_id, source, size, source_size, target, rate, copies, taken) and the columns ``keep`` of each row.

    Sources by code point, null last, have the weights in turn; their targets sum to all words as far as
    ``most`` times each source's words allow. Rates become whole copies as ``rounded`` says. Within one
    size of a source, the rows with the least hash of their id get the copy more, rows of equal ids in
    the order of ``keep``; neither partitions nor reruns change the copies.

    Null texts count 0 words; rows without words have rate 1 and one copy of nothing. Null and repeated
    ids are rows like others, texts may be of any length. An empty table gives no rows. Columns of ``keep`` must
    not have a name of the operator's own; a clash is an error. One row for each source reaches the driver
    at each step; a source's rounding sees one row for each size.
    """
    free_names(keep, "doc_id", "text", "source", "size", "source_size", "target", "rate", "copies", "taken", "k", "n", "m", "sub", "rank", "base", "here")
    counted = table(sizes(docs, id_col, text_col, source_col, keep), "sizes")
    found = counted.groupBy("source").agg(F.sum("size").alias("total"), F.sum(F.col("size").cast("double") * F.col("size")).alias("squares")).collect()
    found.sort(key=lambda r: (r["source"] is None, r["source"] or ""))
    spark = docs.sparkSession
    totals = np.array([r["total"] for r in found], float)
    wanted = targets(totals, np.array([weights[k % len(weights)] for k in range(len(found))]), most)
    scale = np.array([r["squares"] / r["total"] if r["total"] else 1.0 for r in found])
    rows = [(k, r["source"], int(totals[k]), float(wanted[k])) for k, r in enumerate(found)]
    sources = spark.createDataFrame(rows, "k int, name string, source_size long, target double")
    known = counted.join(sources, counted.source.eqNullSafe(sources.name)).drop("name")
    cells = table(known.groupBy("k", "size").agg(F.count(F.lit(1)).alias("n")), "cells")
    at = tilts(cells, totals, wanted, scale, most)

    def settle(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("size", ascending=False)
        k = int(pdf["k"].iloc[0])
        size, n = pdf["size"].to_numpy(float), pdf["n"].to_numpy(np.int64)
        with np.errstate(over="ignore", invalid="ignore"):
            rate = np.where(size > 0, np.minimum(np.exp(at[k] * size / scale[k]), most), 1.0)
        copies = rounded(size, n, rate, wanted[k], most)
        return pdf.assign(rate=rate, base=copies // n, more=copies % n)[["k", "size", "n", "rate", "base", "more"]]

    settled = cells.groupBy("k").applyInPandas(settle, "k int, size long, n long, rate double, base long, more long")
    # Sub-cells by hash of the id, so that one size with very many rows is ranked in many tasks.
    known = known.withColumn("sub", F.pmod(F.xxhash64("doc_id"), F.lit(PARTS)))
    subs = known.groupBy("k", "size", "sub").agg(F.count(F.lit(1)).alias("m")).join(settled, ["k", "size"])
    upto = F.sum("m").over(Window.partitionBy("k", "size").orderBy("sub"))
    subs = subs.withColumn("upto", upto).withColumn("before", F.col("upto") - F.col("m"))
    # Products of two counts of rows go beyond 64 bits in a cell of a few billion rows.
    upto, before = (f"cast(more as decimal(19, 0)) * cast({c} as decimal(19, 0)) div n" for c in ("upto", "before"))
    share = F.expr(f"{upto}") - F.expr(f"{before}")
    subs = table(subs.withColumn("here", share).select("k", "size", "sub", "rate", "base", "here"), "sub-cells")
    discard(cells)
    rank = F.row_number().over(Window.partitionBy("k", "size", "sub").orderBy(F.xxhash64("doc_id", F.lit(8)), "doc_id", *keep))
    out = known.withColumn("rank", rank).join(subs, ["k", "size", "sub"])
    copies = F.col("base") + (F.col("rank") <= F.col("here")).cast("long")
    return out.select("doc_id", "source", "size", "source_size", "target", "rate", copies.alias("copies"), (copies * F.col("size")).alias("taken"), *keep)
