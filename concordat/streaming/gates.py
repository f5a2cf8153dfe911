"""Snapshots as streams: version-token gates and change counters, safe to deliver twice."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.window import Window

from concordat.operators.reconcile import changed_parents


def count_changes(history: DataFrame, parent: str = "playlist_id", time: str = "ts", count: str = "n") -> DataFrame:
    """(parent, ts, n, before): observations whose count differs from the one before; the first counts as a change from 0."""
    before = F.coalesce(F.lag(count).over(Window.partitionBy(parent).orderBy(time)), F.lit(0))
    return history.withColumn("before", before).where(F.col(count) != F.col("before")).select(parent, time, count, "before")


def stream_count_changes(observed: DataFrame, parent: str = "playlist_id", time: str = "ts", count: str = "n") -> DataFrame:
    """``count_changes`` of a stream of observations: the engine's state keeps the last count of each parent.

    Observations of a micro-batch are taken in order of time, of several at one time the largest. One
    that isn't later than the last one of its parent was delivered before, or came too late, and counts for
    nothing, so a repeated delivery changes nothing. The state outlives a restart by the stream's checkpoint;
    it has one small row for each parent. Observations with a null in any column are ignored.
    """
    kind = observed.schema[parent].dataType.simpleString()

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        at, n = state.get if state.exists else (None, 0)
        rows = pd.concat(list(batches)).groupby("at", sort=True)["n"].max()
        out = []
        for time_of, seen in rows.items():
            if at is not None and time_of <= at:
                continue
            if seen != n:
                out.append((key[0], time_of, seen, n))
            at, n = int(time_of), int(seen)
        state.update((at, n))
        yield pd.DataFrame(out, columns=["parent", "at", "n", "before"])

    rows = observed.select(F.col(parent).alias("parent"), F.unix_micros(F.col(time)).alias("at"), F.col(count).cast("long").alias("n")).dropna()
    out = rows.groupBy("parent").applyInPandasWithState(step, f"parent {kind}, at long, n long, before long", "at long, n long", "append", GroupStateTimeout.NoTimeout)
    return out.select(F.col("parent").alias(parent), F.timestamp_micros("at").alias(time), F.col("n").alias(count), "before")


def windowed_counts(events: DataFrame, time: str, key: str, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """(start, key, n) in tumbling windows; as a stream, rows later than ``late`` are dropped."""
    marked = events.withWatermark(time, late) if events.isStreaming else events
    return marked.groupBy(F.window(time, width).alias("w"), key).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), key, "n")


def run_gated(
    snapshots: DataFrame,
    read_tokens: Callable[[], DataFrame],
    handle: Callable[[DataFrame, int], None],
    write_tokens: Callable[[DataFrame, int], None],
    checkpoint: str,
    parent: str = "playlist_id",
    token: str = "token",
) -> StreamingQuery:
    """Handles the changed parents of each micro-batch of snapshots, then stores their tokens.

    Of several snapshots of a parent in a batch the last by ``ts`` counts. Tokens are stored after
    ``handle`` has returned, so a batch that failed is handled again; a batch delivered twice finds its
    tokens stored and handles nothing.
    """

    def step(batch: DataFrame, number: int) -> None:
        last = batch.groupBy(parent).agg(F.max_by(F.struct(*batch.columns), F.struct("ts", token)).alias("x")).select("x.*")
        last = last.persist()
        due = changed_parents(read_tokens(), last, parent, token)
        rows = last.join(due, parent, "left_semi")
        if not rows.isEmpty():
            handle(rows, number)
            write_tokens(rows.select(parent, token), number)
        last.unpersist()

    return snapshots.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
