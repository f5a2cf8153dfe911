"""An index of texts by the substrings that they hold, kept in a folder and changed by what a snapshot adds and removes.

A state of the index is a list of segments. A segment holds the texts that one change added, the keys that
it took away, its postings (which key has which substring) and how many keys have each. Postings and counts
are partitioned by the slot of the substring's hash, so a search reads only the slots of what it looks for.
Segments are never rewritten; a key's row counts unless a later segment took the key away. One manifest
makes all files of a change visible together (``plans.stored``).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from concordat.operators.postings import GRAM, grams
from concordat.plans import stored
from concordat.tables import discard, staged

#: Partitions of the postings of each segment, and the segments from which a change merges all into one.
SLOTS, MOST = 64, 8
_SLOTTED = {"postings": ["slot"], "counts": ["slot"]}


def _slot(gram: Column, slots: int) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(slots)).cast("int")


def _segments(tables: stored.Tables, kind: str) -> DataFrame:
    """The rows of one kind in all segments, with the number of theirs."""
    parts = [df.withColumn("segment", F.lit(int(name.split("-")[1]))) for name, df in sorted(tables.items()) if name.startswith(f"{kind}-")]
    return reduce(DataFrame.unionByName, parts)


def _live(rows: DataFrame, tables: stored.Tables) -> DataFrame:
    """Those of ``rows(key, segment)`` whose key no later segment took away."""
    gone = _segments(tables, "gone").groupBy("key").agg(F.max("segment").alias("__gone"))
    return rows.join(gone.withColumnRenamed("key", "__key"), (F.col("key") == F.col("__key")) & (F.col("segment") < F.col("__gone")), "left_anti")


def texts(spark: SparkSession, folder: str) -> DataFrame:
    """(key, text) of all that the index holds."""
    _, tables = stored.current(spark, folder)
    return _live(_segments(tables, "texts"), tables).select("key", "text")


def _segment(number: int, added: DataFrame, removed: DataFrame, slots: int) -> stored.Tables:
    """The tables of a segment. Slots that hold much are written by several tasks."""
    holds = F.array(*[F.struct(F.lit(k).alias("size"), grams(F.col("text"), k).alias("grams")) for k in range(1, GRAM + 1)])
    posted = added.select("key", F.explode(holds).alias("x")).select("key", "x.size", F.explode("x.grams").alias("gram"))
    posted = posted.withColumn("slot", _slot(F.col("gram"), slots))
    counts = posted.groupBy("slot", "size", "gram").agg(F.count(F.lit(1)).alias("n"))
    found = {
        "texts": added.select("key", "text"),
        "gone": removed.select("key"),
        "postings": posted.hint("rebalance", F.col("slot")).sortWithinPartitions("slot", "size", "gram"),
        "counts": counts.hint("rebalance", F.col("slot")).sortWithinPartitions("slot", "size", "gram"),
    }
    return {f"{kind}-{number}": df for kind, df in found.items()}


def _slotted(number: int) -> dict[str, list[str]]:
    return {f"{kind}-{number}": cols for kind, cols in _SLOTTED.items()}


def change(spark: SparkSession, folder: str, snapshot: DataFrame, slots: int = SLOTS, most: int = MOST) -> dict[str, int]:
    """Make the index hold ``snapshot(key, text)``: the numbers of the state and of texts ``added`` and ``removed``.

    Only keys that came, left or have another text are written; without any the state stays. A changed text
    counts as removed and added. With ``most`` segments, all become one. ``slots`` is fixed by the first
    change. Rows without a key are left out, null texts count as empty, and of several texts of a key the
    smallest stays. Other columns are not read. Files of replaced segments stay for readers of older
    states until ``stored.purge``.
    """
    number, tables = stored.current(spark, folder)
    new = snapshot.where("key is not null").groupBy("key").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))
    if number:
        slots = tables["layout"].first()["slots"]
        old = _live(_segments(tables, "texts"), tables).select("key", F.col("text").alias("__old"))
        moved = old.join(new, "key", "full_outer").where(~F.col("__old").eqNullSafe(F.col("text")))
    else:
        tables = {"layout": spark.createDataFrame([(slots,)], "slots int")}
        moved = new.withColumn("__old", F.lit(None).cast("string"))
    moved = staged(moved, "index-changes")
    added, removed = moved.where("text is not null"), moved.where("__old is not null")
    sums = moved.agg(F.count("text").alias("added"), F.count("__old").alias("removed")).first().asDict()
    if number and not any(sums.values()):
        discard(moved)
        return {"state": number, **sums}
    kept = list(tables) if number else []
    segments = sum(name.startswith("texts-") for name in kept)
    if segments >= most:
        rest = old.join(moved.select("key"), "key", "left_anti").withColumnRenamed("__old", "text")
        added, removed, kept = rest.unionByName(added.select("key", "text")), removed.limit(0), ["layout"]
    made = _segment(number + 1, added, removed, slots)
    if not number:
        made["layout"] = tables["layout"]
    state = stored.publish(spark, folder, made, number, keep=kept, partition_by=_slotted(number + 1))
    discard(moved)
    return {"state": state, **sums}


def search(spark: SparkSession, folder: str, needles: DataFrame) -> DataFrame:
    """(needle, key): which texts hold which of ``needles(needle)``, each distinct pair once.

    A text that holds a needle has all its trigrams (a shorter needle is a substring of its own size). By
    the kept counts each needle takes the one that the fewest texts have; one that no text has ends the
    search for it. Only these postings are read, then the texts of their keys are compared. Null and empty
    needles, and empty texts, find nothing.
    """
    _, tables = stored.current(spark, folder)
    slots = tables["layout"].first()["slots"]
    n = needles.select("needle").where("needle <> ''").distinct()
    size = F.least(F.length("needle"), F.lit(GRAM))
    mine = n.select("needle", size.alias("size"), F.explode(F.when(size == GRAM, grams(F.col("needle"))).otherwise(F.array("needle"))).alias("gram"))
    mine = mine.withColumn("slot", _slot(F.col("gram"), slots))
    by = ["slot", "size", "gram"]
    sought = mine.select(*by).distinct()
    counts = _segments(tables, "counts").join(sought, by, "left_semi").groupBy(*by).agg(F.sum("n").alias("n"))
    rated = mine.join(counts, by, "left").withColumn("n", F.coalesce("n", F.lit(0)))
    rarest = rated.groupBy("needle").agg(F.min(F.struct("n", *by)).alias("r")).where("r.n > 0").select("needle", *[F.col(f"r.{c}") for c in by])
    # At most ``slots`` numbers; partitions of other slots are not listed in the scan.
    read = [r["slot"] for r in sought.select("slot").distinct().collect()]
    met = _segments(tables, "postings").where(F.col("slot").isin(read)).join(rarest, by).select("needle", "key", "segment")
    held = _live(met, tables).join(_segments(tables, "texts"), ["key", "segment"])
    return held.where(F.contains("text", F.col("needle"))).select("needle", "key")
