"""Reconciliation of stored tables with incoming snapshots: plan first, then apply."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from concordat.functions.text import changes
from concordat.tables import staged

ADD, UPDATE, DELETE, SAME = "add", "update", "delete", "unchanged"


def snapshot_diff(
    stored: DataFrame,
    incoming: DataFrame,
    key: str,
    compare: Sequence[str],
    carry: Sequence[str] = (),
    norm: dict[str, Callable[[Column], Column]] | None = None,
) -> DataFrame:
    """One row for each key of either side: key, action, old_x and new_x of each column, and the changes in words.

    A key only upstream is an add, only in store a delete; else it is an update if any column of
    ``compare`` differs, nulls being values, after ``norm``. Columns of ``carry`` come along. One full
    outer join on the key; rows without a key take no part.
    """
    cols = [*compare, *carry]
    old = stored.where(F.col(key).isNotNull()).select(F.col(key), *[F.col(c).alias(f"old_{c}") for c in cols], F.lit(True).alias("__old"))
    new = incoming.where(F.col(key).isNotNull()).select(F.col(key), *[F.col(c).alias(f"new_{c}") for c in cols], F.lit(True).alias("__new"))
    norm = norm or {}

    def side(which: str, c: str) -> Column:
        return norm.get(c, lambda x: x)(F.col(f"{which}_{c}"))

    said = changes(*[(c, side("old", c), side("new", c)) for c in compare])
    action = F.when(F.col("__old").isNull(), ADD).when(F.col("__new").isNull(), DELETE).when(F.size(said) > 0, UPDATE).otherwise(SAME)
    said = F.when(action == UPDATE, said).otherwise(F.array().cast("array<string>"))
    both = old.join(new, key, "full_outer")
    return both.select(key, action.alias("action"), *[f"old_{c}" for c in cols], *[f"new_{c}" for c in cols], said.alias("changes"))


def plan_stats(plan: DataFrame) -> DataFrame:
    """One row: added, updated, deleted, unchanged."""
    names = {ADD: "added", UPDATE: "updated", DELETE: "deleted", SAME: "unchanged"}
    return plan.agg(*[F.count_if(F.col("action") == a).alias(n) for a, n in names.items()])


def apply_snapshot(stored: DataFrame, plan: DataFrame, key: str, compare: Sequence[str], carry: Sequence[str] = (), defaults: dict[str, Column] | None = None) -> DataFrame:
    """The stored table's next version: deletes leave, updates take the new values of ``compare``, adds join.

    Columns of ``carry`` are set on adds only. Columns of neither list are null on adds, or have the
    value in ``defaults``, which also stands in for a null of ``carry``.
    """
    defaults = defaults or {}
    steps = plan.select(key, F.col("action").alias("__action"), *[f"new_{c}" for c in [*compare, *carry]])
    kept = stored.join(steps, key, "left").where(F.coalesce(F.col("__action"), F.lit(SAME)) != DELETE)
    taken = F.col("__action") == UPDATE
    kept = kept.select(*[F.when(taken, F.col(f"new_{c}")).otherwise(F.col(c)).alias(c) if c in compare else F.col(c) for c in stored.columns])
    kinds = {f.name: f.dataType for f in stored.schema.fields}

    def fresh(c: str) -> Column:
        if c == key:
            return F.col(c)
        value = F.col(f"new_{c}") if c in [*compare, *carry] else F.lit(None)
        return (F.coalesce(value, defaults[c]) if c in defaults else value).cast(kinds[c]).alias(c)

    added = steps.where(F.col("__action") == ADD).select(*[fresh(c) for c in stored.columns])
    return kept.unionByName(added)


def changed_parents(stored: DataFrame, incoming: DataFrame, parent: str, token: str, force: bool = False) -> DataFrame:
    """Parents whose version token upstream isn't the stored one, or that are not stored yet."""
    old = stored.select(F.col(parent), F.coalesce(F.col(token), F.lit("")).alias("__token"))
    both = incoming.select(parent, token).join(old, parent, "left")
    return both.where(F.lit(force) | F.col("__token").isNull() | (F.col("__token") != F.coalesce(F.col(token), F.lit("")))).select(parent)


def membership_diff(stored: DataFrame, incoming: DataFrame, catalog: DataFrame, parents: DataFrame, child: str, parent: str) -> DataFrame:
    """(child, parent, action) of the pairs to add and to remove under ``parents``, the changed ones.

    Incoming pairs count only if the catalog has the child; pairs of other parents stay as they are. Both
    sides are cut to the changed parents before they meet.
    """
    now = stored.join(parents, parent, "left_semi").select(child, parent).distinct()
    new = incoming.join(parents, parent, "left_semi").join(catalog.select(child), child, "left_semi").select(child, parent).distinct()
    both = now.withColumn("__old", F.lit(True)).join(new.withColumn("__new", F.lit(True)), [child, parent], "full_outer")
    action = F.when(F.col("__old").isNull(), ADD).when(F.col("__new").isNull(), DELETE)
    return both.select(child, parent, action.alias("action")).where("action is not null")


def membership_changes(diff: DataFrame, child: str, parent: str) -> DataFrame:
    """(child, add_to, remove_from): sorted parents of each child with a change."""
    def those(action: str) -> Column:
        return F.array_sort(F.collect_set(F.when(F.col("action") == action, F.col(parent))))

    return diff.groupBy(child).agg(those(ADD).alias("add_to"), those(DELETE).alias("remove_from"))


def apply_membership(stored: DataFrame, diff: DataFrame, child: str, parent: str) -> DataFrame:
    """The pairs' next version, each once."""
    gone = diff.where(F.col("action") == DELETE).select(child, parent)
    new = diff.where(F.col("action") == ADD).select(child, parent)
    return stored.select(child, parent).join(gone, [child, parent], "left_anti").unionByName(new).distinct()


def store_tokens(stored: DataFrame, incoming: DataFrame, parent: str, token: str) -> DataFrame:
    """Stored parents with the incoming token where there is one, changed members or not."""
    new = incoming.select(parent, F.col(token).alias("__new"))
    both = stored.join(new, parent, "left").withColumn(token, F.coalesce("__new", token))
    return both.select(*stored.columns)


def membership_stats(pairs: DataFrame, catalog: DataFrame, child: str) -> DataFrame:
    """One row: children with a parent, children without, pairs."""
    with_one = pairs.select(child).distinct().withColumn("__has", F.lit(True))
    counted = catalog.select(child).distinct().join(with_one, child, "left")
    counted = counted.agg(F.count_if("__has").alias("with_parent"), F.count_if(F.col("__has").isNull()).alias("without_parent"))
    return counted.crossJoin(pairs.agg(F.count(F.lit(1)).alias("pairs")))


def first_seen(feed: DataFrame, key: str, time: str, position: str) -> DataFrame:
    """One row for each key: the earliest by time, then by position in the feed."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.col(time).asc_nulls_last(), position))
    return feed.withColumn("__rank", rank).where("__rank = 1").drop("__rank")


def delta(sources: DataFrame, target: DataFrame, key: str) -> DataFrame:
    """Distinct keys of ``sources`` that ``target`` lacks."""
    return sources.select(key).distinct().join(target.select(key), key, "left_anti")


def sort_out(liked: DataFrame, filed: DataFrame, unsorted: DataFrame, key: str) -> DataFrame:
    """(key, action): liked keys that are neither filed nor unsorted are to add, unsorted ones that are filed to delete."""
    add = delta(liked, filed.select(key).unionByName(unsorted.select(key)), key)
    gone = unsorted.select(key).distinct().join(filed.select(key), key, "left_semi")
    return add.withColumn("action", F.lit(ADD)).unionByName(gone.withColumn("action", F.lit(DELETE)))


def batches(keys: DataFrame, key: str, size: int = 100, ranges: int = 64) -> DataFrame:
    """(batch_no, key): keys in order, ``size`` at a time.

    Numbers come from ranges of the keys' order: counts of the ranges before, then ranks within one. The
    ranges are cut once and written, as a second sample could cut them elsewhere.
    """
    ordered = staged(keys.select(key).repartitionByRange(ranges, key).withColumn("__part", F.spark_partition_id()), "ranges")
    ranked = ordered.withColumn("__rank", F.row_number().over(Window.partitionBy("__part").orderBy(key)))
    # One row for each range, so a window over all of them is small.
    counts = ordered.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    before = counts.select("__part", (F.sum("__n").over(Window.orderBy("__part")) - F.col("__n")).alias("__before"))
    number = F.col("__before") + F.col("__rank") - 1
    return ranked.join(before, "__part").select(F.floor(number / size).alias("batch_no"), key)


#: A saved plan, nested under details and stats or flat; fields that a file lacks are null.
_ITEM = "array<map<string, string>>"
PLAN = (
    f"items_to_add {_ITEM}, items_to_update {_ITEM}, items_to_delete {_ITEM}, unchanged_count bigint, "
    f"details struct<items_to_add: {_ITEM}, items_to_update: {_ITEM}, items_to_delete: {_ITEM}>, stats struct<unchanged: bigint>"
)


def plan_items(saved: DataFrame) -> DataFrame:
    """(plan, action, item) of each item in ``saved(plan, ...)`` with the fields of PLAN, nested or flat."""
    flat = F.col("items_to_add").isNotNull()
    nested = ~flat & F.col("details").isNotNull() & F.col("stats").isNotNull()

    def items(name: str, action: str) -> Column:
        rows = F.coalesce(F.when(nested, F.col(f"details.{name}")).otherwise(F.col(name)), F.array().cast(_ITEM))
        return F.transform(rows, lambda x: F.struct(F.lit(action).alias("action"), x.alias("item")))

    every = F.concat(items("items_to_add", ADD), items("items_to_update", UPDATE), items("items_to_delete", DELETE))
    return saved.select("plan", F.explode(every).alias("x")).select("plan", "x.action", "x.item")


def plan_unchanged(saved: DataFrame) -> DataFrame:
    """(plan, unchanged) of each saved plan, 0 if it says nothing."""
    nested = F.col("items_to_add").isNull() & F.col("details").isNotNull()
    return saved.select("plan", F.coalesce(F.when(nested, F.col("stats.unchanged")).otherwise(F.col("unchanged_count")), F.lit(0)).cast("long").alias("unchanged"))
