"""Tables as a series of versions: a write never touches the files that it reads."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from concordat.operators import catalog, reconcile


def write_version(df: DataFrame, root: str, version: int, partition_by: Sequence[str] = ()) -> str:
    """Write ``df`` as version ``version`` under ``root``; fails if it is there."""
    path = f"{root}/v={version:08d}"
    df.write.partitionBy(*partition_by).parquet(path)
    return path


def read_version(spark: SparkSession, root: str, version: int, schema: str) -> DataFrame:
    return spark.read.schema(schema).parquet(f"{root}/v={version:08d}")


def insert_new(table: DataFrame, rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The table with those of ``rows`` whose key it lacks, one for each key."""
    fresh = rows.dropDuplicates(list(keys)).join(table.select(*keys), list(keys), "left_anti")
    return table.unionByName(fresh.select(*table.columns))


def update_by_key(table: DataFrame, rows: DataFrame, key: str, cols: Sequence[str]) -> DataFrame:
    """The table with new values of ``cols`` where ``rows`` has the key; null is a value."""
    new = rows.select(key, *[F.col(c).alias(f"__{c}") for c in cols], F.lit(True).alias("__hit"))
    both = table.join(new, key, "left")
    return both.select(*[F.when(F.col("__hit"), F.col(f"__{c}")).otherwise(F.col(c)).alias(c) if c in cols else F.col(c) for c in table.columns])


def delete_keys(table: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return catalog.without_keys(table, keys, key)


def emptied(table: DataFrame) -> DataFrame:
    return table.limit(0)


#: What is compared and what comes along with added rows, of playlists and of tracks.
_PLAYLIST, _TRACK = (["name"], ["token"]), (["title", "artists", "album", "duration_ms"], ["added_at"])


def _without_gone(pairs: DataFrame, plan: dict[str, DataFrame]) -> DataFrame:
    gone = {k: plan[f"{k}_plan"].where("action = 'delete'") for k in ("playlist", "track")}
    return pairs.join(gone["playlist"].select("playlist_id"), "playlist_id", "left_anti").join(gone["track"].select("uri"), "uri", "left_anti")


def plan_sync(stored: dict[str, DataFrame], incoming: dict[str, DataFrame], force: bool = False) -> dict[str, DataFrame]:
    """playlist_plan, track_plan, member_plan and tokens: all that ``apply_sync`` needs beside the stored tables.

    ``stored`` and ``incoming`` hold playlists(playlist_id, name, token), tracks and pairs(uri, playlist_id).
    Playlists compare by name; members of those are compared whose token upstream is another one, against
    the tracks as they will be.
    """
    plan = {
        "playlist_plan": reconcile.snapshot_diff(stored["playlists"], incoming["playlists"], "playlist_id", *_PLAYLIST),
        "track_plan": reconcile.snapshot_diff(stored["tracks"], incoming["tracks"], "uri", *_TRACK),
        "tokens": incoming["playlists"].select("playlist_id", "token"),
    }
    changed = reconcile.changed_parents(stored["playlists"], incoming["playlists"], "playlist_id", "token", force)
    tracks = reconcile.apply_snapshot(stored["tracks"], plan["track_plan"], "uri", *_TRACK)
    plan["member_plan"] = reconcile.membership_diff(_without_gone(stored["pairs"], plan), incoming["pairs"], tracks, changed, "uri", "playlist_id")
    return plan


def apply_sync(stored: dict[str, DataFrame], plan: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Next versions of playlists, tracks and pairs by a plan; tokens are taken over last."""
    playlists = reconcile.apply_snapshot(stored["playlists"], plan["playlist_plan"], "playlist_id", *_PLAYLIST)
    return {
        "playlists": reconcile.store_tokens(playlists, plan["tokens"], "playlist_id", "token"),
        "tracks": reconcile.apply_snapshot(stored["tracks"], plan["track_plan"], "uri", *_TRACK),
        "pairs": reconcile.apply_membership(_without_gone(stored["pairs"], plan), plan["member_plan"], "uri", "playlist_id"),
    }


def staged_sync(stored: dict[str, DataFrame], incoming: dict[str, DataFrame], force: bool = False) -> dict[str, DataFrame]:
    """Next versions of playlists, tracks and pairs, and the plans that lead to them, in one go."""
    plan = plan_sync(stored, incoming, force)
    return {**apply_sync(stored, plan), **plan}
