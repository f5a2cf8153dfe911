"""Look-ups, filters, memberships and counts over a catalog."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from concordat.functions import text as T
from concordat.operators.postings import contained


def by_keys(table: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Rows whose key is in ``keys``."""
    return table.join(keys.select(key).distinct(), key, "left_semi")


def without_keys(table: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not in ``keys``; rows without a key stay."""
    return table.join(keys.select(key).distinct(), key, "left_anti")


def containing(table: DataFrame, needles: dict[str, str]) -> DataFrame:
    """Rows where each column holds its needle, ASCII case aside; percent and underscore are plain."""
    for c, needle in needles.items():
        table = table.where(F.contains(F.lower(F.col(c)), F.lit(needle.lower())))
    return table


def exist(wanted: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """(key, found) of each distinct wanted key; a null key is never found."""
    hit = table.select(key).where(F.col(key).isNotNull()).distinct().withColumn("found", F.lit(True))
    return wanted.select(key).distinct().join(hit, key, "left").select(key, F.coalesce("found", F.lit(False)).alias("found"))


def since(table: DataFrame, time: str, cut: Column) -> DataFrame:
    return table.where(F.col(time) >= cut)


def excluded(name: Column, key: Column, description: Column, words: Sequence[str] = (), names: Sequence[str] = (), keys: Sequence[str] = (), keywords: Sequence[str] = ()) -> Column:
    """Whether a playlist is excluded: a word within its name, its exact name, its id, or a whole word of its description."""
    low = F.lower(F.coalesce(name, F.lit("")))
    out = F.coalesce(name.isin(list(names)), F.lit(False)) | F.coalesce(key.isin(list(keys)), F.lit(False))
    for w in words:
        out = out | F.contains(low, F.lit(w.lower()))
    for w in keywords:
        out = out | F.coalesce(F.rlike(F.lower(description), F.lit(rf"(?U)\b\Q{w.lower()}\E\b")), F.lit(False))
    return out


def live_mappings(mappings: DataFrame) -> DataFrame:
    return mappings.where("is_active and uri is not null and file_path is not null")


def latest_file(mappings: DataFrame) -> DataFrame:
    """(uri, file_path): the active mapping of the highest number."""
    return live_mappings(mappings).groupBy("uri").agg(F.max_by("file_path", "mapping_id").alias("file_path"))


def count_per(parents: DataFrame, pairs: DataFrame, parent: str, child: str, name: str) -> DataFrame:
    """Parents with their number of children, zero included; children are counted before they meet parents."""
    counts = pairs.groupBy(parent).agg(F.count(child).alias(name))
    return parents.join(counts, parent, "left").withColumn(name, F.coalesce(name, F.lit(0)).cast("long"))


def available_per(parents: DataFrame, pairs: DataFrame, mappings: DataFrame, parent: str = "playlist_id") -> DataFrame:
    """(parent, total, local): members, and those with a live file."""
    has = live_mappings(mappings).select("uri").distinct().withColumn("__has", F.lit(1))
    counts = pairs.join(has, "uri", "left").groupBy(parent).agg(F.count(F.lit(1)).alias("total"), F.count("__has").alias("local"))
    out = parents.select(parent).join(counts, parent, "left")
    return out.select(parent, F.coalesce("total", F.lit(0)).cast("long").alias("total"), F.coalesce("local", F.lit(0)).cast("long").alias("local"))


def members_of(parents: DataFrame, pairs: DataFrame, parent: str, child: str) -> DataFrame:
    """(parent, children): sorted, empty lists included."""
    lists = pairs.groupBy(parent).agg(F.array_sort(F.collect_set(child)).alias("children"))
    return parents.select(parent).join(lists, parent, "left").withColumn("children", F.coalesce("children", F.array().cast("array<string>")))


def find_by_name(wanted: DataFrame, playlists: DataFrame) -> DataFrame:
    """(wanted, playlist_id, rule): by exact name, else ignoring case, else the only playlist whose name holds it."""
    exact = playlists.groupBy(F.col("name").alias("wanted")).agg(F.min("playlist_id").alias("id1"))
    folded = playlists.groupBy(F.lower("name").alias("low")).agg(F.min("playlist_id").alias("id2"))
    w = wanted.select("wanted", F.lower("wanted").alias("low")).distinct()
    first = w.join(exact, "wanted", "left").join(folded, "low", "left")
    rest = first.where("id1 is null and id2 is null").select("wanted", "low")
    names = playlists.select(F.lower("name").alias("text"), "playlist_id")
    held = contained(rest.select(F.col("low").alias("needle")), names.select("text"))
    part = rest.join(held, rest.low == held.needle).join(names, "text").groupBy("wanted").agg(F.count(F.lit(1)).alias("n"), F.min("playlist_id").alias("id3")).where("n = 1")
    out = first.join(part, "wanted", "left")
    rule = F.when(F.col("id1").isNotNull(), "exact").when(F.col("id2").isNotNull(), "case").when(F.col("id3").isNotNull(), "contains").otherwise("none")
    return out.select("wanted", F.coalesce("id1", "id2", "id3").alias("playlist_id"), rule.alias("rule"))


def missing_tracks(tracks: DataFrame, mappings: DataFrame, inventory: DataFrame) -> DataFrame:
    """Tracks without a live mapping to a file that exists."""
    real = live_mappings(mappings).join(inventory.select("file_path").distinct(), "file_path", "left_semi")
    return without_keys(tracks, real, "uri")


def stale_mappings(mappings: DataFrame, inventory: DataFrame) -> DataFrame:
    """Active mappings whose file is gone."""
    return mappings.where("is_active").join(inventory.select("file_path").distinct(), "file_path", "left_anti")


def soft_delete(mappings: DataFrame, gone: DataFrame) -> DataFrame:
    """The mappings with those of ``gone(mapping_id)`` inactive."""
    hit = gone.select("mapping_id", F.lit(True).alias("__gone")).distinct()
    out = mappings.join(hit, "mapping_id", "left")
    return out.withColumn("is_active", F.when(F.col("__gone"), F.lit(False)).otherwise(F.col("is_active"))).select(*mappings.columns)


def unmapped_files(inventory: DataFrame, mappings: DataFrame) -> DataFrame:
    """Files without an active mapping, paths compared without case and kind of slash."""
    keys = mappings.where("is_active").select(T.path_key(F.col("file_path")).alias("__key")).distinct()
    return inventory.withColumn("__key", T.path_key(F.col("file_path"))).join(keys, "__key", "left_anti").drop("__key")


def with_prefix(playlists: DataFrame, prefix: str) -> DataFrame:
    """Playlists whose name starts with the prefix, case and white space around the name aside."""
    return playlists.where(F.startswith(F.upper(T.strip(F.col("name"))), F.lit(prefix.upper())))


def names_containing(playlists: DataFrame, wanted: DataFrame) -> DataFrame:
    """(wanted, playlist_id, name): the playlists whose name holds each wanted text, case aside; null without any."""
    w = wanted.select("wanted", F.lower("wanted").alias("needle")).distinct()
    p = playlists.select("playlist_id", "name", F.lower("name").alias("text"))
    held = w.join(contained(w.select("needle"), p.select("text")), "needle").join(p, "text")
    return w.select("wanted").join(held.select("wanted", "playlist_id", "name"), "wanted", "left")


def without_master(playlists: DataFrame, master_id: str | None = None) -> DataFrame:
    """Playlists without the master one: by its id if that is known, else by its name."""
    own = F.upper("name") == "MASTER" if master_id is None else F.col("playlist_id") == master_id
    return playlists.where(~F.coalesce(own, F.lit(False)))


def overview(playlists: DataFrame, pairs: DataFrame, structure: DataFrame, out: Column) -> DataFrame:
    """(playlist_id, name, folder, n): playlists that aren't excluded by ``out`` and aren't the master one, with their folder and size."""
    kept = without_master(playlists.where(~out))
    placed = structure.groupBy("name").agg(F.min("folder").alias("folder"))
    kept = kept.join(placed, "name", "left").select("playlist_id", "name", F.coalesce("folder", F.lit("")).alias("folder"))
    return count_per(kept, pairs, "playlist_id", "uri", "n")


def outcome_totals(rows: DataFrame, ok: Column) -> DataFrame:
    """One row: how many rows of batch work succeeded and failed, and all."""
    good = F.coalesce(ok, F.lit(False))
    return rows.agg(F.count_if(good).alias("succeeded"), F.count_if(~good).alias("failed"), F.count(F.lit(1)).alias("total"))
