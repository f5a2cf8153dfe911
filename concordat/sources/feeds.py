"""Landed JSON pages of a playlist service, as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from concordat.functions import text as T

#: The shapes of the pages; fields that a page lacks are null.
PLAYLIST_PAGE = "items array<struct<id: string, name: string, description: string, snapshot_id: string, owner: struct<id: string>>>"
TRACK_PAGE = (
    "playlist_id string, items array<struct<added_at: string, track: struct<id: string, name: string, uri: string, is_local: boolean, "
    "duration_ms: bigint, artists: array<struct<name: string>>, album: struct<name: string>>>>"
)


def read_pages(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Pages, one JSON document a line, in order of file and place."""
    return spark.read.schema(schema).json(path)


def stream_pages(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Pages as they land in a folder, each file once: the stream's checkpoint knows those already read."""
    return spark.readStream.schema(schema).json(path)


def playlists(pages: DataFrame, owner: str, excluded: Column | None = None) -> DataFrame:
    """(playlist_id, name, snapshot_id, description) of the owner's playlists, stripped, without excluded ones."""
    rows = pages.select(F.explode("items").alias("p")).where(F.col("p.owner.id") == owner)
    out = rows.select(F.col("p.id").alias("playlist_id"), T.strip(F.col("p.name")).alias("name"), F.coalesce("p.snapshot_id", F.lit("")).alias("snapshot_id"), F.col("p.description").alias("description"))
    return out.where(~excluded) if excluded is not None else out


def tracks(pages: DataFrame) -> DataFrame:
    """(playlist_id, pos, uri, track_id, title, artists, album, added_at, duration_ms, is_local); null tracks are skipped."""
    rows = pages.select("playlist_id", F.posexplode("items").alias("pos", "i")).where("i.track is not null")
    local = F.coalesce("i.track.is_local", F.lit(False))
    names = F.filter(F.transform("i.track.artists", lambda a: a["name"]), lambda n: F.coalesce(n, F.lit("")) != "")
    return rows.select(
        "playlist_id",
        "pos",
        T.null_if_blank(F.col("i.track.uri")).alias("uri"),
        F.when(~local, F.col("i.track.id")).alias("track_id"),
        F.col("i.track.name").alias("title"),
        F.array_join(names, ", ").alias("artists"),
        F.coalesce(T.null_if_blank(F.col("i.track.album.name")), F.when(local, F.lit("Local File")).otherwise(F.lit(""))).alias("album"),
        F.try_to_timestamp("i.added_at").alias("added_at"),
        F.when(F.col("i.track.duration_ms") != 0, F.col("i.track.duration_ms")).alias("duration_ms"),
        local.alias("is_local"),
    )


def members(pages: DataFrame) -> DataFrame:
    """(playlist_id, uri) of items with a uri."""
    return tracks(pages).where("uri is not null").select("playlist_id", "uri")


def liked(pages: DataFrame, since: str = "2021-09-12") -> DataFrame:
    """The tracks added since a day, newest first."""
    return tracks(pages).where(F.col("added_at") >= F.lit(since).cast("timestamp")).orderBy(F.desc("added_at"), "uri")


def first_artists(pages: DataFrame) -> DataFrame:
    """(playlist_id, pos, title, artist, album) of each item: the first artist only."""
    rows = pages.select("playlist_id", F.posexplode("items").alias("pos", "i")).where("i.track is not null")
    return rows.select("playlist_id", "pos", F.col("i.track.name").alias("title"), F.try_element_at("i.track.artists", F.lit(1))["name"].alias("artist"), F.col("i.track.album.name").alias("album"))


def legacy_members(pages: DataFrame) -> DataFrame:
    """(playlist_id, key): the track's id, or a stable surrogate for local items."""
    rows = tracks(pages)
    key = F.when(F.col("is_local") | F.col("track_id").isNull(), T.surrogate_id(F.col("artists"), F.col("title"))).otherwise(F.col("track_id"))
    return rows.select("playlist_id", key.alias("key"))
