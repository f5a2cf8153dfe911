"""Consistency reports over catalog, mappings, files and playlist files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from concordat.functions import text as T
from concordat.functions.similarity import edit_similarity
from concordat.operators.catalog import live_mappings


def short_items(inventory: DataFrame, minutes: float = 5) -> DataFrame:
    """(file_path, artist, title, duration_ms) of files shorter than so many minutes."""
    parts = T.split_artist_title(T.stem(F.col("file_path")))
    out = inventory.where(F.col("duration_ms") < F.lit(int(minutes * 60_000)))
    return out.select("file_path", parts["artist"].alias("artist"), parts["title"].alias("title"), "duration_ms")


def short_tracks_with_dates(inventory: DataFrame, mappings: DataFrame, tracks: DataFrame, minutes: float = 5) -> DataFrame:
    """Short files with the date on which their track came to the catalog, if any."""
    dated = live_mappings(mappings).select("file_path", "uri").join(tracks.select("uri", "added_at"), "uri")
    dated = dated.groupBy("file_path").agg(F.max("added_at").alias("added_at"))
    return short_items(inventory, minutes).join(dated, "file_path", "left")


def mapping_mismatches(mappings: DataFrame, tracks: DataFrame, least: float = 0.7) -> DataFrame:
    """(file_path, uri, similarity) of live mappings whose file name is unlike ``artists - title``."""
    both = live_mappings(mappings).join(tracks.select("uri", "artists", "title"), "uri")
    like = edit_similarity(F.lower(T.stem(F.col("file_path"))), F.lower(T.display_name(F.col("artists"), F.col("title"))))
    return both.select("file_path", "uri", F.round(like, 6).alias("similarity")).where(F.col("similarity") < least)


def mapping_summary(mappings: DataFrame, inventory: DataFrame, tracks: DataFrame) -> DataFrame:
    """One row: files, live mappings, unmapped files, mismatched names, uris with several existing files."""
    from concordat.operators.catalog import unmapped_files
    from concordat.operators.duplicates import files_per_uri

    there = inventory.select("file_path").distinct()
    out = inventory.agg(F.count(F.lit(1)).alias("files"))
    out = out.crossJoin(live_mappings(mappings).agg(F.count(F.lit(1)).alias("mappings")))
    out = out.crossJoin(unmapped_files(inventory, mappings).agg(F.count(F.lit(1)).alias("unmapped")))
    out = out.crossJoin(mapping_mismatches(mappings, tracks).agg(F.count(F.lit(1)).alias("mismatched")))
    return out.crossJoin(files_per_uri(mappings.join(there, "file_path", "left_semi")).agg(F.count(F.lit(1)).alias("duplicated")))


def catalog_ids(files: DataFrame, tracks: DataFrame) -> DataFrame:
    """(kind, key, file_path) of what doesn't fit between files' embedded ids and the catalog.

    unknown_id: a file's id the catalog lacks; no_id: a file without one; no_file: a catalog id without a file,
    with the path of a file of the expected name ``artists - title`` if there is one.
    """
    with_id = files.where("embedded_track_id <> ''")
    known = tracks.where("track_id is not null").select(F.col("track_id").alias("embedded_track_id")).distinct()
    unknown = with_id.join(known, "embedded_track_id", "left_anti").select(F.lit("unknown_id").alias("kind"), F.col("embedded_track_id").alias("key"), "file_path")
    bare = files.where("coalesce(embedded_track_id, '') = ''").select(F.lit("no_id").alias("kind"), F.lit(None).cast("string").alias("key"), "file_path")
    lost = tracks.where("track_id is not null").join(with_id.select(F.col("embedded_track_id").alias("track_id")).distinct(), "track_id", "left_anti")
    names = files.where(T.extension(F.col("file_path")).isin(list(T.AUDIO_EXTENSIONS))).groupBy(F.lower(T.stem(F.col("file_path"))).alias("__name")).agg(F.min("file_path").alias("file_path"))
    lost = lost.withColumn("__name", F.lower(T.display_name(F.col("artists"), F.col("title")))).join(names, "__name", "left")
    return unknown.unionByName(bare).unionByName(lost.select(F.lit("no_file").alias("kind"), F.col("track_id").alias("key"), "file_path"))


def valid_ids(rows: DataFrame, key: str) -> DataFrame:
    """The distinct ids of a column that aren't blank."""
    return rows.where(T.strip(F.col(key)) != "").select(key).distinct()


def rating_coverage(ratings: DataFrame, tracks: DataFrame) -> DataFrame:
    """One row: rated uris by kind, those in the catalog, and their share in percent."""
    known = tracks.select("uri", F.lit(True).alias("__known")).distinct()
    kind = T.uri_kind(F.col("uri"))
    both = ratings.join(known, "uri", "left")
    return both.agg(
        F.count(F.lit(1)).alias("rated"),
        F.count_if(kind == "track").alias("track_uris"),
        F.count_if(kind == "local").alias("local_uris"),
        F.count_if(F.coalesce("__known", F.lit(False))).alias("in_catalog"),
    ).withColumn("coverage", F.round(100 * F.col("in_catalog") / F.greatest("rated", F.lit(1)), 4))


def unapplied_ratings(ratings: DataFrame, applied: DataFrame, tracks: DataFrame, mappings: DataFrame) -> DataFrame:
    """(uri, rating, title, reason) of ratings that no item of the collection took."""
    left = ratings.join(applied.select("uri").distinct(), "uri", "left_anti")
    left = left.join(tracks.select("uri", "title"), "uri", "left")
    has = live_mappings(mappings).select("uri", F.lit(True).alias("__file")).distinct()
    reason = F.when(F.col("title").isNull(), "not_in_catalog").when(F.col("__file").isNull(), "no_mapping").otherwise("not_in_playlists")
    return left.join(has, "uri", "left").select("uri", "rating", "title", reason.alias("reason"))


def extension_counts(files: DataFrame) -> DataFrame:
    """(ext, n) of the audio extensions, zero included."""
    spark = files.sparkSession
    known = spark.createDataFrame([(e,) for e in T.AUDIO_EXTENSIONS], "ext string")
    found = files.groupBy(T.extension(F.col("file_path")).alias("ext")).agg(F.count(F.lit(1)).alias("n"))
    return known.join(found, "ext", "left").select("ext", F.coalesce("n", F.lit(0)).cast("long").alias("n"))
