"""Duplicate groups in a catalog, their survivors, and the merge into them."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from concordat.functions import text as T
from concordat.functions.similarity import lcs_length, strip_accents
from concordat.operators.similar import ratio_pairs


def duplicate_blocks(tracks: DataFrame) -> DataFrame:
    """Tracks with the block of their fingerprint (short md5 of normalised artists and title) and comparison forms."""
    block = T.short_hash(F.concat(T.fingerprint_norm(F.col("artists")), F.lit("||"), T.fingerprint_norm(F.col("title"))))
    return tracks.where("title <> '' and artists <> ''").select(
        "*", block.alias("block"), T.comparison_title(F.col("title")).alias("__title"), T.sorted_artists(F.col("artists")).alias("__artists")
    )


def duplicate_groups(tracks: DataFrame, threshold: float = 0.95) -> DataFrame:
    """(group_id, leader, uri, primary, manual, n) of each member of a group of two or more.

    Within a block, rows with equal comparison forms are one form; forms are clustered around leaders, in
    order of their smallest uri: a form joins the first leader to whose title and artists both ratios are
    at least ``threshold``. Only forms meet in Python, rows never do, so a block of very many equal rows
    costs one comparison. The survivor is the longest row, then not local, with an id, with the longer
    album name, with the smallest uri; if all durations are equal the group waits for a manual choice and
    its smallest uri stands in.
    """
    rows = duplicate_blocks(tracks)
    forms = rows.groupBy("block", "__title", "__artists").agg(F.min("uri").alias("first"))

    def like(a: str, b: str) -> bool:
        return (not a and not b) or 2.0 * lcs_length(a, b) / (len(a) + len(b)) >= threshold

    def lead(pdf: pd.DataFrame) -> pd.DataFrame:
        leaders: list[tuple[str, str, str]] = []
        out = []
        for r in pdf.sort_values("first").itertuples(index=False):
            found = next((x for x in leaders if like(x[0], r[1]) and like(x[1], r[2])), None)
            if found is None:
                found = (r[1], r[2], r.first)
                leaders.append(found)
            out.append((r.block, r[1], r[2], found[2]))
        return pd.DataFrame(out, columns=["block", "__title", "__artists", "leader"])

    # Only blocks of several forms meet in Python; a form that is alone leads itself.
    several = F.count(F.lit(1)).over(Window.partitionBy("block"))
    forms = forms.withColumn("__forms", several)
    alone = forms.where("__forms = 1").select("block", "__title", "__artists", F.col("first").alias("leader"))
    clusters = forms.where("__forms > 1").drop("__forms").groupBy("block").applyInPandas(lead, "block string, __title string, __artists string, leader string")
    clusters = alone.unionByName(clusters)
    members = rows.join(clusters, ["block", "__title", "__artists"])
    by = Window.partitionBy("leader")
    members = members.withColumn("n", F.count(F.lit(1)).over(by)).where("n > 1")
    length = F.coalesce("duration_ms", F.lit(0))
    same = F.min(length).over(by) == F.max(length).over(by)
    order = [F.desc(length), F.col("is_local").asc(), F.col("track_id").isNull().asc(), F.desc(F.length(F.coalesce("album", F.lit("")))), F.col("uri")]
    members = members.withColumn("manual", same)
    rank = F.when(F.col("manual"), F.row_number().over(by.orderBy("uri"))).otherwise(F.row_number().over(by.orderBy(*order)))
    members = members.withColumn("primary", rank == 1)
    # The smallest uri of a group is its key; its short hash is for show, as two groups may share it. A hash over
    # all uris would gather the whole group.
    return members.select(T.short_hash(F.col("leader")).alias("group_id"), "leader", "uri", "primary", "manual", "n")


def duplicate_report(groups: DataFrame) -> DataFrame:
    """One row: groups, manual groups, rows in groups, rows to remove."""
    return groups.agg(
        F.countDistinct("leader").alias("groups"),
        F.countDistinct(F.when(F.col("manual"), F.col("leader"))).alias("manual_groups"),
        F.count(F.lit(1)).alias("rows"),
        F.count_if(~F.col("primary")).alias("removals"),
    )


def survivors(groups: DataFrame, selections: DataFrame | None = None) -> DataFrame:
    """(uri, survivor) of every member; a selection (group_id, uri) of a member overrides the primary of the member's group."""
    keep = groups.where("primary").select("leader", F.col("uri").alias("survivor"))
    if selections is not None:
        chosen = groups.join(selections.select("group_id", "uri"), ["group_id", "uri"]).groupBy("leader").agg(F.min("uri").alias("__choice"))
        keep = keep.join(chosen, "leader", "left").select("leader", F.coalesce("__choice", "survivor").alias("survivor"))
    return groups.join(keep, "leader").select("uri", "survivor")


def merge_duplicates(tracks: DataFrame, pairs: DataFrame, to: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(tracks, pairs) with members replaced by their survivors ``to(uri, survivor)``; memberships unite."""
    gone = to.where("uri <> survivor").select("uri")
    moved = pairs.join(to, "uri", "left").select(F.coalesce("survivor", "uri").alias("uri"), "playlist_id").distinct()
    return tracks.join(gone, "uri", "left_anti"), moved


def version_pairs(members: DataFrame, threshold: float = 0.85) -> DataFrame:
    """(playlist_id, a, b, ratio): tracks of a playlist with the same first artist and like names, a < b.

    Names are compared once for each distinct pair of an artist, whatever the number of playlists, and only
    if their lengths and letters allow the ratio.
    """
    named = members.withColumn("artist", F.lower(T.primary_artist(F.col("artists")))).withColumn("name", T.name_norm(strip_accents(F.lower("title"))))
    names = named.select("artist", "name").distinct()
    like = ratio_pairs(names, names.withColumnRenamed("name", "other"), "name", "other", threshold, by=("artist",))
    one = named.select("playlist_id", "artist", F.col("uri").alias("a"), "name")
    other = named.select("playlist_id", "artist", F.col("uri").alias("b"), F.col("name").alias("other"))
    return one.join(like, ["artist", "name"]).join(other, ["playlist_id", "artist", "other"]).where("a < b").select("playlist_id", "a", "b", "ratio")


def rank_versions(members: DataFrame, group: list[str]) -> DataFrame:
    """Members with their version score and rank in the group; rank 1 is the one to keep."""
    score = T.version_score(F.col("title"), F.col("duration_ms"))
    rank = F.row_number().over(Window.partitionBy(*group).orderBy(F.desc("score"), "uri"))
    return members.withColumn("score", score).withColumn("rank", rank)


def files_per_uri(mappings: DataFrame) -> DataFrame:
    """(uri, files, n): uris with more than one active file, the paths sorted."""
    live = mappings.where("is_active and uri is not null")
    out = live.groupBy("uri").agg(F.array_sort(F.collect_list("file_path")).alias("files"), F.count(F.lit(1)).alias("n"))
    return out.where("n > 1")


def remove_spare_mapping(mappings: DataFrame, wanted: DataFrame) -> DataFrame:
    """Mappings without those of ``wanted(file_path, uri)`` whose uri has another active file."""
    spare = files_per_uri(mappings).select("uri")
    gone = wanted.join(spare, "uri", "left_semi").select("file_path", "uri")
    return mappings.join(gone, ["file_path", "uri"], "left_anti")
