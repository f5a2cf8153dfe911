"""Playlist files: writing, parsing, searching and checking M3U text, and the collection built from it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from concordat.functions import text as T
from concordat.operators.catalog import latest_file, live_mappings
from concordat.operators.hierarchy import child_counts, folder_of_playlists
from concordat.operators.postings import contained
from concordat.tables import staged

HEADER = "#EXTM3U"


def entries(pairs: DataFrame, tracks: DataFrame, mappings: DataFrame, inventory: DataFrame | None = None) -> DataFrame:
    """(playlist_id, pos, uri, duration, info, path): members with a file that exists, in order of uri."""
    files = latest_file(mappings)
    if inventory is not None:
        files = files.join(inventory.select("file_path").distinct(), "file_path", "left_semi")
    out = pairs.join(files, "uri").join(tracks.select("uri", "title", "artists", "duration_ms"), "uri")
    pos = F.row_number().over(Window.partitionBy("playlist_id").orderBy("uri"))
    seconds = F.floor(F.coalesce("duration_ms", F.lit(0)) / 1000).cast("int")
    return out.select("playlist_id", pos.alias("pos"), "uri", seconds.alias("duration"), T.display_name(F.col("artists"), F.col("title")).alias("info"), F.col("file_path").alias("path"))


def m3u_lines(listed: DataFrame) -> DataFrame:
    """(playlist_id, line_no, line) of each playlist's file: the header, then two lines an entry."""
    info = F.concat(F.lit("#EXTINF:"), F.col("duration").cast("string"), F.lit(","), F.col("info"))
    two = F.array(F.struct((2 * F.col("pos") - 1).alias("line_no"), info.alias("line")), F.struct((2 * F.col("pos")).alias("line_no"), F.col("path").alias("line")))
    body = listed.select("playlist_id", F.explode(two).alias("x")).select("playlist_id", "x.line_no", "x.line")
    head = listed.select("playlist_id").distinct().select("playlist_id", F.lit(0).alias("line_no"), F.lit(HEADER).alias("line"))
    return head.unionByName(body)


def m3u_text(lines: DataFrame) -> DataFrame:
    """(playlist_id, content): one text for each playlist, as a file holds it."""
    ordered = F.array_sort(F.collect_list(F.struct("line_no", "line")))
    return lines.groupBy("playlist_id").agg(F.array_join(F.transform(ordered, lambda x: x["line"]), "\n").alias("content"))


def m3u_counts(parents: DataFrame, pairs: DataFrame, listed: DataFrame) -> DataFrame:
    """(playlist_id, members, added) of each playlist, zero included."""
    all_ = pairs.groupBy("playlist_id").agg(F.count(F.lit(1)).alias("members"))
    got = listed.groupBy("playlist_id").agg(F.count(F.lit(1)).alias("added"))
    out = parents.select("playlist_id").join(all_, "playlist_id", "left").join(got, "playlist_id", "left")
    return out.select("playlist_id", F.coalesce("members", F.lit(0)).cast("long").alias("members"), F.coalesce("added", F.lit(0)).cast("long").alias("added"))


def parse_m3u(files: DataFrame) -> DataFrame:
    """(file, pos, duration, info, artist, title, path) of the entries in ``files(file, content)``.

    A path takes the note of the line before it, if that is one; other comments and blank lines are
    skipped. The lines of a file are one array, so nothing is shuffled.
    """
    lines = F.filter(F.transform(F.split("content", "\r\n|\n|\r"), T.strip), lambda x: (x != "") & (~F.startswith(x, F.lit("#")) | F.startswith(x, F.lit("#EXTINF:"))))
    rows = files.select("file", F.posexplode(F.arrays_zip(lines.alias("line"), F.slice(F.concat(F.array(F.lit("")), lines), 1, F.greatest(F.size(lines), F.lit(1))).alias("before"))).alias("line_no", "x"))
    rows = rows.select("file", "line_no", F.col("x.line").alias("path"), F.col("x.before").alias("before")).where(~F.startswith("path", F.lit("#")))
    # The n-th path of a file is at line 2n - 1 of its kept lines only if each has a note; count them instead.
    pos = F.row_number().over(Window.partitionBy("file").orderBy("line_no"))
    return _noted(rows.withColumn("pos", pos))


def parse_lines(lines: DataFrame, block: int = 4096) -> DataFrame:
    """What ``parse_m3u`` gives, of ``lines(file, line_no, line)``: the lines stay rows.

    A file is cut into blocks of ``block`` line numbers, so that one with very many lines is work for many
    tasks. Each block is gone through in order; what it needs of those before it is their last kept line and
    their number of paths. Lines are numbered without repeats; a null line is blank.
    """
    kept = lines.select("file", "line_no", T.strip(F.coalesce("line", F.lit(""))).alias("line"), F.floor(F.col("line_no") / block).alias("__block"))
    kept = kept.where((F.col("line") != "") & (~F.startswith("line", F.lit("#")) | F.startswith("line", F.lit("#EXTINF:"))))
    kept = staged(kept.withColumn("__path", (~F.startswith("line", F.lit("#"))).cast("long")), "playlist-lines")
    blocks = kept.groupBy("file", "__block").agg(F.max_by("line", "line_no").alias("last"), F.sum("__path").alias("n"))
    of_file = Window.partitionBy("file").orderBy("__block")
    blocks = blocks.select("file", "__block", F.lag("last").over(of_file).alias("__last"), (F.sum("n").over(of_file) - F.col("n")).alias("__paths"))
    own = Window.partitionBy("file", "__block").orderBy("line_no")
    rows = kept.withColumns({"before": F.lag("line").over(own), "__own": F.sum("__path").over(own)}).where("__path = 1").join(blocks, ["file", "__block"])
    rows = rows.withColumns({"before": F.coalesce("before", "__last", F.lit("")), "pos": (F.col("__paths") + F.col("__own")).cast("int")})
    return _noted(rows.withColumnRenamed("line", "path"))


def _noted(rows: DataFrame) -> DataFrame:
    """The entries of ``rows(file, pos, path, before)``, with what the line before says of each."""
    noted = F.startswith("before", F.lit("#EXTINF:"))
    seconds = F.coalesce(F.regexp_extract("before", r"^#EXTINF:\s*([^,]*)", 1).try_cast("double").cast("int"), F.lit(0))
    info = F.when(noted, T.strip(F.regexp_extract("before", r"^#EXTINF:[^,]*,(.*)$", 1))).otherwise(F.lit(""))
    rows = rows.withColumn("info", info).withColumn("p", T.split_artist_title(F.col("info")))
    return rows.select("file", "pos", F.when(noted, seconds).otherwise(F.lit(0)).alias("duration"), "info", F.col("p.artist").alias("artist"), F.col("p.title").alias("title"), "path")


def entry_uris(parsed: DataFrame, mappings: DataFrame) -> DataFrame:
    """Entries with the uri of their path, null if none has it."""
    known = live_mappings(mappings).groupBy(T.path_key(F.col("file_path")).alias("__key")).agg(F.max_by("uri", "mapping_id").alias("uri"))
    return parsed.withColumn("__key", T.path_key(F.col("path"))).join(known, "__key", "left").drop("__key")


def playlists_of_paths(parsed: DataFrame, wanted: DataFrame) -> DataFrame:
    """(path, files): the playlist files that hold each wanted path, empty lists included."""
    keyed = parsed.select("file", T.path_key(F.col("path")).alias("__key")).distinct()
    found = keyed.groupBy("__key").agg(F.array_sort(F.collect_set("file")).alias("files"))
    out = wanted.select("path", T.path_key(F.col("path")).alias("__key")).join(found, "__key", "left")
    return out.select("path", F.coalesce("files", F.array().cast("array<string>")).alias("files"))


def playlists_of_titles(parsed: DataFrame, wanted: DataFrame) -> DataFrame:
    """(wanted, n_files, n_entries) of entries whose note holds a wanted text, case aside; distinct notes are searched."""
    notes = parsed.groupBy(F.lower("info").alias("note"), "file").agg(F.count(F.lit(1)).alias("n"))
    w = wanted.select("wanted", F.lower("wanted").alias("needle")).distinct()
    held = contained(w.select("needle"), notes.select(F.col("note").alias("text")))
    hits = w.join(held, "needle").select("wanted", F.col("text").alias("note"))
    both = hits.join(notes, "note").groupBy("wanted").agg(F.countDistinct("file").alias("n_files"), F.sum("n").alias("n_entries"))
    out = wanted.select("wanted").distinct().join(both, "wanted", "left")
    return out.select("wanted", F.coalesce("n_files", F.lit(0)).cast("long").alias("n_files"), F.coalesce("n_entries", F.lit(0)).cast("long").alias("n_entries"))


def validate_playlists(playlists: DataFrame, pairs: DataFrame, mappings: DataFrame, inventory: DataFrame, parsed: DataFrame) -> DataFrame:
    """One row for each playlist: catalog, local and file counts, and what is missing, unexpected or not downloaded.

    ``parsed`` has the playlist_id as its file. A member is local if a live mapping of it leads to a file that
    exists; it is missing if local but not in the playlist's file; an entry is unexpected if its uri is no
    member. discrepancy is listed - local; identified is what is missing or unexpected, unidentified the rest
    of the discrepancy's size. needs_update: no file, or anything missing or unexpected, or a discrepancy.
    """
    there = inventory.select("file_path", F.lit(1).alias("__there")).distinct()
    state = live_mappings(mappings).join(there, "file_path", "left").groupBy("uri").agg(F.max("__there").alias("local"), F.lit(1).alias("mapped"))
    member = pairs.select("playlist_id", "uri").distinct().join(state, "uri", "left").withColumn("__member", F.lit(1))
    listed = entry_uris(parsed, mappings).select(F.col("file").alias("playlist_id"), "uri").where("uri is not null").distinct().withColumn("__listed", F.lit(1))
    both = member.join(listed, ["playlist_id", "uri"], "full_outer")
    counts = both.groupBy("playlist_id").agg(
        F.count("__member").alias("catalog"),
        F.count_if(F.expr("local = 1")).alias("local"),
        F.count("__listed").alias("listed"),
        F.count_if(F.expr("local = 1 and __listed is null")).alias("missing"),
        F.count_if(F.expr("__listed = 1 and __member is null")).alias("unexpected"),
        F.count_if(F.expr("__member = 1 and mapped = 1 and local is null")).alias("file_missing"),
        F.count_if(F.expr("__member = 1 and mapped is null")).alias("no_mapping"),
    )
    files = parsed.select(F.col("file").alias("playlist_id"), F.lit(True).alias("has_file")).distinct()
    out = playlists.select("playlist_id", "name").join(counts, "playlist_id", "left").join(files, "playlist_id", "left")
    names = ["catalog", "local", "listed", "missing", "unexpected", "file_missing", "no_mapping"]
    out = out.select("playlist_id", "name", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in names], F.coalesce("has_file", F.lit(False)).alias("has_file"))
    out = out.withColumn("discrepancy", F.col("listed") - F.col("local")).withColumn("identified", F.col("missing") + F.col("unexpected"))
    out = out.withColumn("unidentified", F.abs("discrepancy") - F.col("identified"))
    return out.withColumn("needs_update", ~F.col("has_file") | (F.col("identified") > 0) | (F.col("discrepancy") != 0))


def by_severity(checked: DataFrame) -> DataFrame:
    """Checked playlists, the worst first: without a file, then by size of the discrepancy, number of identified faults and name."""
    return checked.orderBy(F.col("has_file").asc(), F.desc(F.abs("discrepancy")), F.desc("identified"), F.desc("name"))


def validation_summary(checked: DataFrame) -> DataFrame:
    """One row: playlists, those to update, those without a file."""
    return checked.agg(F.count(F.lit(1)).alias("total"), F.count_if("needs_update").alias("needing_update"), F.count_if(~F.col("has_file")).alias("missing_files"))


def plan_files(wanted: DataFrame, playlists: DataFrame, structure: DataFrame, existing: DataFrame, overwrite: bool = True) -> DataFrame:
    """(playlist_id, name, folder, m3u_path, action): where each wanted playlist's file goes, and whether it is written.

    Folders come from ``structure`` by name or by its safe forms, else the root. action: unknown for an id
    without a playlist, skip for a file in ``existing(path)`` unless ``overwrite``, else write.
    """
    known = wanted.select("playlist_id").distinct().join(playlists.select("playlist_id", "name"), "playlist_id", "left")
    placed = known.join(folder_of_playlists(known.where("name is not null").select("name"), structure).select("name", "folder"), "name", "left")
    file = F.concat(T.file_safe_spaced(F.col("name")), F.lit(".m3u"))
    path = F.when(F.col("folder") == "", file).otherwise(F.concat_ws("/", "folder", file))
    there = existing.select(F.col("path").alias("m3u_path"), F.lit(True).alias("__there")).distinct()
    out = placed.withColumn("m3u_path", F.when(F.col("name").isNotNull(), path)).join(there, "m3u_path", "left")
    action = F.when(F.col("name").isNull(), "unknown").when(F.col("__there") & F.lit(not overwrite), "skip").otherwise("write")
    return out.select("playlist_id", "name", "folder", "m3u_path", action.alias("action"))


def ordered_nodes(files: DataFrame, structure: DataFrame, folders: DataFrame) -> DataFrame:
    """(folder, name, folder_index, index) of ``files(folder, name)`` in the order of the saved structure.

    The root comes first, then folders by their place in ``folders(folder, pos)``, 999 if unlisted; within one by
    the place in ``structure(folder, name, pos)``, 999 if unlisted, then by name.
    """
    own = structure.groupBy("folder", "name").agg(F.min("pos").alias("__pos"))
    out = files.select("folder", "name").distinct().join(folders.select("folder", F.col("pos").alias("__folder")), "folder", "left").join(own, ["folder", "name"], "left")
    at = F.when(F.col("folder") == "", F.lit(-1)).otherwise(F.coalesce("__folder", F.lit(999))).cast("int")
    out = out.select("folder", "name", at.alias("folder_index"), F.coalesce("__pos", F.lit(999)).cast("int").alias("index"))
    return out.orderBy("folder_index", "index", "name")


def collection_nodes(files: DataFrame, entries: DataFrame, structure: DataFrame, folders: DataFrame) -> DataFrame:
    """(kind, folder, name, folder_index, index, n): the folders of the collection with their direct children (index -1), and its playlists with their entries.

    ``files(file, folder, name)`` are the playlist files, ``entries(file, track_no, pos)`` their references.
    """
    counts = entries.groupBy("file").agg(F.count(F.lit(1)).alias("n"))
    lists = files.join(ordered_nodes(files, structure, folders), ["folder", "name"]).join(counts, "file", "left")
    lists = lists.select(F.lit("playlist").alias("kind"), "folder", "name", "folder_index", "index", F.coalesce("n", F.lit(0)).cast("long").alias("n"))
    tree = child_counts(files).join(folders.select("folder", F.col("pos").alias("__pos")), "folder", "left")
    at = F.when(F.col("folder") == "", F.lit(-1)).otherwise(F.coalesce("__pos", F.lit(999))).cast("int")
    tree = tree.select(F.lit("folder").alias("kind"), "folder", T.file_name(F.col("folder")).alias("name"), at.alias("folder_index"), F.lit(-1).alias("index"), (F.col("folders") + F.col("playlists")).alias("n"))
    return tree.unionByName(lists)


def collection_tracks(parsed: DataFrame, mappings: DataFrame, ratings: DataFrame) -> DataFrame:
    """(track_no, path, key, artist, title, duration, location, kind, uri, stars, energy): each path once, numbered by first place."""
    first = parsed.groupBy("path").agg(F.min(F.struct("file", "pos", "artist", "title", "duration")).alias("f"))
    rated = entry_uris(first.select("path", "f.*"), mappings).join(ratings, "uri", "left")
    # Numbers ascend by playlist file, then by place: ranks within a file plus the counts of the files before.
    own = rated.withColumn("r", F.row_number().over(Window.partitionBy("file").orderBy("pos")))
    counts = own.groupBy("file").agg(F.count(F.lit(1)).alias("c"))
    before = counts.withColumn("before", F.sum("c").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)))
    own = own.join(before.select("file", F.coalesce("before", F.lit(0)).alias("before")), "file")
    key = F.concat_ws("_", "artist", "title", T.short_hash(F.col("path")))
    return own.select(
        (F.col("before") + F.col("r")).alias("track_no"), "path", key.alias("key"), "artist", "title", "duration",
        T.location_uri(F.col("path")).alias("location"), T.file_kind(F.col("path")).alias("kind"), "uri",
        T.stars(F.col("rating")).alias("stars"), "energy",
    )


def collection_entries(parsed: DataFrame, collection: DataFrame) -> DataFrame:
    """(file, track_no, pos): a playlist's distinct tracks at their first places."""
    first = parsed.groupBy("file", "path").agg(F.min("pos").alias("pos"))
    return first.join(collection.select("path", "track_no"), "path").select("file", "track_no", "pos")


def also_in(pairs: DataFrame) -> DataFrame:
    """(uri, playlist_id, others): the other playlists of each member, sorted."""
    sets = pairs.groupBy("uri").agg(F.array_sort(F.collect_set("playlist_id")).alias("all"))
    return pairs.join(sets, "uri").select("uri", "playlist_id", F.array_remove("all", F.col("playlist_id")).alias("others"))
