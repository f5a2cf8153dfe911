"""Folders of playlists: structure tables, reorganisation plans and look-ups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from concordat.functions import text as T


def merge_structure(saved: DataFrame, names: DataFrame) -> DataFrame:
    """(folder, name, pos): the saved structure without vanished playlists, and new names in the root, by name.

    ``saved(folder, name, pos)``, ``names(name)``; the root is the empty folder.
    """
    kept = saved.join(names.select("name").distinct(), "name", "left_semi").select("folder", "name", "pos")
    new = names.select("name").distinct().join(saved.select("name"), "name", "left_anti").select(F.lit("").alias("folder"), "name", F.lit(None).cast("int").alias("pos"))
    both = kept.unionByName(new)
    pos = F.row_number().over(Window.partitionBy("folder").orderBy(F.col("pos").asc_nulls_last(), "name"))
    return both.select("folder", "name", pos.alias("pos"))


def plan_moves(current: DataFrame, target: DataFrame) -> DataFrame:
    """(name, action, from_folder, to_folder): create, move, remove or keep each playlist file."""
    a = current.select("name", F.col("folder").alias("from_folder"))
    b = target.select("name", F.col("folder").alias("to_folder"))
    both = a.join(b, "name", "full_outer")
    action = F.when(F.col("from_folder").isNull(), "create").when(F.col("to_folder").isNull(), "remove").when(F.col("from_folder") != F.col("to_folder"), "move").otherwise("keep")
    return both.select("name", action.alias("action"), "from_folder", "to_folder")


def folders_with_parents(table: DataFrame) -> DataFrame:
    """(folder) of every folder in use and all above it."""
    return table.select(F.explode(T.ancestors(F.col("folder"))).alias("folder")).distinct()


def plan_folders(current: DataFrame, target: DataFrame) -> DataFrame:
    """(folder, action): folders to create and to remove."""
    a = folders_with_parents(current).withColumn("__a", F.lit(True))
    b = folders_with_parents(target).withColumn("__b", F.lit(True))
    action = F.when(F.col("__a").isNull(), "create").when(F.col("__b").isNull(), "remove")
    return a.join(b, "folder", "full_outer").select("folder", action.alias("action")).where("action is not null")


def child_counts(table: DataFrame) -> DataFrame:
    """(folder, folders, playlists): direct children of each folder, the root included."""
    all_ = folders_with_parents(table)
    subs = all_.select(F.regexp_replace("folder", "/?[^/]*$", "").alias("folder")).groupBy("folder").agg(F.count(F.lit(1)).alias("folders"))
    own = table.groupBy("folder").agg(F.countDistinct("name").alias("playlists"))
    every = all_.unionByName(table.sparkSession.createDataFrame([("",)], "folder string"))
    out = every.join(subs, "folder", "left").join(own, "folder", "left")
    return out.select("folder", F.coalesce("folders", F.lit(0)).cast("long").alias("folders"), F.coalesce("playlists", F.lit(0)).cast("long").alias("playlists"))


def orphaned(files: DataFrame, names: DataFrame, structure: DataFrame) -> DataFrame:
    """(name, kind): playlist files, and entries of the structure, of no playlist."""
    known = names.select("name").distinct()
    a = files.select("name").distinct().join(known, "name", "left_anti").withColumn("kind", F.lit("file"))
    b = structure.select("name").distinct().join(known, "name", "left_anti").withColumn("kind", F.lit("entry"))
    return a.unionByName(b)


def folder_of_playlists(names: DataFrame, structure: DataFrame) -> DataFrame:
    """(name, folder, rule): by exact name, by file-safe name, by either in lower case; the root else."""
    keys = [("exact", F.col("name")), ("safe", T.file_safe(F.col("name"))), ("lower", F.lower("name")), ("lower_safe", F.lower(T.file_safe(F.col("name"))))]
    mine = names.select("name", F.explode(F.array(*[F.struct(F.lit(k).alias("rank"), F.lit(r).alias("rule"), c.alias("key")) for k, (r, c) in enumerate(keys)])).alias("x")).select("name", "x.*")
    theirs = structure.select("folder", F.explode(F.array(*[F.struct(F.lit(k).alias("rank"), c.alias("key")) for k, (_, c) in enumerate(keys)])).alias("x")).select("folder", "x.*")
    theirs = theirs.groupBy("rank", "key").agg(F.min("folder").alias("folder"))
    best = mine.join(theirs, ["rank", "key"]).groupBy("name").agg(F.min(F.struct("rank", "folder", "rule")).alias("b"))
    out = names.select("name").distinct().join(best, "name", "left")
    return out.select("name", F.coalesce("b.folder", F.lit("")).alias("folder"), F.coalesce("b.rule", F.lit("root")).alias("rule"))


def same_within(a: DataFrame, b: DataFrame, key: str, most: int = 2) -> DataFrame:
    """One row: one-sided keys of each side, and whether there are ``most`` at most."""
    left = a.select(key).distinct().withColumn("__a", F.lit(True))
    right = b.select(key).distinct().withColumn("__b", F.lit(True))
    both = left.join(right, key, "full_outer")
    out = both.agg(F.count_if(F.col("__b").isNull()).alias("only_a"), F.count_if(F.col("__a").isNull()).alias("only_b"))
    return out.withColumn("same", F.col("only_a") + F.col("only_b") <= most)


def structure_rows(json_table: DataFrame, col: str = "json") -> DataFrame:
    """(folder, name, pos) of JSON texts like {"folders": {"a/b": {"playlists": ["x"]}}, "root_playlists": ["y"]}."""
    kind = "struct<folders: map<string, struct<playlists: array<string>>>, root_playlists: array<string>>"
    parsed = json_table.select(F.from_json(col, kind).alias("j"))
    root = parsed.select(F.lit("").alias("folder"), F.posexplode("j.root_playlists").alias("pos", "name"))
    deep = parsed.select(F.explode("j.folders").alias("folder", "v")).select("folder", F.posexplode("v.playlists").alias("pos", "name"))
    return root.unionByName(deep).select("folder", "name", "pos")


def structure_json(table: DataFrame) -> DataFrame:
    """One row (json): the text that ``structure_rows`` reads; folders and entries are ordered."""
    lists = table.groupBy("folder").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "name"))), lambda x: x["name"]).alias("playlists"))
    folders = F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("folder") != "", F.struct("folder", F.struct("playlists"))))))
    root = F.coalesce(F.max(F.when(F.col("folder") == "", F.col("playlists"))), F.array().cast("array<string>"))
    return lists.agg(F.to_json(F.struct(folders.alias("folders"), root.alias("root_playlists"))).alias("json"))
