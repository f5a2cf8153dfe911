"""Files as tables: inventories, playlist texts and key lists."""

from __future__ import annotations

import re
from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from concordat.functions import text as T
from concordat.tables import staged


def _tasks(spark: SparkSession) -> int:
    """Tasks for small files: a few for each core, as many as a shuffle has at least."""
    return max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


@contextmanager
def few_tasks(spark: SparkSession) -> Iterator[None]:
    """Folders that are listed while the block runs are dealt to a few tasks for each core; Spark's 10,000 tasks cost more than most listings."""
    name = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(int(before), _tasks(spark))))
    try:
        yield
    finally:
        spark.conf.set(name, before)


#: Names of audio files, in any case.
_AUDIO = "*.{" + ",".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in e) for e in T.AUDIO_EXTENSIONS) + "}"


def _found(spark: SparkSession, root: str, names: str) -> DataFrame:
    """The files of a root, dealt to a few tasks for each core; a scan has a task for every few files, and what is written of it a file for each task."""
    with few_tasks(spark):
        return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", names).load(root).coalesce(_tasks(spark))


def inventory(spark: SparkSession, root: str) -> DataFrame:
    """(file_path, size, modified, ext) of audio files under a root; contents are not read."""
    found = _found(spark, root, _AUDIO)
    out = found.select(F.col("path").alias("file_path"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"), T.extension(F.col("path")).alias("ext"))
    return out.where(F.col("ext").isin(list(T.AUDIO_EXTENSIONS)))


def fingerprints(spark: SparkSession, root: str) -> DataFrame:
    """(file_path, quick, full): md5 of the first 8 KB with size, name and time; SHA-256 of all."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    quick = T.content_hash(F.col("content"), F.col("length"), T.file_name(F.col("path")), F.col("modificationTime"))
    return found.select(F.col("path").alias("file_path"), quick.alias("quick"), F.sha2("content", 256).alias("full"))


#: Paths that one scan names.
PATHS = 10_000
_GLOB = re.compile(r"([\\*?\[\]{}])")


def refreshed(spark: SparkSession, root: str, known: DataFrame | None = None) -> DataFrame:
    """(file_path, size, modified, full, was_read): the audio files under a root with the SHA-256 of their contents.

    Of files that ``known``, an earlier result, has with the same size and time the hash is taken over; only the
    others are read. Files that are gone are not in the result. The list of paths to read is in the driver,
    as is any list of files that Spark scans; without ``known`` the root is listed once and all of it is read.
    """
    def read(found: DataFrame) -> DataFrame:
        return found.select(F.col("path").alias("file_path"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"), F.sha2("content", 256).alias("full"), F.lit(True).alias("was_read"))

    if known is None:
        return read(_found(spark, root, _AUDIO))
    now = staged(inventory(spark, root).select("file_path", "size", "modified"), "inventory")
    keys = ["file_path", "size", "modified"]
    same, due = now.join(known.select(*keys, "full"), keys), now.join(known.select(*keys), keys, "left_anti")
    paths = [_GLOB.sub(r"\\\1", r["file_path"]) for r in due.select("file_path").collect()]
    with few_tasks(spark):
        parts = [read(spark.read.format("binaryFile").load(paths[k : k + PATHS]).coalesce(_tasks(spark))) for k in range(0, len(paths), PATHS)]
    return reduce(DataFrame.unionByName, [*parts, same.withColumn("was_read", F.lit(False))])


def playlist_texts(spark: SparkSession, root: str, stream: bool = False) -> DataFrame:
    """(file, folder, name, content) of M3U files under a root, as UTF-8 where valid, else as Latin-1; as a stream, new files as they come."""
    names = "*.[mM]3[uU]"
    if stream:
        reader = spark.readStream.schema("path string, modificationTime timestamp, length long, content binary").format("binaryFile")
        found = reader.option("recursiveFileLookup", True).option("pathGlobFilter", names).load(root).coalesce(_tasks(spark))
    else:
        found = _found(spark, root, names)
    raw = F.col("content")
    content = F.when(F.is_valid_utf8(raw.cast("string")), raw.cast("string")).otherwise(F.decode(raw, "ISO-8859-1"))
    return found.select(F.col("path").alias("file"), T.folder_of(F.col("path")).alias("folder"), T.stem(F.col("path")).alias("name"), content.alias("content"))


def latest(spark: SparkSession, root: str, preferred: str) -> DataFrame:
    """One row (file): the file of the preferred name, else the last changed."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "modificationTime")
    order = F.struct((T.file_name(F.col("path")) == preferred).alias("first"), "modificationTime", "path")
    return found.agg(F.max_by("path", order).alias("file"))


def keys(spark: SparkSession, path: str) -> DataFrame:
    """(key): the lines of a text file without blanks."""
    return spark.read.text(path).select(T.strip(F.col("value")).alias("key")).where("key <> ''")


def ratings(spark: SparkSession, path: str) -> DataFrame:
    """(uri, rating, energy) of a rating file, one JSON object a line; entries without a uri or rating are skipped, of several of a uri the last by file and place counts."""
    rows = spark.read.schema("uri string, rating double, energy string").json(path).where("trim(uri) <> '' and rating is not null")
    rows = rows.select("*", F.struct(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("place")).alias("order"))
    last = rows.groupBy("uri").agg(F.max_by(F.struct("rating", "energy"), "order").alias("x"))
    return last.select("uri", "x.rating", "x.energy")


def exclusion_config(spark: SparkSession, path: str) -> dict[str, list[str]]:
    """The four lists of an exclusion file, a small configuration; lists that it lacks are empty."""
    schema = "forbidden_words array<string>, forbidden_playlists array<string>, forbidden_playlist_ids array<string>, description_keywords array<string>"
    row = spark.read.schema(schema).option("multiLine", True).json(path).first()
    names = {"forbidden_words": "words", "forbidden_playlists": "names", "forbidden_playlist_ids": "keys", "description_keywords": "keywords"}
    return {b: list((row and row[a]) or []) for a, b in names.items()}
