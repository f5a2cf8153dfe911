"""Intermediate tables and folders in the place that all executors share, and their removal."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from typing import NamedTuple
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession


class Folder(NamedTuple):
    """A folder that was handed out."""

    spark: SparkSession
    path: str


_MADE: list[list[DataFrame | Folder]] = []
_FOLDERS: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a temporary one is set only for a local master."""
    conf = spark.sparkContext.getConf()
    place = conf.get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    place = place or spark.sparkContext.getCheckpointDir()
    if place:
        return place.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    place = tempfile.mkdtemp(prefix="spark-shared-")
    spark.sparkContext.setCheckpointDir(f"file://{place}")
    return f"file://{place}"


def _note(made: DataFrame | Folder) -> None:
    for scope in _MADE:
        scope.append(made)


def folder(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _note(Folder(spark, path))
    return path


def local_path(spark: SparkSession, path: str) -> str | None:
    """The path as Python's ``open`` takes it, if it is in a file system that every executor has mounted; else none."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    scheme = place.getFileSystem(spark._jsc.hadoopConfiguration()).getUri().getScheme()
    return place.toUri().getPath() if scheme == "file" else None


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back.

    This cuts lineage: what reads the table later survives the loss of any executor, and nothing
    above it runs twice.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _FOLDERS[out] = path
    _note(out)
    return out


def discard(*made: DataFrame | Folder) -> None:
    """Delete the files of what ``staged`` or a scope gave, once nothing reads them any more."""
    for x in made:
        path = x.path if isinstance(x, Folder) else _FOLDERS.pop(x, None)
        if path:
            spark = x.spark if isinstance(x, Folder) else x.sparkSession
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


@contextmanager
def tables_made() -> Iterator[list[DataFrame | Folder]]:
    """The list of the tables and folders that are made while the block runs; ``discard(*made)`` removes them."""
    made: list[DataFrame | Folder] = []
    _MADE.append(made)
    try:
        yield made
    finally:
        # By identity: lists compare by their items.
        _MADE[:] = [x for x in _MADE if x is not made]
