"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Rows of an Arrow batch while a table is written: texts can be long, and a task holds two batches or more at once.
BATCH_ROWS = 1_000
#: Scan partitions that one task of ``fewer_tasks`` reads of a large table.
MERGED = 8
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
_MADE: list[list[DataFrame]] = []
_FOLDERS: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a temporary one is set only for a local master."""
    conf = spark.sparkContext.getConf()
    folder = conf.get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    folder = folder or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="spark-shared-")
    spark.sparkContext.setCheckpointDir(f"file://{folder}")
    return f"file://{folder}"


@contextmanager
def short_batches(spark: SparkSession) -> Iterator[None]:
    """What starts within the block passes at most BATCH_ROWS rows to Python at once; then the session's own setting holds again."""
    own = spark.conf.get(_BATCH, None)
    if own is None or not 0 < int(own) <= BATCH_ROWS:
        spark.conf.set(_BATCH, BATCH_ROWS)
    try:
        yield
    finally:
        if own is None:
            spark.conf.unset(_BATCH)
        else:
            spark.conf.set(_BATCH, own)


def table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back.

    This cuts lineage: what reads the table later survives the loss of any executor, and nothing
    above it runs twice. Python tasks get short batches.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    with short_batches(spark):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _FOLDERS[out] = path
    for made in _MADE:
        made.append(out)
    return out


def discard(*tables: DataFrame) -> None:
    """Delete the files of what ``table`` returned, once nothing reads them any more."""
    for df in tables:
        spark = df.sparkSession
        folder = _FOLDERS.pop(df, None)
        if folder:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def tables_made() -> Iterator[list[DataFrame]]:
    """The list of what ``table`` returns while the block runs."""
    made: list[DataFrame] = []
    _MADE.append(made)
    try:
        yield made
    finally:
        _MADE.remove(made)


def fewer_tasks(df: DataFrame, read: DataFrame) -> DataFrame:
    """``df``, made of each row of ``read``, in fewer tasks without a shuffle: twice as many as a shuffle has partitions, or more where ``read`` is large.

    For tasks that each give a table of fixed size, some megabytes. One for each ``MERGED`` scan partitions (a
    gigabyte at the usual size) is little beside what it read, and a lost task reads no more than that again.
    The size is Spark's own estimate, for which nothing runs; if it is too large, fewer partitions are merged.
    """
    spark = df.sparkSession
    size = int(str(read._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    scan = spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    tasks = max(2 * int(spark.conf.get("spark.sql.shuffle.partitions")), size // (MERGED * scan))
    return df.coalesce(min(tasks, 2**31 - 1))


def numbered(docs: DataFrame) -> DataFrame:
    """``docs`` with a number of each row (``__row``), written once, so that all that reads it sees the same numbers."""
    return table(docs.withColumn("__row", F.monotonically_increasing_id()), "rows")


def types_of(docs: DataFrame, keep: tuple[str, ...]) -> list[str]:
    """The columns ``keep`` with their types, as a schema names them."""
    return [f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep]


def free_names(keep: tuple[str, ...], *own: str) -> None:
    """An error if a column to keep has a name of the operator's own, as two columns of one name would be returned."""
    if clash := sorted(set(keep) & set(own)):
        raise ValueError(f"columns with names of the operator's own: {', '.join(clash)}")


def cut(df: DataFrame) -> DataFrame:
    """An eager reliable checkpoint, for small tables of iterative jobs."""
    shared = shared_dir(df.sparkSession)
    if not df.sparkSession.sparkContext.getCheckpointDir():
        df.sparkSession.sparkContext.setCheckpointDir(shared)
    return df.checkpoint(eager=True)
