"""Plans kept between analysis and application, and tables that become visible together.

A catalog folder holds data files of table versions, and manifests: one for each state, which names the
files of all tables. A state exists once its manifest does, so readers see all tables of a state or
none of them, and a writer that fails before leaves the state as it was. One writer at a time is meant;
a second one that began from the same state is refused.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

Tables = dict[str, DataFrame]
_MANIFEST = "tables map<string, string>, schemas map<string, string>, prints map<string, string>, number bigint"


class StalePlan(Exception):
    """The tables are not those from which the plan, or the new state, was made."""


def fingerprint(table: DataFrame) -> str:
    """The number of rows and a sum over their hashes: the same for the same rows in any order, nulls and repeats counting."""
    cols = [F.to_json(F.struct(*[F.col(f"`{c}`").alias(c) for c in sorted(table.columns)]))]
    one = F.xxhash64(*cols).cast("decimal(38,0)")
    row = table.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(one), F.lit(0)).cast("string").alias("h")).first()
    return f"{row['n']}:{row['h']}"


def _write(spark: SparkSession, folder: str, number: int, tables: Tables, prints: dict[str, str], kept: dict | None = None, partition_by: dict[str, list[str]] | None = None) -> None:
    """The tables' files, then the manifest, whose single file is there or not. ``kept`` has the places and schemas of tables of an earlier state."""
    places = {name: f"{folder}/data/{name}-{number:08d}-{uuid.uuid4().hex}" for name in tables}
    for name, df in tables.items():
        df.write.partitionBy(*(partition_by or {}).get(name, ())).parquet(places[name])
    schemas = {name: df.schema.json() for name, df in tables.items()}
    if kept:
        places, schemas = {**kept["tables"], **places}, {**kept["schemas"], **schemas}
    row = spark.createDataFrame([(places, schemas, prints, number)], _MANIFEST)
    row.coalesce(1).write.mode("errorifexists").json(f"{folder}/manifests/n={number:08d}")


def _manifest(spark: SparkSession, folder: str) -> dict | None:
    """The last complete manifest."""
    try:
        found = spark.read.schema(_MANIFEST).json(f"{folder}/manifests/n=*")
        row = found.where("number is not null").orderBy(F.desc("number")).first()
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e):
            return None
        raise
    return row.asDict() if row else None


def _read(spark: SparkSession, manifest: dict) -> Tables:
    return {name: spark.read.schema(StructType.fromJson(json.loads(manifest["schemas"][name]))).parquet(path) for name, path in manifest["tables"].items()}


def current(spark: SparkSession, folder: str) -> tuple[int, Tables]:
    """(number, tables) of the last state; (0, {}) of an empty folder."""
    manifest = _manifest(spark, folder)
    return (manifest["number"], _read(spark, manifest)) if manifest else (0, {})


def publish(spark: SparkSession, folder: str, tables: Tables, after: int, keep: Sequence[str] = (), partition_by: dict[str, list[str]] | None = None) -> int:
    """Write the tables as the state that follows number ``after``, and its number; StalePlan if that isn't the last one.

    Tables of the last state named in ``keep`` belong to the new one too, by the files that they have.
    """
    last = _manifest(spark, folder)
    if (last["number"] if last else 0) != after:
        raise StalePlan(f"state {after} is not the last one")
    kept = {part: {name: last[part][name] for name in keep} for part in ("tables", "schemas")} if keep else None
    _write(spark, folder, after + 1, tables, {}, kept, partition_by)
    return after + 1


def purge(spark: SparkSession, folder: str) -> int:
    """Delete the data files that the last state doesn't name, once nobody reads an older one: how many tables went."""
    last = _manifest(spark, folder)
    if last is None:
        return 0
    named = {path.rsplit("/", 1)[1] for path in last["tables"].values()}
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/data")
    system = place.getFileSystem(spark._jsc.hadoopConfiguration())
    old = [x.getPath() for x in system.listStatus(place) if x.getPath().getName() not in named]
    for path in old:
        system.delete(path, True)
    return len(old)


def save_plan(spark: SparkSession, folder: str, plan: Tables, made_from: Tables) -> None:
    """Keep a plan in a folder of its own, with the fingerprints of the tables that it was made from."""
    _write(spark, folder, 1, plan, {name: fingerprint(df) for name, df in made_from.items()})


def apply_saved(spark: SparkSession, folder: str, plan_folder: str, apply: Callable[[Tables, Tables], Tables]) -> int:
    """Apply a kept plan to the last state: the number of the new one, whose tables are ``apply(tables, plan)``.

    StalePlan if a table that the plan was made from has changed since, or is missing; nothing is written then.
    A plan that was applied is stale unless it changed nothing.
    """
    manifest = _manifest(spark, plan_folder)
    if manifest is None:
        raise FileNotFoundError(plan_folder)
    number, tables = current(spark, folder)
    moved = [name for name, then in manifest["prints"].items() if name not in tables or fingerprint(tables[name]) != then]
    if moved:
        raise StalePlan(f"changed since the plan was made: {', '.join(sorted(moved))}")
    return publish(spark, folder, {**tables, **apply(tables, _read(spark, manifest))}, number)
