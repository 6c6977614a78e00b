"""A master table in buckets and versions: an upsert writes only the buckets that it touches.

Rows lie in buckets by a hash of their key, each bucket in a folder of its own.  A version
names, for every bucket, the run that wrote it, and is published by one small file after
all data are written.  A run that dies before leaves the old version as it was; files
that no version names are never read.  Untouched buckets keep their files.

One writer at a time: of two that publish the same number the later fails.  The number
of buckets is fixed when a table is created; take it so that a bucket fits a few tasks.
Buckets go by the whole key, so that a business with very many rooms is spread as well.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.folders import latest, publish

Merge = Callable[[DataFrame, DataFrame], DataFrame]
BUCKET = "_bucket"


def bucket_of(keys: list[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def _write(rows: DataFrame, folder: str, state: dict) -> str:
    """Rows in a folder for each bucket under a new run's name; large buckets in several files."""
    run = uuid.uuid4().hex
    placed = rows.withColumn(BUCKET, bucket_of(state["keys"], state["buckets"]))
    placed.hint("rebalance", BUCKET).write.partitionBy(BUCKET).parquet(f"{folder}/data/{run}")
    return run


def _paths(folder: str, state: dict, buckets: list[int]) -> list[str]:
    return [f"{folder}/data/{run}/{BUCKET}={b}" for b in buckets if (run := state["runs"][b])]


def _read(spark: SparkSession, folder: str, state: dict, buckets: list[int]) -> DataFrame:
    paths = _paths(folder, state, buckets)
    return spark.read.schema(state["schema"]).parquet(*paths) if paths else spark.createDataFrame([], state["schema"])


def _filled(spark: SparkSession, folder: str, state: dict, run: str) -> set[int]:
    """The buckets that a run has written."""
    found = spark.read.schema(f"{state['schema']}, {BUCKET} int").parquet(f"{folder}/data/{run}")
    return {r[0] for r in found.select(BUCKET).distinct().collect()}


def create_master(table: DataFrame, folder: str, keys: list[str], buckets: int = 64) -> None:
    """A new master table of one row a key."""
    spark = table.sparkSession
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in table.schema)
    state = {"keys": keys, "buckets": buckets, "schema": schema}
    run = _write(table, folder, state)
    filled = _filled(spark, folder, state, run)
    publish(spark, folder, 0, state | {"runs": [run if b in filled else "" for b in range(buckets)]})


def read_version(spark: SparkSession, folder: str) -> DataFrame:
    """The last published version."""
    state = _state(spark, folder)[1]
    return _read(spark, folder, state, list(range(state["buckets"])))


def _state(spark: SparkSession, folder: str) -> tuple[int, dict]:
    found = latest(spark, folder)
    if not found:
        raise ValueError(f"no master table in {folder}")
    return found


def _rewrite(spark: SparkSession, folder: str, changes: DataFrame, merge: Merge) -> int:
    number, state = _state(spark, folder)
    touched = {r[0] for r in changes.select(bucket_of(state["keys"], state["buckets"])).distinct().collect()}
    if not touched:
        return number
    run = _write(merge(_read(spark, folder, state, sorted(touched)), changes), folder, state)
    filled = _filled(spark, folder, state, run)
    runs = [(run if b in filled else "") if b in touched else old for b, old in enumerate(state["runs"])]
    publish(spark, folder, number + 1, state | {"runs": runs})
    return number + 1


def upsert_into(spark: SparkSession, folder: str, incoming: DataFrame, merge: Merge) -> int:
    """Merge ``incoming``, one row a key, by ``merge(existing, incoming)``, such as
    ``merge_rooms``; returns the new version's number, or the old one's if nothing came.

    Only the touched buckets are read, joined and written.  ``incoming`` is read twice: write
    it first where it is dear to work out.
    """
    return _rewrite(spark, folder, incoming, merge)


def delete_from(spark: SparkSession, folder: str, gone: DataFrame) -> int:
    """Remove the rows with the keys of ``gone``, whose columns are all of the table's keys."""
    def without(existing: DataFrame, keys: DataFrame) -> DataFrame:
        e, g = existing.alias("e"), keys.alias("g")
        return e.join(g, [F.col(f"e.{k}").eqNullSafe(F.col(f"g.{k}")) for k in keys.columns], "left_anti")

    keys = _state(spark, folder)[1]["keys"]
    return _rewrite(spark, folder, gone.select(*keys), without)
