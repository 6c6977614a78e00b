"""Folders that driver and executors share, and pointers to the valid state of a folder."""

from __future__ import annotations

import json
import re
import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own_folder: list[str] = []


def new_folder(spark: SparkSession) -> str:
    """A new name under ``spark.checkpoint.dir``; a local master may leave that setting unset."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        if not _own_folder:
            _own_folder.append(tempfile.mkdtemp(prefix="spark-"))
        base = _own_folder[0]
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def written(df: DataFrame, folder: str | None = None) -> DataFrame:
    """``df`` written to a new shared folder and read back, so that lineage ends here."""
    folder = folder or new_folder(df.sparkSession)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def latest(spark: SparkSession, folder: str) -> tuple[int, dict] | None:
    """The number and content of the last state published under ``folder``; None before the first."""
    try:
        found = spark.read.schema("number int, state string").json(f"{folder}/pointer").select("number", "state")
        rows = found.orderBy(F.desc("number")).limit(2).collect()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    if len(rows) == 2 and rows[0].number == rows[1].number:
        raise RuntimeError(f"two writers published state {rows[0].number} of {folder}")
    return (rows[0].number, json.loads(rows[0].state)) if rows else None


def publish(spark: SparkSession, folder: str, number: int, state: dict) -> None:
    """Make ``state`` the valid one, unless another writer has published that number.

    The state is one row in one file, seen whole or not at all; what it points to must
    be written before.
    """
    row = spark.createDataFrame([(json.dumps(state),)], "state string").coalesce(1)
    row.write.mode("errorifexists").json(f"{folder}/pointer/number={number}")
