"""Structured Streaming forms of the log and favorites jobs.

Watermarks and the late-row rule (rows more than two minutes late are dropped) are
our own choice.
"""

from __future__ import annotations

import json
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.masking import mask_text
from ..operators.collection import log_lines
from ..operators.merge import last_wins
from ..sources.folders import latest, publish

FAVORITE = ("device_id", "business_id", "biz_item_id")
_CHANGES = ", ".join(f"{c} string" for c in FAVORITE) + ", op string, seq long"


def rate_breaches(log: DataFrame, limit: int = 5, window: str = "1 minute", late: str = "2 minutes", record_id: str | None = None) -> DataFrame:
    """(ip, start, n) of the windows in which a client exceeds the limit; batch or stream.

    With ``record_id`` a record that is delivered again counts once: a stream keeps the ids of
    the time that rows may be late, as older ones are dropped anyway.
    """
    if log.isStreaming:
        log = log.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    if record_id:
        log = log.dropDuplicatesWithinWatermark([record_id]) if log.isStreaming else log.dropDuplicates([record_id])
    return log.groupBy(F.window("ts", window).alias("w"), "ip").agg(F.count("*").alias("n")).filter(F.col("n") > limit).select("ip", F.col("w.start").alias("start"), "n")


def counted(log: DataFrame, name: str = "records") -> DataFrame:
    """``log`` with an observed metric of each batch: its rows, those without a client, and its span of time."""
    return log.observe(name, F.count("*").alias("rows"), F.count_if(F.col("ip").isNull()).alias("without_ip"), F.min("ts").alias("first"), F.max("ts").alias("last"))


def late_rows(query: StreamingQuery) -> int:
    """Rows that a query's recent batches have dropped as too late."""
    return sum(o["numRowsDroppedByWatermark"] for p in query.recentProgress for o in json.loads(p.json if isinstance(p.json, str) else p.json())["stateOperators"])


def masked_log(log: DataFrame, column: str = "body") -> DataFrame:
    return log.withColumn(column, mask_text(F.col(column)))


def log_sink(log: DataFrame, folder: str, checkpoint: str, body: str, extras: str | None = None):
    """A writer of masked log lines into text files under a folder for each day.

    The sink's own log in ``folder`` holds which files belong to which batch, so that a batch that
    runs again after a crash adds nothing; read the folder with Spark, which follows it.
    """
    day = log.withColumn("day", F.date_format("ts", "yyyyMMdd"))
    lines = log_lines(day, body, extras, keep=("day",)).select("line", "day")
    return lines.writeStream.format("text").partitionBy("day").option("path", folder).option("checkpointLocation", checkpoint).outputMode("append")


def favorites_into(folder: str, every: int = 16):
    """A ``foreachBatch`` function: each batch adds what it says last of its keys to a
    folder of its own, and every ``every`` batches all changes become one snapshot.

    Batches lie under the number of the last snapshot, the query and the batch, so that a
    batch that runs again replaces its own changes or repeats them, which changes nothing:
    of a key's changes the one with the largest ``seq`` counts, and snapshots keep deletes.
    A query with a new checkpoint adds to the old ones.
    """

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        run = spark.sparkContext.getLocalProperty("sql.streaming.queryId") or "batch"
        epoch = _epoch(spark, folder)
        last_wins(batch.select(*FAVORITE, "op", "seq"), list(FAVORITE), ["seq"]).write.mode("overwrite").parquet(f"{folder}/changes/epoch={epoch}/run={run}/batch={number}")
        if (number + 1) % every == 0:
            compact_favorites(spark, folder)

    return step


def _epoch(spark: SparkSession, folder: str) -> int:
    found = latest(spark, folder)
    return found[0] + 1 if found else 0


def _read_changes(spark: SparkSession, path: str) -> DataFrame:
    try:
        return spark.read.schema(_CHANGES).option("recursiveFileLookup", "true").parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], _CHANGES)


def _changes(spark: SparkSession, folder: str) -> DataFrame:
    """The last snapshot with the changes since, and with those of the epoch before: a batch that was
    under way when the snapshot was taken lies there."""
    found = latest(spark, folder)
    epoch = found[0] + 1 if found else 0
    parts = [_read_changes(spark, f"{folder}/changes/epoch={e}") for e in (epoch - 1, epoch) if e >= 0]
    if found:
        parts.append(spark.read.schema(_CHANGES).parquet(f"{folder}/snapshots/{found[1]['snapshot']}"))
    rows = parts[0]
    for more in parts[1:]:
        rows = rows.unionByName(more)
    return last_wins(rows, list(FAVORITE), ["seq"])


def compact_favorites(spark: SparkSession, folder: str) -> int:
    """Write all changes so far as one snapshot and publish it; returns its number.

    A run that dies before the end leaves the last snapshot and its changes as they are.
    """
    name, number = uuid.uuid4().hex, _epoch(spark, folder)
    _changes(spark, folder).write.parquet(f"{folder}/snapshots/{name}")
    publish(spark, folder, number, {"snapshot": name})
    return number


def favorites_now(spark: SparkSession, folder: str) -> DataFrame:
    """The set that all batches together leave, the later of a key's changes winning; before
    the first batch it is empty.  One snapshot and the batches of two epochs are read,
    however many there were."""
    return _changes(spark, folder).filter("op = 'add'").select(*FAVORITE)
