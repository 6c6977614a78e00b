"""A whole collection run over captured payloads: parse, merge into the masters, export what is open, report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..sources import payloads
from ..sources.folders import latest, written
from . import collection, master, merge

_ROOM_KEYS = ["business_id", "biz_item_id"]


def _into(folder: str, rows: DataFrame, keys: list[str], how: master.Merge, buckets: int) -> None:
    """Merge rows into a master table, which the first run creates."""
    spark = rows.sparkSession
    if latest(spark, folder) is None:
        master.create_master(how(rows.limit(0), rows), folder, keys, buckets)
    else:
        master.upsert_into(spark, folder, rows, how)


def parsed_rooms(rooms: DataFrame, said: DataFrame | None = None) -> DataFrame:
    """``rooms`` of payloads as rows of the master, each by its usable model answer (``said``:
    keys, answer, usable), else by the patterns; capacities that neither knows stay null."""
    by_patterns: Column = text.parse_room(F.col("name"), F.col("desc"))
    if said is not None:
        rooms = rooms.join(said.select(*_ROOM_KEYS, "answer", "usable"), _ROOM_KEYS, "left")
        parsed = F.when(F.col("usable"), F.col("answer")).otherwise(by_patterns)
    else:
        parsed = by_patterns
    return rooms.select(*_ROOM_KEYS, "name", parsed.alias("p"), "price_per_hour", "image_urls").select(
        *_ROOM_KEYS, "name", "p.max_capacity", "p.recommend_capacity", "p.base_capacity", "p.extra_charge", "price_per_hour",
        F.coalesce("p.requires_call", F.lit(False)).alias("requires_call"), "image_urls",
    )


def collect(found: DataFrame, captured: DataFrame, folder: str, as_of: str, said: DataFrame | None = None, buckets: int = 64) -> DataFrame:
    """Save what was ``captured`` (business_id, pos, business, rooms: payload texts) of the businesses
    ``found`` (query, business_id), and report (query, success, failed).

    Of repeated captures of a business the last by ``pos`` counts.  A business whose payload cannot be
    read has failed; one without rooms has succeeded, but leaves nothing.  Branches are overwritten,
    rooms merged by their rules; rooms without a capacity are added to the day's export.  The
    tables are ``branch``, ``room`` and ``unresolved`` under ``folder``; each master changes by one
    published version, so that a run that dies between them is made good by the next.
    """
    asked = found.select("business_id").distinct()
    last = merge.last_wins(captured, ["business_id"], ["pos"]).join(asked, "business_id", "left_semi")
    read = payloads.businesses(last, "business").withColumn("readable", F.lit(True))
    good = last.join(read.select("business_id", "readable"), "business_id", "left").filter("readable")
    listed = payloads.rooms(good.select("business_id", F.col("rooms").alias("payload")))
    rooms = written(merge.last_wins(listed.filter("biz_item_id is not null"), _ROOM_KEYS, ["pos"]))  # parsed once, read by three steps
    parsed = written(parsed_rooms(rooms, said))

    with_rooms = rooms.select("business_id").distinct()
    branches = read.select("business_id", "name", "lat", "lng").join(with_rooms, "business_id", "left_semi")
    _into(f"{folder}/branch", branches, ["business_id"], lambda old, new: merge.upsert(old, new, ["business_id"]), buckets)
    _into(f"{folder}/room", parsed, _ROOM_KEYS, merge.merge_rooms, buckets)
    collection.export_unresolved(parsed.select(*_ROOM_KEYS, "name", "max_capacity"), f"{folder}/unresolved", as_of)

    tried = found.select("query", "business_id").distinct().join(read.select("business_id", "readable"), "business_id", "left")
    return tried.groupBy("query").agg(F.count("readable").alias("success"), F.count_if(F.col("readable").isNull()).alias("failed"))
