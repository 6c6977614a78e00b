"""Queries of what is kept and run on: master versions, streams, isolated extractors, ranks, one-pass metrics."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..functions import text
from ..operators import availability as av
from ..operators import collection as co
from ..operators import extractors, master, merge, metrics, ranking, run
from ..sources.domain import domain, read_master, with_clause
from ..sources.folders import new_folder, written
from ..streaming import jobs
from .queries import _MERGED, _NUM, _PARSED, ORACLE_SQL, query

_KEYS = ["business_id", "biz_item_id"]
#: Rows of a stream's file, above which a batch has several.
_FILE_ROWS = 250_000


@query("mrg5_master_upserts", ORACLE_SQL["mrg2_merge_rooms"])
def mrg5(spark, d):
    """Rooms merged into a master table in three upserts, each of which rewrites only its buckets."""
    folder, news = new_folder(spark), domain(spark, d, "incoming_room")
    master.create_master(domain(spark, d, "room"), folder, _KEYS, buckets=16)
    third = F.pmod(F.crc32("business_id"), F.lit(3))
    for k in range(3):
        master.upsert_into(spark, folder, news.filter(third == k), merge.merge_rooms)
    return master.read_version(spark, folder).withColumn("image_urls", F.array_join("image_urls", ","))


@query(
    "mrg6_master_deletes",
    f"""{with_clause('branch')}, n AS (SELECT business_id, concat(name, '!') AS name, lat + 1 AS lat, CAST(NULL AS double) AS lng FROM branch
      WHERE lat > 37.5e0)
    SELECT b.business_id, coalesce(n.name, b.name) AS name, CASE WHEN n.business_id IS NULL THEN b.lat ELSE n.lat END AS lat, CASE
      WHEN n.business_id IS NULL THEN b.lng ELSE n.lng END AS lng
    FROM branch b LEFT JOIN n USING (business_id) WHERE b.lat IS NOT NULL""",
)
def mrg6(spark, d):
    """Branches overwritten by news, coordinates that these lack included, then those without any deleted."""
    folder, b = new_folder(spark), domain(spark, d, "branch")
    master.create_master(b, folder, ["business_id"], buckets=8)
    news = b.filter("lat > 37.5e0").select("business_id", F.concat("name", F.lit("!")).alias("name"), (F.col("lat") + 1).alias("lat"), F.lit(None).cast("double").alias("lng"))
    master.upsert_into(spark, folder, news, lambda old, new: merge.upsert(old, new, ["business_id"]))
    master.delete_from(spark, folder, b.filter("lat is null"))
    return master.read_version(spark, folder)


def _stream(spark, df: DataFrame, files: int, order: str) -> DataFrame:
    """``df`` as a stream of that many batches, each of one file or, where there are many rows, of as many as
    are needed for some ``_FILE_ROWS`` in each."""
    folder, shares = new_folder(spark), -(-df.count() // (files * _FILE_ROWS))
    shares = max(shares, 1)
    for part in range(files):
        own = df.filter(F.pmod(F.xxhash64(order), F.lit(files)) == part)
        (own.repartition(shares) if shares > 1 else own.coalesce(1)).write.mode("append").parquet(folder)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", shares).parquet(folder)


@query("ss3_favorites_stream", ORACLE_SQL["mrg4_favorites"])
def ss3(spark, d):
    """The set that a stream of five batches of changes leaves, with a snapshot every two."""
    folder, stream = new_folder(spark), _stream(spark, domain(spark, d, "favorite_change"), 5, "seq")
    writer = stream.writeStream.foreachBatch(jobs.favorites_into(folder, every=2)).option("checkpointLocation", new_folder(spark))
    writer.trigger(availableNow=True).start().awaitTermination()
    return jobs.favorites_now(spark, folder)


@query(
    "ss1_redelivered_breaches",
    f"""{with_clause('request_log')} SELECT right(ip, 1) AS ip, date_trunc('minute', ts) AS start, count(*) AS n FROM request_log GROUP BY 1,
      2 HAVING count(*) > 1""",
)
def ss1(spark, d):
    """Breaches found by a stream in which a third of the records come twice; a last record a day
    later closes all windows."""
    log = domain(spark, d, "request_log").select(F.right("ip", F.lit(1)).alias("ip"), "ts", "pos")
    again = log.unionByName(log.filter("pos % 3 = 0"))
    end = log.agg(F.lit(None).cast("string").alias("ip"), (F.max("ts") + F.expr("interval 1 day")).alias("ts"), F.lit(-1).cast("long").alias("pos"))
    source, out = new_folder(spark), new_folder(spark)
    rows = written(again.unionByName(end), source)
    breaches = jobs.rate_breaches(jobs.counted(spark.readStream.schema(rows.schema).parquet(source)), 1, record_id="pos")
    writer = breaches.writeStream.outputMode("append").option("path", out).option("checkpointLocation", new_folder(spark))
    writer.trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(breaches.schema).parquet(out).withColumn("start", F.col("start").cast("timestamp_ntz"))


@query(
    "snk6_log_stream",
    """SELECT cast(strftime(ts, '%Y%m%d') AS int) AS day,
      concat('{"timestamp":"', strftime(ts, '%Y-%m-%dT%H:%M:%S'), '","level":"', event_type, '","logger":"app.search","trace_id":"t', event_id % 50, '"',
    ',"message":"user ', user_id, ' token=***"', CASE WHEN event_id % 4 = 0 THEN ',"phone": "***", "pos": ' || event_id ELSE '' END, '}') AS line
      FROM events""",
)
def snk6(spark, d):
    """The lines of the daily files that a stream of three batches has written."""
    extras = F.when(F.col("pos") % 4 == 0, F.to_json(F.struct(F.lit("010").alias("phone"), "pos")))
    log = domain(spark, d, "request_log").withColumn("body", F.concat(F.lit("user "), "ip", F.lit(" token=t"), "ip")).withColumn("extras", extras)
    out = new_folder(spark)
    jobs.log_sink(_stream(spark, log, 3, "pos"), out, new_folder(spark), "body", "extras").trigger(availableNow=True).start().awaitTermination()
    return spark.read.text(out).select(F.col("day").cast("int").alias("day"), F.col("value").alias("line"))


def _read_hours(body: str | None) -> list[tuple[str, bool]]:
    """The hours of one day's payload; a payload without stock is a failure that the platform names."""
    found = json.loads(body)
    if found.get("closed"):
        raise co.ExtractionError("Naver-002", "closed")
    return [(e["at"], e["booked"] < e["stock"]) for e in found["hourly"]]


@query(
    "ud2_isolated_rooms",
    f"""{with_clause('slot')}, p AS (SELECT business_id, biz_item_id, day, day % 5 AS form, list(struct_pack(hour := hour,
      free := unit_booking_count < unit_stock, pos := pos)) AS hours FROM slot GROUP BY 1, 2, 3),
    o AS (SELECT business_id, biz_item_id, day, unnest(hours) AS h FROM p WHERE form > 2)
    SELECT business_id, biz_item_id, day, lpad(cast(h.hour AS varchar), 2, '0') AS hour, CASE WHEN h.free THEN 'free' ELSE 'taken' END AS status,
      CAST(NULL AS varchar) AS error_code, count(*) AS n FROM o GROUP BY ALL
    UNION ALL SELECT business_id, biz_item_id, day, NULL, NULL, CASE form WHEN 0 THEN 'COMMON-001' WHEN 1 THEN 'Naver-002' ELSE 'COMMON-001' END, 1
      FROM p WHERE form <= 2""",
)
def ud2(spark, d):
    """One payload a room and day; a fifth of them is cut off, a fifth says that the room is closed,
    and a fifth lacks its hours.  Those rooms have an error, all others their hours."""
    entry = F.struct(F.lpad(F.col("hour").cast("string"), 2, "0").alias("at"), F.col("unit_stock").alias("stock"), F.col("unit_booking_count").alias("booked"))
    days = domain(spark, d, "slot").groupBy("business_id", "biz_item_id", "day").agg(F.to_json(F.struct(F.collect_list(entry).alias("hourly"))).alias("body"))
    form = F.col("day") % 5
    payload = F.when(form == 0, F.expr("left(body, length(body) - 3)")).when(form == 1, '{"closed": true}').when(form == 2, "{}").otherwise(F.col("body"))
    read = co.isolated(_read_hours)(days.select("business_id", "biz_item_id", "day", payload.alias("payload")))
    return read.groupBy("business_id", "biz_item_id", "day", "hour", "status", "error_code").agg(F.count("*").alias("n"))


@query("wn7_ranges", f"{with_clause('slot')} SELECT pos, row_number() OVER (PARTITION BY day % 2 ORDER BY pos) AS place FROM slot")
def wn7(spark, d):
    """All slots numbered under two keys only, by ranges: no task holds a key."""
    slots = domain(spark, d, "slot").select("pos", (F.col("day") % 2).alias("key"))
    return ranking.numbered_by_ranges(slots, ["key"], ["pos"], "place").select("pos", "place")


@query(
    "ag15_merge_metrics",
    f"""{with_clause('room', 'incoming_room')}, {_MERGED} SELECT count(*) AS rooms, count(*) FILTER (WHERE price_per_hour < 0) AS bad_price,
    count(*) FILTER (WHERE max_capacity < 1) AS bad_max, count(*) FILTER (WHERE max_capacity < recommend_capacity) AS bad_max_recommend,
      count(*) FILTER (WHERE max_capacity <> 100) AS known_capacity,
    round(100.0e0 * count(*) FILTER (WHERE max_capacity <> 100) / count(*), 1) AS known_percent, min(max_capacity) AS least,
      max(max_capacity) AS most, min(price_per_hour) AS cheapest, max(price_per_hour) AS dearest,
    count(*) FILTER (WHERE max_capacity NOT BETWEEN 2 AND 15) AS outside FROM merged""",
)
def ag15(spark, d):
    """Rule breaches, counts, shares and ranges of merged rooms, observed while they are written."""
    seen = Observation("merge")
    merged = merge.merge_rooms(domain(spark, d, "room"), domain(spark, d, "incoming_room"))
    metrics.observed(merged, seen).write.parquet(new_folder(spark))
    return metrics.observed_row(merged, seen)


@query(
    "src7_master_rooms",
    f"""{with_clause('branch', 'room')}, r AS (SELECT r.*, b.lat, b.lng FROM room r JOIN branch b USING (business_id))
    SELECT business_id, biz_item_id, max_capacity, cast(price_per_hour AS double) AS price_per_hour FROM r WHERE lat BETWEEN 37.4e0 AND 37.6e0
      AND lng BETWEEN 126.8e0 AND 127.0e0 AND max_capacity >= 6""",
)
def src7(spark, d):
    """Master tables written as Parquet and read within a box and from a capacity on."""
    folder = new_folder(spark)
    for name in ("branch", "room"):
        domain(spark, d, name).write.parquet(f"{folder}/{name}")
    branches = read_master(spark, "branch", folder, box=(37.4, 126.8, 37.6, 127.0))
    rooms = read_master(spark, "room", folder, capacity=6)
    return rooms.join(branches.select("business_id"), "business_id").select("business_id", "biz_item_id", "max_capacity", F.col("price_per_hour").cast("double").alias("price_per_hour"))


@query(
    "snk3_unresolved_export",
    f"""{with_clause('incoming_room')}, u AS (SELECT * FROM incoming_room WHERE max_capacity IS NULL)
    SELECT business_id, biz_item_id, 'no_capacity_info' AS failure_reason, '20240615' AS day FROM u UNION ALL SELECT business_id, biz_item_id,
      'no_capacity_info', '20240616' FROM u WHERE recommend_capacity IS NULL""",
)
def snk3(spark, d):
    """The files after two runs on one day and one, of fewer rooms, on the next."""
    folder, rooms = new_folder(spark), domain(spark, d, "incoming_room")
    for day, part in (("2024-06-15", rooms.filter("price_per_hour is null")), ("2024-06-15", rooms), ("2024-06-16", rooms.filter("recommend_capacity is null"))):
        co.export_unresolved(part, folder, day)
    kinds = "business_id string, biz_item_id string, failure_reason string, export_date string"
    return spark.read.schema(kinds).json(folder).select("business_id", "biz_item_id", "failure_reason", F.col("export_date").alias("day"))


def _captured(spark, d, bare: bool) -> DataFrame:
    """Payloads of the room texts' businesses; a tenth cannot be read, a tenth have no rooms.  ``bare``
    ones lack descriptions and prices, and come twice, the first time with another name."""
    some = lambda c: F.when(F.lit(not bare), c)
    item = F.struct(
        F.col("room_id").cast("string").alias("bizItemId"), "name", some(F.col("desc_text")).alias("desc"), some(F.struct(F.col("min_price").alias("minPrice"))).alias("minMaxPrice"),
        F.transform(F.sequence(F.lit(1), F.coalesce("image_count", F.lit(0))), lambda i: F.struct(i.cast("string").alias("resourceUrl"))).alias("images"),
    )
    item = item.withField("bizItemResources", F.when(F.coalesce("image_count", F.lit(0)) > 0, item["images"])).dropFields("images")
    kind = F.col("business_id").cast("int") % 10
    rooms = domain(spark, d, "room_text").groupBy("business_id").agg(F.collect_list(item).alias("bizItems"))
    body = F.to_json(F.struct(F.struct(F.when(kind != 7, F.col("bizItems")).alias("bizItems")).alias("data")))
    about = lambda name: F.to_json(F.struct(F.struct(F.struct(F.col("business_id").alias("businessId"), name.alias("businessDisplayName")).alias("business")).alias("data")))
    whole = F.when(kind == 3, "cut off {").otherwise(about(F.concat(F.lit("B"), "business_id")))
    out = rooms.select("business_id", F.lit(2).alias("pos"), whole.alias("business"), body.alias("rooms"))
    return out.unionByName(rooms.select("business_id", F.lit(1).alias("pos"), about(F.lit("old")).alias("business"), F.lit("{}").alias("rooms"))) if bare else out


#: What the first run knew from a room's name stays where the second knows nothing or one.
_KEEP = lambda c: f"CASE WHEN (coalesce({c}, 100) <= 1 OR coalesce({c}, 100) = 100) AND old_{c} > 1 AND old_{c} <> 100 THEN old_{c} ELSE coalesce({c}, 100) END"


@query(
    "col1_collection_run",
    f"""{_PARSED}, named AS (SELECT *, coalesce(y.m, 100) AS old_m, coalesce(y.r, CASE WHEN y.m > 4 THEN y.m // 2 ELSE y.m END, 100) AS old_r FROM parsed)
    SELECT business_id, cast(room_id AS varchar) AS biz_item_id, name, cast({_KEEP('m')} AS int) AS max_capacity,
      cast({_KEEP('r')} AS int) AS recommend_capacity, {_NUM('de', text.BASE)} AS base_capacity,
    {_NUM('de', text.EXTRA.removeprefix('(?d)'))} AS extra_charge, min_price AS price_per_hour, contains(de, '당일') AND (contains(de,
      '전화') OR contains(de, '문의')) AS requires_call,
    cast(coalesce(image_count, 0) AS int) AS images, m IS NULL AS exported, concat('B', business_id) AS branch FROM named
      WHERE cast(business_id AS int) % 10 NOT IN (3, 7)""",
)
def col1(spark, d):
    """Two runs over all businesses: the first without descriptions, the second with them; the rooms
    that the master holds then, with their branch and whether the second day's export lists them."""
    folder, found = new_folder(spark), domain(spark, d, "room_text").select(F.lit("all").alias("query"), "business_id")
    for day, bare in (("2024-06-15", True), ("2024-06-16", False)):
        run.collect(found, _captured(spark, d, bare), folder, day, buckets=8)
    kinds = "biz_item_id string, export_date string"
    listed = spark.read.schema(kinds).json(f"{folder}/unresolved").filter("export_date = '20240616'").select("biz_item_id", F.lit(True).alias("exported"))
    branches = master.read_version(spark, f"{folder}/branch").select("business_id", F.col("name").alias("branch"))
    rooms = master.read_version(spark, f"{folder}/room").join(branches, "business_id").join(listed, "biz_item_id", "left")
    return rooms.select(
        "business_id", "biz_item_id", "name", "max_capacity", "recommend_capacity", "base_capacity", "extra_charge", "price_per_hour", "requires_call",
        F.size("image_urls").alias("images"), F.coalesce("exported", F.lit(False)).alias("exported"), "branch",
    )


@query(
    "ud1_platform_slots",
    f"""{with_clause('slot')}, g AS (SELECT business_id, biz_item_id, day, list(struct_pack(pos := pos, hour := hour, free := unit_booking_count < unit_stock) ORDER BY pos) AS e FROM slot GROUP BY 1, 2, 3),
    k AS (SELECT *, CASE business_id WHEN 'sadang' THEN 'groove' WHEN 'dream_sadang' THEN 'dream' WHEN 'hongdae_dream' THEN 'dream' ELSE 'naver' END AS platform, day * 12 + len(e) AS form FROM g),
    f AS (SELECT *, platform <> 'naver' AND date_diff('day', DATE '1996-10-01', make_date(day, 1, 1)) >= CASE platform WHEN 'dream' THEN 121 ELSE 84 END AS far FROM k),
    x AS (SELECT *, CASE WHEN form % 4 = 0 AND NOT far THEN CASE platform WHEN 'groove' THEN 'CRAWLER-003' ELSE 'CRAWLER-002' END END AS error_code FROM f),
    h AS (SELECT *, unnest(CASE WHEN error_code IS NULL THEN [10, 12, 15, 20, 22] ELSE [NULL] END) AS h FROM x),
    l AS (SELECT *, list_filter(e, lambda s: s.hour = h) AS own FROM h)
    SELECT business_id, biz_item_id, day, concat(h, ':00') AS hour, CASE WHEN error_code IS NOT NULL THEN NULL WHEN far THEN 'unknown' WHEN coalesce(CASE platform WHEN 'naver' THEN own[-1].free WHEN 'dream' THEN own[1].free
      ELSE len(list_filter(own, lambda s: s.free)) > 0 END, false) THEN 'free' ELSE 'taken' END AS status, error_code FROM l""".replace("concat(h, ':00')", "CASE WHEN h IS NOT NULL THEN concat(h, ':00') END"),
)
def ud1(spark, d):
    """Five hours of every room and day, read by its platform's extractor: schedules, label pages and cell pages
    made of the slots, a quarter of them unreadable, some days beyond a platform's horizon."""
    e = F.sort_array(F.collect_list(F.struct("pos", "hour", "unit_stock", "unit_booking_count")))
    days = domain(spark, d, "slot").groupBy("business_id", "biz_item_id", "day").agg(e.alias("e"))
    broken = (F.col("day") * 12 + F.size("e")) % 4 == 0
    text_of = lambda make: F.array_join(F.transform("e", make), "")
    free = lambda x: x["unit_booking_count"] < x["unit_stock"]
    entry = lambda x: F.struct(F.format_string("2024-01-01T%02d:00:00", x["hour"]).alias("unitStartTime"), x["unit_stock"].alias("unitStock"), x["unit_booking_count"].alias("unitBookingCount"))
    hourly = F.to_json(F.struct(F.struct(F.struct(F.struct(F.transform("e", entry).alias("hourly")).alias("bizItemSchedule")).alias("schedule")).alias("data")))
    label = lambda x: F.concat(F.lit('<label title="'), x["hour"].cast("string"), F.lit('시00분" class="time'), F.when(free(x), " active").otherwise(""), F.lit('">'))
    cell = lambda x: F.concat(F.lit("<i id=reserve_time_"), "biz_item_id", F.lit("_"), x["hour"].cast("string"), F.lit(" class='"), F.when(free(x), "reserve_time_off").otherwise("x"), F.lit("'>"))
    platform = av.platform(F.col("business_id"))
    payload = (
        F.when(platform == "naver", F.when(broken, '{"data": ').otherwise(hourly))
        .when(platform == "dream", F.when(broken, "<html>").otherwise(F.to_json(F.struct(text_of(label).alias("items")))))
        .otherwise(F.when(~broken, text_of(cell)))
    )
    slots = F.array(*(F.lit(f"{h}:00") for h in (10, 12, 15, 20, 22)))
    rooms = days.select("business_id", "biz_item_id", F.make_date("day", F.lit(1), F.lit(1)).alias("day"), slots.alias("hour_slots"), payload.alias("payload"))
    out = co.platform_results(rooms, extractors.registry("1996-10-01"))
    return out.select("business_id", "biz_item_id", F.year("day").alias("day"), "hour", "status", "error_code")
