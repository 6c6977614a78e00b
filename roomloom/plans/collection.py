"""Queries of the collection run and of the checks around it, each with its SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from ..functions import checks, text
from ..operators import availability as av
from ..operators import collection as co
from ..operators import merge, references
from ..sources import payloads
from ..sources.domain import CITIES, DISTRICTS, SOUGHT, domain, search_queries, with_clause
from .queries import _PARSED, _parsed, mrg4, query

_WN4 = "b AS (SELECT *, cast(floor((row_number() OVER (PARTITION BY business_id ORDER BY room_id) - 1) / 5) AS BIGINT) AS batch FROM room_text)"


def _batched(spark, d):
    return co.batched(domain(spark, d, "room_text"), "business_id", "room_id")


@query(
    "tx14_batch_prompts",
    f"""{with_clause('room_text')}, {_WN4}
    SELECT business_id, batch, string_agg(concat('ID: ', room_id, chr(10), 'Name: ', name, chr(10), 'Desc: ', coalesce(desc_text, ''), chr(10),
      '---'), chr(10) ORDER BY room_id) AS rooms_text
    FROM b GROUP BY 1, 2""",
)
def tx14(spark, d):
    return co.batch_prompts(_batched(spark, d), "business_id", "room_id")


_SQUEEZED = lambda c: f"trim(regexp_replace(regexp_replace(regexp_replace({c}, '<[^>]+>', '', 'g'), '[^\\p{{L}}\\p{{N}}_{text.BLANKS}가-힣~\\-,]', ' ', 'g'), '{text.S}+', ' ', 'g'))"


@query("tx1_prompt_texts", f"{with_clause('room_text')} SELECT room_id, {_SQUEEZED('name')} AS name, coalesce(nullif({_SQUEEZED('''coalesce(desc_text, '')''')}, ''), '내용 없음') AS \"desc\" FROM room_text")
def tx1(spark, d):
    return domain(spark, d, "room_text").select("room_id", co.prompt_parts(F.col("name"), F.col("desc_text")).alias("p")).select("room_id", "p.*")


_TRIM = lambda c: f"regexp_replace({c}, '^{text.S}+|{text.S}+$', '', 'g')"
_WITHOUT_DAY = f"""CASE WHEN contains(name, '[평일]') OR contains(name, '(평일)') THEN {_TRIM("regexp_replace(name, '\\[평일\\]|\\(평일\\)', '', 'g')")}
  WHEN contains(name, '[주말]') OR contains(name, '(주말)') OR contains(name,
      '주말/공휴일') THEN {_TRIM("regexp_replace(name, '\\[주말[^\\]]*\\]|\\(주말[^)]*\\)', '', 'g')")} ELSE name END"""
_CLEAN = reduce(lambda c, p: _TRIM(f"regexp_replace({c}, '{p}', '', 'g')"), text.NAME_PARTS, _WITHOUT_DAY)


@query("tx4_clean_names", f"{with_clause('room_text')} SELECT room_id, {_CLEAN} AS clean_name FROM room_text")
def tx4(spark, d):
    return domain(spark, d, "room_text").select("room_id", text.clean_name(F.col("name")).alias("clean_name"))


@query(
    "tx13_batch_answers",
    f"""{_PARSED}, {_WN4},
    r AS (SELECT business_id, batch, CASE WHEN cast(business_id AS int) % 10 = 0 THEN 'no object'
      ELSE concat('{{', string_agg(CASE WHEN room_id % 3 <> 0 THEN concat('"', room_id, '":{{"max_capacity":', 1 + room_id % 60, '}}') END, ','), '}}') END AS response FROM b GROUP BY 1, 2),
    s AS (SELECT b.room_id, try_cast(regexp_extract(response, concat('"', b.room_id, '":\\{{"max_capacity":([0-9]+)\\}}'), 1) AS int) AS said FROM b JOIN r USING (business_id, batch))
    SELECT room_id, cast(CASE WHEN said BETWEEN 1 AND 50 THEN said ELSE m END AS int) AS max_capacity FROM parsed JOIN s USING (room_id)""",
)
def tx13(spark, d):
    """Answers of a third of the rooms are missing, some out of range, some batches no JSON."""
    items = _batched(spark, d)
    one = F.struct(F.col("room_id").cast("string"), F.struct(F.col("name").alias("clean_name"), (1 + F.col("room_id") % 60).alias("max_capacity")))
    body = F.concat(F.lit("```json\n"), F.to_json(F.map_from_entries(F.collect_list(F.when(F.col("room_id") % 3 != 0, one)))), F.lit("\n```"))
    said = items.groupBy("business_id", "batch").agg(F.when(F.col("business_id").cast("int") % 10 == 0, "no object").otherwise(body).alias("response"))
    found = co.answers(said, ["business_id", "batch"])
    return co.parsed_batches(items, found, ["business_id", "batch"], "room_id").select("room_id", F.col("parsed.max_capacity").alias("max_capacity"))


@query("st2_platform_results", f"""{with_clause('slot')} SELECT pos, CASE WHEN business_id = 'sadang' THEN NULL WHEN business_id IN ('dream_sadang',
      'hongdae_dream') AND day >= 1996 THEN 'unknown'
 WHEN unit_booking_count < unit_stock THEN 'free' ELSE 'taken' END AS status, CASE WHEN business_id = 'sadang' THEN 'COMMON-001' END AS error_code FROM slot""")
def st2(spark, d):
    status = F.when(F.col("unit_booking_count") < F.col("unit_stock"), "free").otherwise("taken")
    far = av.beyond_horizon(F.col("business_id"), F.make_date("day", F.lit(1), F.lit(1)), "1995-01-01")
    extractors = {"naver": lambda df: df.withColumn("status", status), "dream": lambda df: df.withColumn("status", F.when(far, "unknown").otherwise(status))}
    return co.platform_results(domain(spark, d, "slot"), extractors).select("pos", "status", "error_code")


@query(
    "jn8_new_unresolved",
    f"""{with_clause('room', 'incoming_room')}
    SELECT business_id, biz_item_id, 'no_capacity_info' AS failure_reason, '20240615' AS export_date FROM incoming_room
    WHERE max_capacity IS NULL AND biz_item_id NOT IN (SELECT biz_item_id FROM room WHERE max_capacity > 10)""",
)
def jn8(spark, d):
    exported = domain(spark, d, "room").filter("max_capacity > 10")
    return co.new_unresolved(domain(spark, d, "incoming_room"), exported, "2024-06-15").select("business_id", "biz_item_id", "failure_reason", "export_date")


@query("src2_businesses", f"{with_clause('branch')} SELECT business_id, name, lat, lng, concat('pl', business_id) AS place_id FROM branch")
def src2(spark, d):
    """Branches read back from business payloads; one without coordinates has none there."""
    at = F.when(F.col("lat").isNotNull(), F.array("lng", "lat"))
    b = F.struct(F.col("business_id").alias("businessId"), F.col("name").alias("businessDisplayName"), at.alias("coordinates"), F.concat(F.lit("pl"), "business_id").alias("placeId"))
    return payloads.businesses(domain(spark, d, "branch").select(F.to_json(F.struct(F.struct(b.alias("business")).alias("data"))).alias("payload")))


@query(
    "src3_rooms",
    f"""{with_clause('room')}
    SELECT business_id, biz_item_id, CASE WHEN max_capacity > 3 THEN price_per_hour END AS price_per_hour, CASE WHEN max_capacity > 3 THEN 1
      ELSE 0 END AS images
    FROM room""",
)
def src3(spark, d):
    """Rooms read back from one payload a business; some have neither price nor images."""
    some = lambda c: F.when(F.col("max_capacity") > 3, c)
    item = F.struct(F.col("biz_item_id").alias("bizItemId"), some(F.struct(F.col("price_per_hour").alias("minPrice"))).alias("minMaxPrice"), some(F.array(F.struct(F.lit("u").alias("resourceUrl")))).alias("bizItemResources"))
    body = F.to_json(F.struct(F.struct(F.collect_list(item).alias("bizItems")).alias("data")))
    read = payloads.rooms(domain(spark, d, "room").groupBy("business_id").agg(body.alias("payload")))
    return read.select("business_id", "biz_item_id", "price_per_hour", F.size("image_urls").alias("images"))


@query(
    "html2_cells",
    """WITH p AS (SELECT l_orderkey, string_agg(concat('<div id="reserve_time_', l_partkey, '_', 9 + l_linenumber, '" class="cell', CASE
      WHEN l_quantity > 25 THEN ' reserve_time_off' ELSE '' END, '">x</div>'), '' ORDER BY l_linenumber, l_partkey, l_quantity) AS html FROM lineitem
      GROUP BY 1)
    SELECT l_orderkey, l_partkey, h AS hour, regexp_matches(html, concat('<div id="reserve_time_', l_partkey, '_', h,
      '" class="[^">]*reserve_time_off')) AS is_free
    FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) JOIN p USING (l_orderkey), (SELECT unnest([10, 11, 12, 20]) AS h)""",
)
def html2(spark, d):
    """The page of an order, parsed once, has a cell for each line; each of its items is asked for at four hours."""
    line = spark.read.parquet(f"{d}/lineitem.parquet")
    off = F.when(F.col("l_quantity") > 25, " reserve_time_off").otherwise("")
    cell = F.concat(F.lit('<div id="reserve_time_'), "l_partkey", F.lit("_"), 9 + F.col("l_linenumber"), F.lit('" class="cell'), off, F.lit('">x</div>'))
    page = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_quantity", cell.alias("c")))), lambda x: x["c"]), "")
    pages = line.groupBy("l_orderkey").agg(page.alias("html"), F.collect_set("l_partkey").alias("items"))
    parsed = pages.select("l_orderkey", payloads.open_cells(F.col("html")).alias("cells"), "items")
    asked = parsed.select("l_orderkey", "cells", F.explode("items").alias("l_partkey")).withColumn("hour", F.explode(F.array(*map(F.lit, (10, 11, 12, 20)))))
    return asked.select("l_orderkey", "l_partkey", "hour", payloads.cell_open(F.col("cells"), F.col("l_partkey").cast("string"), F.col("hour")).alias("is_free"))


@query(
    "flt8_hour_errors",
    f"""{with_clause('raw_request')}
    SELECT request_id, CASE WHEN length(start_hour) < 5 THEN 'Hour-001' WHEN date = '1998-06-15' AND start_hour <= '14:00' THEN 'Hour-002' END AS error
    FROM raw_request""",
)
def flt8(spark, d):
    return domain(spark, d, "raw_request").select("request_id", checks.hour_error(F.col("start_hour"), F.col("date"), "1998-06-15 14:00").alias("error"))


@query(
    "flt9_room_errors",
    f"""{with_clause('room_text')}
    SELECT room_id, CASE WHEN coalesce(desc_text, '') = '' OR coalesce(name, '') = '' THEN 'Room-001' END AS error FROM room_text""",
)
def flt9(spark, d):
    return domain(spark, d, "room_text").select("room_id", checks.room_error(F.col("name"), F.col("desc_text"), F.col("business_id")).alias("error"))


@query(
    "flt12_valid_results",
    f"""{_PARSED} SELECT room_id, coalesce(m BETWEEN 1 AND 50, true) AND coalesce(r BETWEEN 1 AND 50, true) AS valid FROM parsed""",
)
def flt12(spark, d):
    return _parsed(spark, d).select("room_id", text.valid_result(F.col("p")).alias("valid"))


@query(
    "flt15_suspicious",
    f"""{with_clause('room')} SELECT business_id, biz_item_id FROM room
    WHERE (max_capacity = 1 AND price_per_hour > 15000) OR (max_capacity >= 15 AND price_per_hour < 10000)""",
)
def flt15(spark, d):
    return domain(spark, d, "room").filter(checks.suspicious(F.col("max_capacity"), F.col("price_per_hour"), large=15)).select("business_id", "biz_item_id")


@query(
    "flt16_needs_model",
    f"""{with_clause('room_text')} SELECT room_id, NOT regexp_matches(coalesce(desc_text, ''), '{text.CLEAR_CAPACITY}') AS needs
    FROM room_text""",
)
def flt16(spark, d):
    return domain(spark, d, "room_text").select("room_id", text.needs_model(F.col("desc_text")).alias("needs"))


@query(
    "flt17_device_errors",
    f"""{with_clause('client')} SELECT event_id, CASE WHEN trim(coalesce(device, '')) = '' THEN 'required'
    WHEN NOT regexp_matches(regexp_replace(regexp_replace(trim(device), '^(?i:urn:uuid:)', ''), '[{{}}-]', '', 'g'),
      '^[0-9a-fA-F]{{32}}$') THEN 'invalid format' END AS error FROM client""",
)
def flt17(spark, d):
    return domain(spark, d, "client").select("event_id", checks.device_error(F.col("device")).alias("error"))


@query(
    "flt18_trace_ids",
    f"""{with_clause('client')} SELECT event_id, CASE WHEN regexp_matches(lower(trace),
      '^[0-9a-f]{{8}}(-[0-9a-f]{{4}}){{3}}-[0-9a-f]{{12}}$') THEN trace END AS kept, 36 AS length FROM client""",
)
def flt18(spark, d):
    """Given ids that are kept; a new one takes the place of any other."""
    found = checks.trace_id(F.col("trace"))
    return domain(spark, d, "client").select("event_id", F.when(found == F.col("trace"), F.col("trace")).alias("kept"), F.length(found).alias("length"))


@query(
    "flt19_client_ips",
    f"""{with_clause('client')} SELECT event_id, coalesce(nullif(trim(cloud), ''), nullif(trim(split_part(forwarded, ',', 1)), ''),
      nullif(trim(real_ip), ''), nullif(trim(host), ''), 'unknown') AS ip FROM client""",
)
def flt19(spark, d):
    return domain(spark, d, "client").select("event_id", checks.client_ip(*map(F.col, ("cloud", "forwarded", "real_ip", "host"))).alias("ip"))


@query(
    "snk5_log_lines",
    """SELECT event_id AS pos, concat('{"timestamp":"', strftime(ts, '%Y-%m-%dT%H:%M:%S'), '","level":"', event_type, '","logger":"app.search","trace_id":', CASE WHEN event_id % 3 = 0 THEN 'null' ELSE concat('"t', event_id % 50, '"') END,
    ',"message":"user ', user_id, ' token=***"', CASE WHEN event_id % 4 = 0 THEN ',"phone": "***", "pos": ' || event_id ELSE '' END, '}') AS line
      FROM events""",
)
def snk5(spark, d):
    """A quarter of the records have extra fields, a secret one among them."""
    log = domain(spark, d, "request_log").withColumn("trace_id", F.when(F.col("pos") % 3 != 0, F.col("trace_id")))
    extras = F.when(F.col("pos") % 4 == 0, F.to_json(F.struct(F.lit("010").alias("phone"), "pos")))
    return co.log_lines(log.withColumn("body", F.concat(F.lit("user "), "ip", F.lit(" token=t"), "ip")).withColumn("extras", extras), "body", "extras")


@query(
    "flt20_log_search",
    f"""{with_clause('request_log')} SELECT pos FROM request_log WHERE coalesce(path, '') <> '/ping' AND trace_id = 't7' UNION ALL
    SELECT -pos FROM request_log WHERE coalesce(path, '') <> '/ping' AND level = 'error'""",
)
def flt20(spark, d):
    log = domain(spark, d, "request_log")
    return co.log_search(log, trace_id="t7").select("pos").unionByName(co.log_search(log, level="error").select((-F.col("pos")).alias("pos")))


_REGIONS = ", ".join(f"({i}, '{name} {SOUGHT}')" for i, name in enumerate((*DISTRICTS, *CITIES)))


@query(
    "src8_search_queries",
    f"""{with_clause('place')}, q(region_order, query) AS (VALUES {_REGIONS}) SELECT q.region_order, q.query, count(p.pos) AS places FROM q
    LEFT JOIN place p USING (region_order) GROUP BY 1, 2""",
)
def src8(spark, d):
    """The places that each of the searches found."""
    found = domain(spark, d, "place").groupBy("region_order").agg(F.count("*").alias("places"))
    return search_queries(spark).join(found, "region_order", "left").select("region_order", "query", F.coalesce("places", F.lit(0).cast("long")).alias("places"))


@query("so2_region_slice", f"{with_clause('place')} SELECT pos, region_order FROM place WHERE region_order >= 5 AND region_order < 12")
def so2(spark, d):
    """The places of a slice of the searches."""
    return domain(spark, d, "place").join(F.broadcast(search_queries(spark, 5, 12)), "region_order").select("pos", "region_order")


@query(
    "dt4_day_bounds",
    """SELECT strftime(ts, '%Y-%m-%dT00:00:00') AS start, strftime(ts, '%Y-%m-%dT23:59:59') AS "end", count(*) AS n FROM events
    GROUP BY 1, 2""",
)
def dt4(spark, d):
    """The records between the bounds of their day."""
    log = domain(spark, d, "request_log").withColumn("b", checks.day_bounds(F.col("ts")))
    stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    return log.filter(stamp.between(F.col("b.start"), F.col("b.end"))).groupBy("b.start", "b.end").agg(F.count("*").alias("n"))


@query(
    "mp1_slot_lookup",
    f"""{with_clause('slot')}, l AS (SELECT *, row_number() OVER (PARTITION BY business_id, biz_item_id, day, hour ORDER BY pos DESC) AS k FROM slot)
    SELECT business_id, biz_item_id, day, bool_or(hour = 10 AND unit_booking_count < unit_stock) AS at_ten, bool_or(hour = 20
      AND unit_booking_count < unit_stock) AS at_twenty FROM l WHERE k = 1 GROUP BY 1, 2, 3""",
)
def mp1(spark, d):
    look = lambda h: av.slot_status(F.col("slots"), F.lit(h))
    return av.slot_maps(domain(spark, d, "slot", placed=True)).select("business_id", "biz_item_id", "day", look("10:00").alias("at_ten"), look("20:00").alias("at_twenty"))


@query(
    "st1_union_pages",
    f"""{with_clause('place')} SELECT business_id, region_order, pos
    FROM (SELECT *, row_number() OVER (PARTITION BY business_id ORDER BY region_order, pos) AS k FROM place) WHERE k = 1""",
)
def st1(spark, d):
    """The pages of all searches together, each business where it was first seen."""
    p = domain(spark, d, "place").select("business_id", "region_order", "pos")
    pages = [p.filter(F.col("region_order") < 25), p.filter(F.col("region_order") >= 25)]  # districts, cities
    return merge.first_wins(co.union_pages(pages), ["business_id"], ["region_order", "pos"])


@query("ag3_slot_maps", f"""{with_clause('slot')}, l AS (SELECT *, row_number() OVER (PARTITION BY business_id, biz_item_id, day,
      hour ORDER BY pos DESC) AS k FROM slot)
SELECT biz_item_id, day, concat('{{{{', string_agg(concat('"', lpad(cast(hour AS varchar), 2, '0'), ':00":', CASE
      WHEN unit_booking_count < unit_stock THEN 'true' ELSE 'false' END), ',' ORDER BY hour), '}}}}') AS slots FROM l WHERE k = 1
      GROUP BY business_id, biz_item_id, day""".replace("{{", "{").replace("}}", "}"))
def ag3(spark, d):
    return av.slot_maps(domain(spark, d, "slot", placed=True)).select("biz_item_id", "day", F.to_json("slots").alias("slots"))


@query(
    "ag6_collection_report",
    f"""{with_clause('branch', 'place')}, p AS (SELECT DISTINCT query, business_id FROM place)
    SELECT query, count(b.business_id) AS success, count(*) - count(b.business_id) AS failed FROM p LEFT
    JOIN branch b USING (business_id) GROUP BY 1""",
)
def ag6(spark, d):
    tried = domain(spark, d, "place").select("query", "business_id").distinct()
    seen = tried.join(domain(spark, d, "branch").select("business_id", F.lit(1).alias("found")), "business_id", "left")
    return seen.groupBy("query").agg(F.count("found").alias("success"), F.count_if(F.col("found").isNull()).alias("failed"))


@query(
    "ag10_field_ranges",
    f"""{with_clause('room')}
    SELECT min(max_capacity) AS least, max(max_capacity) AS most, min(price_per_hour) AS cheapest, max(price_per_hour) AS dearest,
      count(*) FILTER (WHERE max_capacity NOT BETWEEN 2 AND 15) AS outside
    FROM room""",
)
def ag10(spark, d):
    most, price = F.col("max_capacity"), F.col("price_per_hour")
    return domain(spark, d, "room").agg(F.min(most).alias("least"), F.max(most).alias("most"), F.min(price).alias("cheapest"), F.max(price).alias("dearest"), F.count_if(~most.between(2, 15)).alias("outside"))


_FAVORITES = "f AS (SELECT device_id, business_id, biz_item_id FROM favorite_change GROUP BY 1, 2, 3 HAVING arg_max(op, seq) = 'add')"


@query(
    "ag13_favorite_exists",
    f"""{with_clause('favorite_change')}, {_FAVORITES} SELECT c.seq, f.device_id IS NOT NULL AS found FROM favorite_change c LEFT
    JOIN f USING (device_id, business_id, biz_item_id)""",
)
def ag13(spark, d):
    keys = ["device_id", "business_id", "biz_item_id"]
    probes = domain(spark, d, "favorite_change").select("seq", *keys)
    return probes.join(mrg4(spark, d).withColumn("found", F.lit(True)), keys, "left").select("seq", F.coalesce("found", F.lit(False)).alias("found"))


_KEYS = ("substr(business_id, 2)", "concat(substr(business_id, 2), '-', cast(cast(substr(biz_item_id, 2) as int) % 5 as varchar(50)))")


@query("jn10_favorite_rooms", f"""{with_clause('branch', 'room', 'favorite_change')}, {_FAVORITES}, k AS (SELECT DISTINCT device_id,
      {_KEYS[0]} AS business_id, {_KEYS[1]} AS biz_item_id FROM f)
SELECT device_id, biz_item_id, price_per_hour, coalesce(b.name, '') AS branch FROM k JOIN room r USING (business_id, biz_item_id)
      JOIN branch b USING (business_id)""")
def jn10(spark, d):
    favorites = mrg4(spark, d).selectExpr("device_id", f"{_KEYS[0]} as business_id", f"{_KEYS[1]} as biz_item_id").distinct()
    rooms = av.rooms_with_branch(domain(spark, d, "room"), domain(spark, d, "branch"))
    return favorites.join(rooms, ["business_id", "biz_item_id"]).select("device_id", "biz_item_id", "price_per_hour", "branch")


@query(
    "jn12_cascade_delete",
    f"""{with_clause('branch', 'room', 'room_image')}, gone AS (SELECT business_id FROM branch WHERE lat IS NULL), shut AS (SELECT business_id,
      biz_item_id FROM room WHERE max_capacity > 14),
    r AS (SELECT business_id, biz_item_id FROM room WHERE business_id NOT IN (SELECT business_id FROM gone) AND (business_id,
      biz_item_id) NOT IN (SELECT business_id, biz_item_id FROM shut))
    SELECT business_id, biz_item_id, CAST(NULL AS BIGINT) AS image_id FROM r UNION ALL SELECT i.business_id, i.biz_item_id, i.image_id
      FROM room_image i JOIN r USING (business_id, biz_item_id)""",
)
def jn12(spark, d):
    """Branches without coordinates go with their rooms, the largest rooms by themselves, images with both."""
    tables = {name: domain(spark, d, name) for name in ("branch", "room", "room_image")}
    gone = {"branch": tables["branch"].filter("lat is null"), "room": tables["room"].filter("max_capacity > 14").select("business_id", "biz_item_id")}
    stays, _ = references.cascade(tables, gone)
    rooms = stays["room"].select("business_id", "biz_item_id", F.lit(None).cast("long").alias("image_id"))
    return rooms.unionByName(stays["room_image"].select("business_id", "biz_item_id", "image_id"))


@query(
    "st3_split",
    f"""{with_clause('place')} SELECT query, count(*) AS n FROM place WHERE y IS NULL OR try_cast(y AS double) IS NULL GROUP BY 1""",
)
def st3(spark, d):
    p = domain(spark, d, "place").withColumn("reason", checks.coordinate_error(F.col("x"), F.col("y")))
    return p.filter("reason in ('missing', 'not_numeric')").groupBy("query").agg(F.count("*").alias("n"))


@query(
    "so3_first_pages",
    f"""{with_clause('place')}, n AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY pos) AS k FROM place)
    SELECT query, pos, cast(ceil(k / 70) AS BIGINT) AS page FROM n WHERE k <= 350""",
)
def so3(spark, d):
    """At most five pages of 70 hits a query."""
    return co.first_pages(domain(spark, d, "place"), "query", "pos").select("query", "pos", "page")
