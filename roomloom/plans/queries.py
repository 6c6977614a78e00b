"""Queries of the marketplace over the given tables, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import checks, masking, text
from ..operators import availability as av
from ..operators import collection, merge, references
from ..sources.domain import domain, with_clause
from ..sources import payloads
from ..streaming.jobs import rate_breaches

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def _rooms(spark, d):
    return av.rooms_with_branch(domain(spark, d, "room"), domain(spark, d, "branch"))


_ROOMS = "rooms AS (SELECT r.*, coalesce(b.name, '') AS branch, b.lat, b.lng FROM room r JOIN branch b USING (business_id))"
_MATCHES = """matches AS (SELECT q.*, r.business_id, r.biz_item_id, r.price_per_hour, r.lat, r.lng FROM request q JOIN rooms r
  ON r.lat >= sw_lat AND r.lat <= ne_lat AND r.lng >= sw_lng AND r.lng <= ne_lng AND r.max_capacity >= q.capacity)"""
_RESULTS = """free AS (SELECT DISTINCT business_id, biz_item_id, day, hour FROM (SELECT *, row_number() OVER (PARTITION BY business_id, biz_item_id,
      day, hour ORDER BY pos DESC) AS k FROM slot)
  WHERE k = 1 AND unit_booking_count < unit_stock),
results AS (SELECT m.*, (SELECT count(*) FROM free f WHERE f.business_id = m.business_id AND f.biz_item_id = m.biz_item_id AND f.day = m.day
  AND f.hour BETWEEN m.start_hour AND m.end_hour) = m.end_hour - m.start_hour + 1 AS available FROM matches m)"""
_SEARCH = f"{with_clause('branch', 'room', 'slot', 'request')}, {_ROOMS}, {_MATCHES}"


def _tables(spark, d):
    return (domain(spark, d, "request"), _rooms(spark, d), domain(spark, d, "branch"), domain(spark, d, "slot", placed=True))


@query(
    "jn1_room_branch",
    f"""{with_clause('branch', 'room')}, {_ROOMS} SELECT business_id, biz_item_id, branch, lat, lng, max_capacity FROM rooms""",
)
def jn1(spark, d):
    return _rooms(spark, d).select("business_id", "biz_item_id", "branch", "lat", "lng", "max_capacity")


@query("jn2_box_search", f"{_SEARCH} SELECT request_id, business_id, biz_item_id FROM matches")
def jn2(spark, d):
    requests, rooms, branches, _ = _tables(spark, d)
    return av.matches(requests, rooms, branches)


@query("ag1_availability", f"{_SEARCH}, {_RESULTS} SELECT request_id, business_id, biz_item_id, available FROM results")
def ag1(spark, d):
    return av.availability(*_tables(spark, d))


_SUMMARY = """summary AS (SELECT request_id, business_id, min(price_per_hour) AS min_price, count(*) AS available_count, min(lat) AS lat, min(lng) AS lng
  FROM results WHERE available GROUP BY 1, 2)"""


@query("ag4_branch_summary", f"{_SEARCH}, {_RESULTS}, {_SUMMARY} SELECT * FROM summary")
def ag4(spark, d):
    return av.request_summary(*_tables(spark, d))


@query(
    "ag5_responses",
    f"""{_SEARCH}, {_RESULTS}, {_SUMMARY},
    own AS (SELECT m.request_id, string_agg(m.biz_item_id, ',' ORDER BY m.business_id, m.biz_item_id) AS ids,
      string_agg(concat(m.biz_item_id, ':', r.branch, ':', m.price_per_hour), ',' ORDER BY m.business_id, m.biz_item_id) AS rooms
      FROM results m JOIN rooms r USING (business_id, biz_item_id) WHERE available GROUP BY 1),
    b AS (SELECT request_id, string_agg(concat(business_id, ':', min_price, ':', available_count, ':', cast(round(lat * 100) AS int)),
      ',' ORDER BY business_id) AS branches FROM summary GROUP BY 1)
    SELECT q.request_id, (SELECT string_agg(concat(lpad(cast(h AS varchar), 2, '0'), ':00'), ',' ORDER BY h) FROM unnest(range(start_hour,
      end_hour + 1)) t(h)) AS hour_slots,
      coalesce(ids, '') AS ids, coalesce(rooms, '') AS rooms, coalesce(branches, '') AS branches
    FROM request q LEFT JOIN own USING (request_id) LEFT JOIN b USING (request_id)""",
)
def ag5(spark, d):
    """Texts are made once for some hundred requests of a search."""
    stats = lambda b: F.concat_ws(":", b["business_id"], b["stats"]["min_price"], b["stats"]["available_count"], F.round(b["stats"]["lat"] * 100).cast("int"))
    texts = av.search_responses(*_tables(spark, d)).select(
        "ids", F.array_join(av.hour_slots(), ",").alias("hour_slots"), F.array_join(F.transform("results", lambda r: r["biz_item_id"]), ",").alias("own"),
        F.array_join(F.transform("results", lambda r: F.concat_ws(":", r["biz_item_id"], r["branch"], r["price_per_hour"])), ",").alias("rooms"),
        F.array_join(F.transform("branches", stats), ",").alias("branches"),
    )
    return texts.select(F.explode("ids").alias("request_id"), "hour_slots", F.col("own").alias("ids"), "rooms", "branches")


@query(
    "flt4_route",
    f"""{with_clause('branch')}
    SELECT business_id, CASE business_id WHEN 'dream_sadang' THEN 'dream' WHEN 'sadang' THEN 'groove' WHEN 'hongdae_dream' THEN 'dream'
      ELSE 'naver' END AS platform
    FROM branch""",
)
def flt4(spark, d):
    return domain(spark, d, "branch").select("business_id", av.platform(F.col("business_id")).alias("platform"))


@query("flt24_horizon", f"""{with_clause('branch')} SELECT business_id, days, CASE business_id WHEN 'dream_sadang' THEN days >= 121
      WHEN 'sadang' THEN days >= 84 WHEN 'hongdae_dream' THEN days >= 121 ELSE false END AS beyond
FROM branch, (VALUES (83), (84), (120), (121)) t(days)""")
def flt24(spark, d):
    days = domain(spark, d, "branch").withColumn("days", F.explode(F.array(*map(F.lit, (83, 84, 120, 121)))))
    return days.select("business_id", "days", av.beyond_horizon(F.col("business_id"), F.date_add(F.lit("2024-01-01").cast("date"), F.col("days")), "2024-01-01").alias("beyond"))


@query(
    "flt10_request_errors",
    f"""{with_clause('raw_request', 'branch', 'room')}, {_ROOMS},
    n AS (SELECT q.request_id, count(*) AS n, count(*) FILTER (WHERE r.branch = '') AS bad FROM raw_request q JOIN rooms r
      ON r.lat BETWEEN sw_lat AND ne_lat AND r.lng BETWEEN sw_lng AND ne_lng AND r.max_capacity >= q.capacity GROUP BY 1),
    t AS (SELECT q.*, n, bad, cast(split_part(start_hour, ':', 1) AS int) * 60 AS a, cast(split_part(end_hour, ':', 1) AS int) * 60 + 30 AS b
      FROM raw_request q LEFT JOIN n USING (request_id))
    SELECT request_id, CASE WHEN a > b THEN 'slot_order'
      WHEN NOT (sw_lat BETWEEN -90 AND 90 AND ne_lat BETWEEN -90 AND 90) THEN 'lat_range'
      WHEN NOT (sw_lng BETWEEN -180 AND 180 AND ne_lng BETWEEN -180 AND 180) THEN 'lng_range'
      WHEN sw_lat >= ne_lat THEN 'lat_order' WHEN sw_lng >= ne_lng THEN 'lng_order'
      WHEN NOT regexp_matches(date, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}$') THEN 'Date-001'
      WHEN try_cast(date AS date) IS NULL THEN 'invalid_date' WHEN cast(date AS date) < date '2024-06-15' THEN 'Date-002'
      WHEN date = '2024-06-15' AND a <= 14 * 60 THEN 'Hour-002' WHEN n IS NULL THEN 'Room-003' WHEN bad > 0 THEN 'Room-001' END AS error,
      CASE WHEN a <= b THEN (b - a) // 60 + 1 END AS n_slots FROM t""",
)
def flt10(spark, d):
    r = domain(spark, d, "raw_request").withColumn("slots", checks.time_slots(F.col("start_hour"), F.col("end_hour")))
    missing = checks.room_error(*map(F.col, ("business_id", "biz_item_id", "name", "branch")))
    rooms = av.room_counts(r, _rooms(spark, d), domain(spark, d, "branch"), missing.isNotNull())
    error = checks.request_error(F.col("slots"), tuple(map(F.col, av.BOX)), F.col("date"), F.col("rooms"), F.col("incomplete"), "2024-06-15", "2024-06-15 14:00")
    return r.join(rooms, ["capacity", *av.BOX], "left").select("request_id", error.alias("error"), F.size("slots").cast("long").alias("n_slots"))


@query(
    "wn1_first_seen",
    f"""{with_clause('place')} SELECT business_id, name, query, pos
    FROM (SELECT *, row_number() OVER (PARTITION BY business_id ORDER BY query, pos) AS k FROM place) WHERE k = 1""",
)
def wn1(spark, d):
    return merge.first_wins(domain(spark, d, "place").select("business_id", "name", "query", "pos"), ["business_id"], ["query", "pos"])


@query(
    "wn2_last_wins",
    f"""{with_clause('slot')} SELECT business_id, biz_item_id, day, hour, unit_stock, unit_booking_count
    FROM (SELECT *, row_number() OVER (PARTITION BY business_id, biz_item_id, day, hour ORDER BY pos DESC) AS k FROM slot) WHERE k = 1""",
)
def wn2(spark, d):
    """Of rows that tie the first as the table stands: so a stable sort by the SQL's order has it."""
    slots = domain(spark, d, "slot", placed=True)
    return merge.last_wins(slots, ["business_id", "biz_item_id", "day", "hour"], ["pos", "place"]).drop("pos", "place")


@query(
    "wn4_batches",
    f"""{with_clause('room_text')}
    SELECT room_id, business_id, cast(floor((row_number() OVER (PARTITION BY business_id ORDER BY room_id) - 1) / 5) AS BIGINT) AS batch
    FROM room_text""",
)
def wn4(spark, d):
    return collection.batched(domain(spark, d, "room_text"), "business_id", "room_id").select("room_id", "business_id", "batch")


@query(
    "so1_first_n",
    f"""{with_clause('place')} SELECT query, pos FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY pos) AS k FROM place)
    WHERE k <= 10""",
)
def so1(spark, d):
    w = Window.partitionBy("query").orderBy("pos")
    return domain(spark, d, "place").withColumn("k", F.row_number().over(w)).filter("k <= 10").select("query", "pos")


_COORD = "CASE WHEN coalesce(y, '') = '' THEN 'missing' WHEN try_cast(y AS double) IS NULL THEN 'not_numeric' WHEN NOT (try_cast(y AS double) BETWEEN 37.4e0 AND 37.7e0) THEN 'out_of_range' END"


@query("flt11_coordinates", f"{with_clause('place')} SELECT pos, {_COORD} AS reason FROM place")
def flt11(spark, d):
    return domain(spark, d, "place").select("pos", checks.coordinate_error(F.col("x"), F.col("y")).alias("reason"))


@query(
    "ag7_sync_report",
    f"""{with_clause('place')}
    SELECT query, count(*) FILTER (WHERE {_COORD} IS NULL) AS success, count(*) FILTER (WHERE {_COORD} IS NOT NULL) AS failure
    FROM place GROUP BY ROLLUP (query)""",
)
def ag7(spark, d):
    p = domain(spark, d, "place").withColumn("reason", checks.coordinate_error(F.col("x"), F.col("y")))
    return p.rollup("query").agg(F.count_if(F.col("reason").isNull()).alias("success"), F.count_if(F.col("reason").isNotNull()).alias("failure"))


@query("mrg3_sync_coordinates", f"""{with_clause('branch', 'place')}, good AS (SELECT *, cast(y AS double) AS lat, cast(x AS double) AS lng
      FROM place WHERE {_COORD} IS NULL),
h AS (SELECT business_id, arg_min(name, pos) AS name, arg_max(lat, pos) AS lat, arg_max(lng, pos) AS lng FROM good GROUP BY 1)
SELECT coalesce(b.business_id, h.business_id) AS business_id, coalesce(b.name, h.name) AS name, CASE WHEN h.business_id IS NULL THEN b.lat
      ELSE h.lat END AS lat, CASE WHEN h.business_id IS NULL THEN b.lng ELSE h.lng END AS lng
FROM branch b FULL JOIN h ON b.business_id = h.business_id""")
def mrg3(spark, d):
    good = domain(spark, d, "place").filter(checks.coordinate_error(F.col("x"), F.col("y")).isNull())
    return merge.sync_coordinates(domain(spark, d, "branch"), good.select("business_id", "name", "pos", F.col("y").cast("double").alias("lat"), F.col("x").cast("double").alias("lng")))


_KEPT = """CASE WHEN n.business_id IS NULL THEN o.{0} WHEN coalesce(n.{0}, 100) IN (0, 1, 100) AND o.{0} > 1 AND o.{0} <> 100 THEN o.{0}
      ELSE coalesce(n.{0}, 100) END AS {0}"""
_NEWEST = "CASE WHEN n.business_id IS NULL THEN o.{0} ELSE {1} END AS {0}"
_MERGED = f"""merged AS (SELECT coalesce(o.business_id, n.business_id) AS business_id, coalesce(o.biz_item_id, n.biz_item_id) AS biz_item_id,
  {_KEPT.format('max_capacity')}, {_KEPT.format('recommend_capacity')},
  CASE WHEN n.business_id IS NULL THEN o.price_per_hour WHEN coalesce(n.price_per_hour, 0) = 0 AND o.price_per_hour > 0 THEN o.price_per_hour
      ELSE n.price_per_hour END AS price_per_hour,
  {_NEWEST.format('name', 'n.name')}, {_NEWEST.format('base_capacity', 'n.base_capacity')}, {_NEWEST.format('extra_charge', 'n.extra_charge')},
  {_NEWEST.format('requires_call', 'coalesce(n.requires_call, false)')}, {_NEWEST.format('image_urls', 'coalesce(n.image_urls, [])')},
  coalesce(o.can_reserve_one_hour, true) AS can_reserve_one_hour
  FROM room o FULL JOIN incoming_room n ON o.business_id = n.business_id AND o.biz_item_id = n.biz_item_id)"""


def _merged(spark, d):
    return merge.merge_rooms(domain(spark, d, "room"), domain(spark, d, "incoming_room"))


@query(
    "mrg2_merge_rooms",
    f"""{with_clause('room', 'incoming_room')}, {_MERGED} SELECT * REPLACE (array_to_string(image_urls, ',') AS image_urls) FROM merged""",
)
def mrg2(spark, d):
    return _merged(spark, d).withColumn("image_urls", F.array_join("image_urls", ","))


@query(
    "flt13_rule_report",
    f"""{with_clause('room', 'incoming_room')}, {_MERGED} SELECT rule, count(*) AS n
    FROM (SELECT unnest([CASE WHEN price_per_hour < 0 THEN 'price' END, CASE WHEN max_capacity < 1 THEN 'max' END, CASE
      WHEN max_capacity < recommend_capacity THEN 'max_recommend' END]) AS rule
    FROM merged) WHERE rule IS NOT NULL GROUP BY rule""",
)
def flt13(spark, d):
    rules = {"price": F.col("price_per_hour") < 0, "max": F.col("max_capacity") < 1, "max_recommend": F.col("max_capacity") < F.col("recommend_capacity")}
    broken = F.filter(F.array(*(F.when(c, name) for name, c in rules.items())), lambda x: x.isNotNull())
    return _merged(spark, d).select(F.explode(broken).alias("rule")).groupBy("rule").agg(F.count("*").alias("n"))


@query("mrg1_branch_upsert", f"""{with_clause('branch')}, n AS (SELECT business_id, concat(name, '!') AS name, lat + 1 AS lat,
      CAST(NULL AS double) AS lng FROM branch WHERE lat > 37.5e0)
SELECT b.business_id, coalesce(n.name, b.name) AS name, CASE WHEN n.business_id IS NULL THEN b.lat ELSE n.lat END AS lat, CASE
      WHEN n.business_id IS NULL THEN b.lng ELSE n.lng END AS lng FROM branch b LEFT JOIN n USING (business_id)""")
def mrg1(spark, d):
    b = domain(spark, d, "branch")
    news = b.filter("lat > 37.5e0").select("business_id", F.concat("name", F.lit("!")).alias("name"), (F.col("lat") + 1).alias("lat"), F.lit(None).cast("double").alias("lng"))
    return merge.upsert(b, news, ["business_id"])


@query(
    "mrg4_favorites",
    f"""{with_clause('favorite_change')} SELECT device_id, business_id, biz_item_id FROM favorite_change GROUP BY 1, 2, 3
    HAVING arg_max(op, seq) = 'add'""",
)
def mrg4(spark, d):
    return merge.current_favorites(domain(spark, d, "favorite_change"))


@query(
    "ag12_favorite_lists",
    f"""{with_clause('favorite_change')}, f AS (SELECT device_id, business_id, biz_item_id FROM favorite_change GROUP BY 1, 2, 3
    HAVING arg_max(op, seq) = 'add')
    SELECT device_id, array_to_string(list_sort(list(concat(business_id, '/', biz_item_id))), ',') AS ids FROM f GROUP BY 1""",
)
def ag12(spark, d):
    return mrg4(spark, d).groupBy("device_id").agg(F.array_join(F.sort_array(F.collect_list(F.concat_ws("/", "business_id", "biz_item_id"))), ",").alias("ids"))


@query(
    "ag14_rate_breaches",
    f"""{with_clause('request_log')} SELECT right(ip, 1) AS ip, date_trunc('minute', ts) AS start, count(*) AS n FROM request_log GROUP BY 1,
      2 HAVING count(*) > 1""",
)
def ag14(spark, d):
    """Breaches of a gateway, which many users share, in windows of a minute; the log is thin, so the limit is one."""
    return rate_breaches(domain(spark, d, "request_log").withColumn("ip", F.right("ip", F.lit(1))), 1)


@query(
    "ag11_error_report",
    f"""{with_clause('request_log')} SELECT CASE level WHEN 'error' THEN 'ERROR' ELSE 'WARNING' END AS level,
    CASE level WHEN 'error' THEN 500 WHEN 'click' THEN 429 ELSE 400 END AS status, CASE level WHEN 'error' THEN 'COMMON-001' ELSE concat('X-',
      level) END AS error_code, count(*) AS n
    FROM request_log WHERE level <> 'view' GROUP BY 1, 2, 3""",
)
def ag11(spark, d):
    """Failures by level, own status and own code; views are no failures."""
    level = F.col("level")
    code = F.when(level == "error", collection.UNCODED).when(level != "view", F.concat(F.lit("X-"), level))
    failed = domain(spark, d, "request_log").select(code.alias("error_code"), F.when(level == "click", 429).otherwise(400).alias("status_code"))
    return collection.error_report(failed)


def _kept_tables(spark, d):
    """Branches with coordinates, two thirds of the rooms, all images."""
    rooms = domain(spark, d, "room").filter("max_capacity % 3 <> 0")
    return {"branch": domain(spark, d, "branch").filter("lat is not null"), "room": rooms, "room_image": domain(spark, d, "room_image")}


@query(
    "jn11_orphans",
    f"""{with_clause('branch', 'room', 'room_image')}, b AS (SELECT * FROM branch WHERE lat IS NOT NULL), r AS (SELECT * FROM room WHERE max_capacity % 3 <> 0)
    SELECT 'room' AS child, business_id, biz_item_id, CAST(NULL AS BIGINT) AS image_id FROM r WHERE NOT EXISTS (SELECT 1 FROM b
      WHERE b.business_id = r.business_id)
    UNION ALL SELECT 'room_image', business_id, biz_item_id, image_id FROM room_image i WHERE NOT EXISTS (SELECT 1 FROM r
      WHERE r.business_id = i.business_id AND r.biz_item_id = i.biz_item_id)""",
)
def jn11(spark, d):
    found = references.orphans(_kept_tables(spark, d))
    one = lambda name, image: found[name].select(F.lit(name).alias("child"), "business_id", "biz_item_id", image.cast("long").alias("image_id"))
    return one("room", F.lit(None)).unionByName(one("room_image", F.col("image_id")))


@query("jn13_answer_mismatch", f"""{with_clause('room', 'incoming_room')} SELECT coalesce(a.biz_item_id, b.biz_item_id) AS biz_item_id, CASE
      WHEN b.biz_item_id IS NULL THEN 'unanswered' ELSE 'unasked' END AS side
FROM (SELECT * FROM room WHERE max_capacity > 5) a FULL JOIN incoming_room b ON a.biz_item_id = b.biz_item_id
      WHERE a.biz_item_id IS NULL OR b.biz_item_id IS NULL""")
def jn13(spark, d):
    a = domain(spark, d, "room").filter("max_capacity > 5").select(F.col("biz_item_id").alias("a"))
    b = domain(spark, d, "incoming_room").select(F.col("biz_item_id").alias("b"))
    one = a.join(b, F.col("a") == F.col("b"), "full").filter("a is null or b is null")
    return one.select(F.coalesce("a", "b").alias("biz_item_id"), F.when(F.col("b").isNull(), "unanswered").otherwise("unasked").alias("side"))


def _parsed(spark, d):
    return domain(spark, d, "room_text").select("room_id", "business_id", "name", "desc_text", text.parse_room(F.col("name"), F.col("desc_text")).alias("p"))


_NUM = lambda c, p, g=1: f"try_cast(translate(regexp_extract({c}, '{p}', {g}), '０１２３４５６７８９,', '0123456789') AS int)"
_CAP = lambda c: f"""CASE WHEN {_NUM(c, text.BOTH, 2)} IS NOT NULL THEN {{{{'m': {_NUM(c, text.BOTH, 2)}, 'r': {_NUM(c, text.BOTH, 1)}}}}}
 WHEN {_NUM(c, text.RANGE)} IS NOT NULL THEN {{{{'m': coalesce(nullif({_NUM(c, text.MOST)}, 0), nullif({_NUM(c, text.UP_TO)}, 0),
      nullif({_NUM(c, text.POSSIBLE)}, 0), nullif({_NUM(c, text.MINUS)}, 0), {_NUM(c, text.RANGE, 2)}),
      'r': ({_NUM(c, text.RANGE)} + {_NUM(c, text.RANGE, 2)}) // 2}}}}
 WHEN {_NUM(c, text.ADVISED)} IS NOT NULL AND {_NUM(c, text.QUOTA)} IS NULL THEN {{{{'m': coalesce(nullif({_NUM(c, text.MOST)}, 0),
      {_NUM(c, text.ADVISED, 2)}), 'r': ({_NUM(c, text.ADVISED)} + {_NUM(c, text.ADVISED, 2)}) // 2}}}}
 ELSE {{{{'m': coalesce(nullif({_NUM(c, text.MOST)}, 0), nullif({_NUM(c, text.UP_TO)}, 0), nullif({_NUM(c, text.POSSIBLE)}, 0),
      {_NUM(c, text.MINUS)}), 'r': {_NUM(c, text.QUOTA)}}}}} END"""  # noqa: E731
_PARSED = f"""{with_clause('room_text')}, t AS (SELECT *, coalesce(desc_text, '') AS de FROM room_text),
c AS (SELECT *, {_CAP('de')} AS x, {_CAP('name')} AS y FROM t),
p AS (SELECT *, CASE WHEN x.m IS NULL AND x.r IS NULL THEN y.m ELSE x.m END AS m, CASE WHEN x.m IS NULL AND x.r IS NULL THEN y.r ELSE x.r END AS r0 FROM c),
parsed AS (SELECT *, CASE WHEN m IS NOT NULL AND r0 IS NULL THEN CASE WHEN m > 4 THEN m // 2 ELSE m END ELSE r0 END AS r
      FROM p)""".replace("{{", "{").replace("}}", "}")


@query("tx11_parse_rooms", f"""{_PARSED} SELECT room_id, cast(m AS int) AS max_capacity, cast(r AS int) AS recommend_capacity,
 CASE WHEN contains(name, '[평일]') OR contains(name, '(평일)') THEN 'weekday' WHEN contains(name, '[주말]') OR contains(name, '(주말)') OR contains(name,
      '주말/공휴일') THEN 'weekend' END AS day_type,
 {_NUM('de', text.BASE)} AS base_capacity, {_NUM('de', text.EXTRA.removeprefix('(?d)'))} AS extra_charge, contains(de, '당일') AND (contains(de,
      '전화') OR contains(de, '문의')) AS requires_call FROM parsed""")
def tx11(spark, d):
    return _parsed(spark, d).select("room_id", *(F.col(f"p.{c}").alias(c) for c in ("max_capacity", "recommend_capacity", "day_type", "base_capacity", "extra_charge", "requires_call")))


@query(
    "tx12_cascade",
    f"""{_PARSED} SELECT room_id, cast(CASE WHEN contains(name, '대형') THEN 15 WHEN coalesce(m, 0) <> 0 THEN m WHEN said_max BETWEEN 1
      AND 50 THEN said_max ELSE m END AS int) AS max_capacity,
    coalesce(NOT contains(name, '대형') AND coalesce(m, 0) = 0 AND said_max BETWEEN 1 AND 50, false) AS by_model FROM parsed""",
)
def tx12(spark, d):
    """Three quarters of the rooms have a model's answer, some out of bounds."""
    nothing = lambda kind: F.lit(None).cast(kind)
    said = F.struct(
        F.lit("model").alias("clean_name"), nothing("string").alias("day_type"), F.col("said_max").alias("max_capacity"), nothing("int").alias("recommend_capacity"),
        nothing("int").alias("base_capacity"), nothing("int").alias("extra_charge"), F.lit(False).alias("requires_call"),
    )
    found = text.cascade(F.col("name"), F.col("desc_text"), F.when(F.col("said_max").isNotNull(), said))
    return domain(spark, d, "room_text").select("room_id", found.alias("r")).select("room_id", "r.max_capacity", (F.col("r.clean_name") == "model").alias("by_model"))


@query("flt14_unresolved", f"{_PARSED} SELECT room_id, 'no_capacity_info' AS reason FROM parsed WHERE m IS NULL")
def flt14(spark, d):
    found = domain(spark, d, "room_text").select("room_id", text.max_capacity(F.col("name"), F.col("desc_text")).alias("most"))
    reason = merge.unresolved_reason(F.col("most"))
    return found.filter(reason.isNotNull()).select("room_id", reason.alias("reason"))


@query(
    "ag9_parse_rate",
    f"""{_PARSED}
    SELECT business_id, count(*) AS rooms, count(m) AS parsed, round(100.0e0 * count(m) / count(*), 1) AS rate, min(m) AS least, max(m) AS most
    FROM parsed GROUP BY 1""",
)
def ag9(spark, d):
    most = F.col("p.max_capacity")
    return _parsed(spark, d).groupBy("business_id").agg(F.count("*").alias("rooms"), F.count(most).alias("parsed"), F.round(100 * F.count(most) / F.count("*"), 1).alias("rate"), F.min(most).alias("least"), F.max(most).alias("most"))


_FLAGS = """f AS (SELECT *, coalesce(desc_text, '') <> '' AS has_desc, min_price IS NOT NULL AS has_price, coalesce(image_count, 0) AS images,
  contains(name, '[') OR contains(name, '(') OR contains(name, '평일') OR contains(name, '주말') AS name_has_tag FROM room_text)"""


@query(
    "ag8_sample_profile",
    f"""{with_clause('room_text')}, {_FLAGS} SELECT count(DISTINCT business_id) AS businesses, count(*) AS rooms,
    count(*) FILTER (WHERE has_desc) AS with_desc, round(100.0e0 * count(*) FILTER (WHERE has_desc) / count(*), 1) AS desc_percent,
    count(*) FILTER (WHERE has_price) AS with_price, round(100.0e0 * count(*) FILTER (WHERE has_price) / count(*), 1) AS price_percent,
    count(*) FILTER (WHERE name_has_tag) AS with_tag, round(100.0e0 * count(*) FILTER (WHERE name_has_tag) / count(*), 1) AS tag_percent FROM f""",
)
def ag8(spark, d):
    return collection.sample_profile(domain(spark, d, "room_text"))


@query(
    "flt23_profile_flags",
    f"""{with_clause('room_text')}, {_FLAGS} SELECT room_id, has_desc, has_price, images AS image_count, name_has_tag FROM f""",
)
def flt23(spark, d):
    return collection.profile_flags(domain(spark, d, "room_text")).select("room_id", "has_desc", "has_price", "image_count", "name_has_tag")


@query(
    "snk4_samples",
    f"""{with_clause('room_text')}, {_FLAGS} SELECT business_id, count(*) AS rooms,
    string_agg(concat(room_id, ':', name, ':', has_desc, ':', coalesce(cast(min_price AS varchar), 'none'), ':', images, ':', name_has_tag),
      ',' ORDER BY room_id) AS listed FROM f GROUP BY 1""",
)
def snk4(spark, d):
    """What a business's line of the sample file holds."""
    text_of = lambda r: F.concat_ws(":", r["biz_item_id"], r["raw_name"], r["has_desc"], F.coalesce(r["min_price"].cast("string"), F.lit("none")), r["image_count"], r["name_has_tag"])
    found = collection.samples(domain(spark, d, "room_text"))
    return found.select("business_id", F.size("rooms").cast("long").alias("rooms"), F.array_join(F.transform("rooms", text_of), ",").alias("listed"))


@query(
    "wn5_image_order",
    f"""{with_clause('room_image')}
    SELECT image_id, row_number() OVER (PARTITION BY business_id, biz_item_id ORDER BY sort_order, image_id) AS place FROM room_image""",
)
def wn5(spark, d):
    return collection.image_order(domain(spark, d, "room_image")).select("image_id", "place")


@query(
    "wn6_capacity_guess",
    f"""{_PARSED}, k AS (SELECT room_id, business_id, min_price AS price, cast(m AS int) AS m FROM parsed),
    w AS (SELECT *, CASE WHEN m IS NOT NULL AND price IS NOT NULL THEN {{'p': price, 'm': m}} END AS known FROM k),
    x AS (SELECT *, last_value(known IGNORE NULLS) OVER (PARTITION BY business_id ORDER BY price NULLS FIRST,
      room_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS lo,
      first_value(known IGNORE NULLS) OVER (PARTITION BY business_id ORDER BY price NULLS FIRST, room_id ROWS BETWEEN CURRENT ROW
      AND UNBOUNDED FOLLOWING) AS hi FROM w)
    SELECT room_id, coalesce(m, CASE WHEN lo IS NOT NULL AND hi IS NOT NULL AND price IS NOT NULL THEN
      CASE WHEN hi.p = lo.p THEN lo.m ELSE cast(floor(lo.m + (price - lo.p) / (hi.p - lo.p) * (hi.m - lo.m)) AS int) END END) AS guess FROM x""",
)
def wn6(spark, d):
    rooms = domain(spark, d, "room_text").select("room_id", "business_id", F.col("min_price").alias("price"), text.parse_room(F.col("name"), F.col("desc_text"))["max_capacity"].alias("max_capacity"))
    return collection.capacity_from_price(rooms).select("room_id", "guess")


@query(
    "src4_schedule_hours",
    f"""{with_clause('slot')}
    SELECT biz_item_id, concat(CASE WHEN hour < 10 THEN '0' ELSE '' END, cast(hour AS varchar), ':00') AS hour, unit_booking_count < unit_stock AS is_free
    FROM slot""",
)
def src4(spark, d):
    """Hours read back from schedule payloads, one payload a room and day."""
    entry = F.struct(F.format_string("2024-01-01 %02d:00:00", "hour").alias("unitStartTime"), F.col("unit_stock").alias("unitStock"), F.col("unit_booking_count").alias("unitBookingCount"))
    days = domain(spark, d, "slot").groupBy("biz_item_id", "day").agg(F.collect_list(entry).alias("hourly"))
    body = F.to_json(F.struct(F.struct(F.struct(F.struct("hourly").alias("bizItemSchedule")).alias("schedule")).alias("data")))
    return payloads.hours(days.select("biz_item_id", body.alias("payload"))).select("biz_item_id", "hour", "is_free")


@query(
    "src1_places",
    f"""{with_clause('place')} SELECT query, CASE WHEN pos % 4 = 0 THEN concat('own-', business_id) ELSE concat('p', pos) END AS id, name, x, y FROM place""",
)
def src1(spark, d):
    """Places read back from search states of many entries each, other kinds among them; a
    quarter have a booking id, the others are named by their key."""
    p = domain(spark, d, "place").withColumn("bookingBusinessId", F.when(F.col("pos") % 4 == 0, F.concat(F.lit("own-"), "business_id")))
    entry = F.concat(F.lit('"PlaceSummary:p'), "pos", F.lit('":'), F.to_json(F.struct("bookingBusinessId", "name", "x", "y")))
    states = p.groupBy("query", F.floor(F.col("pos") / 50).alias("page")).agg(F.concat(F.lit('{"ROOT_QUERY":7,"Other:1":{"name":"no"},'), F.array_join(F.collect_list(entry), ","), F.lit("}")).alias("state"))
    return payloads.places(states).select("query", "id", "name", "x", "y")


_PAGES = """lab AS (SELECT l_orderkey, l_linenumber, lpad(cast(9 + l_linenumber % 4 AS varchar), 2, '0') AS hour, l_quantity AS q, CASE
      WHEN l_quantity > 25 THEN ' active' ELSE '' END AS mark, l_partkey % 5 AS form FROM lineitem),
pages AS (SELECT l_orderkey, string_agg(CASE form WHEN 0 THEN concat('<!-- <label class="active" title="', hour, '시00분"> -->')
      WHEN 1 THEN concat('<label class="time', mark, '" title="a > ', hour, '시00분">x</label>')
  WHEN 2 THEN concat('<LABEL title=', hour, '시00분 class=', CASE WHEN q > 25 THEN 'active' ELSE 'x' END, '>')
      WHEN 3 THEN concat('<script>s = "<label class=active title=', hour, '시00분>"</script>')
  ELSE concat('<label data-title="', hour, '시00분" class="time', mark, '" title=''2024-05-20 ', hour, '시00분 (월)''>x') END, '' ORDER BY l_linenumber, q,
      form) AS html FROM lab GROUP BY 1)"""


@query(
    "html1_labels",
    f"""WITH {_PAGES}, t AS (SELECT l_orderkey, list_filter(regexp_extract_all(html,
      '<!--.*?-->|<script>.*?</script>|<(?i:label)(?:[^>"'']|"[^"]*"|''[^'']*'')*>'), lambda x: lower(x[:6]) = '<label') AS t FROM pages),
    m AS (SELECT l_orderkey, list_transform(t, lambda x: {{'title': regexp_extract(x, ' title=("[^"]*"|''[^'']*''|[^ >]*)', 1),
      'class': regexp_extract(x, ' class=("[^"]*"|''[^'']*''|[^ >]*)', 1)}}) AS m FROM t), hours AS (SELECT unnest([9, 10, 11, 12, 13]) AS hour)
    SELECT l_orderkey, hour, coalesce(regexp_matches(list_filter(m, lambda x: contains(x.title, concat(lpad(cast(hour AS varchar), 2, '0'),
      '시00분')))[1].class, '(^|[" ])active($|[" ])'), false) AS is_free FROM m, hours""",
)
def html1(spark, d):
    """The escaped page of an order has a label for each line, several of one hour among them; the
    first counts.  Some stand in comments or scripts, some have bare values, or ">" in quotes.
    Every page is parsed once and asked for five hours."""
    active = F.when(F.col("l_quantity") > 25, " active").otherwise("")
    mark = F.concat(F.lpad((9 + F.col("l_linenumber") % 4).cast("string"), 2, "0"), F.lit("시00분"))
    form, join = F.col("l_partkey") % 5, lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))
    label = (
        F.when(form == 0, join('<!-- <label class="active" title="', mark, '"> -->'))
        .when(form == 1, join('<label class="time', active, '" title="a > ', mark, '">x</label>'))
        .when(form == 2, join("<LABEL title=", mark, " class=", F.when(F.col("l_quantity") > 25, "active").otherwise("x"), ">"))
        .when(form == 3, join('<script>s = "<label class=active title=', mark, '>"</script>'))
        .otherwise(join('<label data-title="', mark, '" class="time', active, "\" title='2024-05-20 ", mark, " (월)'>x"))
    )
    line = spark.read.parquet(f"{d}/lineitem.parquet").select("l_orderkey", F.struct("l_linenumber", "l_quantity", form.alias("form"), label.alias("label")).alias("l"))
    page = F.array_join(F.transform(F.sort_array(F.collect_list("l")), lambda x: x["label"]), "")
    escaped = F.replace(F.replace(F.replace(page, F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), F.lit('"'), F.lit("&quot;"))
    answers = line.groupBy("l_orderkey").agg(F.to_json(F.struct(escaped.alias("items"))).alias("payload"))
    pages = payloads.label_pages(answers).select("l_orderkey", payloads.label_marks(F.col("html")).alias("marks"))
    asked = pages.withColumn("hour", F.explode(F.sequence(F.lit(9), F.lit(13))))
    return asked.select("l_orderkey", "hour", payloads.marked_free(F.col("marks"), F.col("hour")).alias("is_free"))


#: The same rules without back-references, which DuckDB's patterns lack.
_KEY = f"(?:\"(?:{masking.KEYS})\"|''(?:{masking.KEYS})''|(?:{masking.KEYS}))"
_MASKED = lambda c: (
    rf"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({c}, '({masking.HEADERS}){masking.S}*:{masking.S}*[^;\n]+',
      '\1: ***', 'gi'),
    '({_KEY}{masking.S}*[:=]{masking.S}*)(?:(")[^"\n]*"|('')[^''\n]*'')', '\1\2\3***\2\3', 'gi'),
      '({_KEY}{masking.S}*[:=]{masking.S}*)[^"'',{masking.BLANKS};&]+', '\1***', 'gi'),
    '{masking.EMAIL}', '***@***.***', 'g'), '{masking.PHONE}', '***-****-****', 'g')"""
)


@query("mk6_masked_documents", f"SELECT doc_id, {_MASKED('text')} AS text FROM documents")
def mk6(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet")
    return docs.select("doc_id", masking.mask_text(F.col("text")).alias("text"))


@query(
    "mk7_masked_bodies",
    f"""WITH b AS (SELECT event_id, CASE event_id % 4
      WHEN 0 THEN concat('{{"event": ', event_id, ', "user_id": ', user_id, ', "more": {{"Token": "t', event_id, '", "kind": "', event_type, '"}}}}')
      WHEN 2 THEN concat('{{"list": [{{"EMAIL": "a@b.org", "pos": ', event_id, '}}, {{"note": "pwd=', user_id, '", "Cookie": {{"id": ', user_id, '}}}}], "tokens": 1}}')
      ELSE concat('user_id=', user_id, '&kind=', event_type, ' token :　"a b', event_id, '" from jo', event_id, '@example.org, 010-1234-', 1000 + event_id % 9000) END AS body FROM events)
    SELECT event_id, CASE WHEN event_id % 2 = 0 THEN regexp_replace(body, '"((?i:{masking.KEYS}|{masking.HEADERS}))": ("[^"]*"|[0-9]+|\\{{[^}}]*\\}})', '"\\1": "***"', 'g')
      ELSE {_MASKED('b.body')} END AS body FROM b""",
)
def mk7(spark, d):
    """Bodies of records: half are objects of two forms, masked by their keys, half are texts, masked by patterns."""
    e = spark.read.parquet(f"{d}/events.parquet")
    more = F.struct(F.concat(F.lit("t"), "event_id").alias("Token"), F.col("event_type").alias("kind"))
    one = F.to_json(F.struct(F.col("event_id").alias("event"), "user_id", more.alias("more")))
    mail = F.to_json(F.struct(F.lit("a@b.org").alias("EMAIL"), F.col("event_id").alias("pos")))
    note = F.to_json(F.struct(F.concat(F.lit("pwd="), "user_id").alias("note"), F.struct(F.col("user_id").alias("id")).alias("Cookie")))
    other = F.concat(F.lit('{"list": ['), mail, F.lit(","), note, F.lit('], "tokens": 1}'))
    mark = F.lit(' token :　"a b')
    line = F.concat(F.lit("user_id="), "user_id", F.lit("&kind="), "event_type", mark, "event_id", F.lit('" from jo'), "event_id", F.lit("@example.org, 010-1234-"), 1000 + F.col("event_id") % 9000)
    form = F.col("event_id") % 4
    return e.select("event_id", masking.mask_body(F.when(form == 0, one).when(form == 2, other).otherwise(line)).alias("body"))


@query(
    "wn3_hour_continuity",
    f"""{with_clause('slot')}, g AS (SELECT biz_item_id, day, min(hour) AS a, max(hour) AS b, count(*) AS n, count(DISTINCT hour) AS k
    FROM slot GROUP BY 1, 2) SELECT biz_item_id, day, CASE WHEN n > 1 AND (n <> k OR b - a + 1 <> n) THEN 'Hour-003' END AS error
    FROM g""",
)
def wn3(spark, d):
    hours = domain(spark, d, "slot").groupBy("biz_item_id", "day").agg(F.collect_list(F.format_string("%02d:00", "hour")).alias("hours"))
    return hours.select("biz_item_id", "day", checks.continuity_error(F.col("hours")).alias("error"))
