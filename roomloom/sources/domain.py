"""The marketplace's tables, derived from the given ones.

Each table is one SELECT in SQL that both engines understand; ``WITH`` clauses made of
them also head the reference SQL of the queries.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_BUSINESS = "case when {0} = 1 then 'dream_sadang' when {0} = 2 then 'sadang' when {0} = 3 then 'hongdae_dream' else cast({0} as varchar(50)) end"
_SUPPLIER, _LINE = _BUSINESS.format("s_suppkey"), _BUSINESS.format("l_suppkey")
_ITEM = "concat(cast(l_suppkey as varchar(50)), '-', cast(l_partkey % 5 as varchar(50)))"

#: table -> (the given table it comes from, its SELECT)
TABLES: dict[str, tuple[str, str]] = {
    "branch": ("supplier", f"""select {_SUPPLIER} as business_id, s_name as name,
        case when s_suppkey % 17 = 0 then null else 37.35e0 + (s_suppkey % 40) * 0.01e0 end as lat,
        case when s_suppkey % 17 = 0 then null else 126.70e0 + s_nationkey * 0.02e0 end as lng from supplier"""),
    "room": ("lineitem", f"""select {_LINE} as business_id, {_ITEM} as biz_item_id,
        cast(2 + (l_suppkey * 7 + (l_partkey % 5) * 3) % 15 as int) as max_capacity,
        cast(1 + (l_suppkey + l_partkey % 5) % 9 as int) as recommend_capacity,
        cast(floor(min(l_extendedprice)) as int) as price_per_hour, concat('room ', cast(l_partkey % 5 as varchar(50))) as name,
        cast(case when l_suppkey % 3 = 0 then null else 2 + l_suppkey % 3 end as int) as base_capacity, cast(1000 * (l_suppkey % 4) as int) as extra_charge,
        l_suppkey % 2 = 0 as requires_call, split(concat('old', cast(l_suppkey as varchar(50)), '.jpg,b.jpg'), ',') as image_urls,
        l_suppkey % 6 <> 0 as can_reserve_one_hour from lineitem group by l_suppkey, l_partkey % 5"""),
    "incoming_room": ("lineitem", f"""select {_LINE} as business_id, {_ITEM} as biz_item_id,
        cast(case when l_suppkey % 4 = 0 then null when l_suppkey % 4 = 1 then 1 else 3 + l_suppkey % 9 end as int) as max_capacity,
        cast(case when l_suppkey % 5 = 0 then null when l_suppkey % 5 = 1 then 100 else 2 + l_suppkey % 4 end as int) as recommend_capacity,
        cast(case when l_suppkey % 3 = 0 then null when l_suppkey % 3 = 1 then 0 else floor(max(l_extendedprice)) end as int) as price_per_hour,
        concat('[new] room ', cast(l_partkey % 5 as varchar(50))) as name, cast(case when l_suppkey % 2 = 0 then null else 3 end as int) as base_capacity,
        cast(case when l_suppkey % 5 = 0 then null else 2500 end as int) as extra_charge, case when l_suppkey % 3 = 0 then null
      else l_suppkey % 3 = 1 end as requires_call,
        case when l_suppkey % 7 = 0 then null else split(concat('new', cast(l_partkey % 5 as varchar(50)), '.jpg'), ',') end as image_urls
        from lineitem where l_partkey % 5 <> 2 group by l_suppkey, l_partkey % 5"""),
    "slot": ("lineitem", f"""select {_LINE} as business_id, {_ITEM} as biz_item_id, cast(year(l_shipdate) as int) as day,
        cast(9 + cast(l_quantity as int) % 12 as int) as hour, l_orderkey * 10 + l_linenumber as pos,
        1 + cast(l_tax * 100 as int) % 3 as unit_stock, cast(l_discount * 100 as int) % 3 as unit_booking_count from lineitem"""),
    "request": ("orders", """select o_orderkey as request_id, cast(year(o_orderdate) as int) as day, cast(2 + o_custkey % 8 as int) as capacity,
        cast(9 + o_orderkey % 10 as int) as start_hour, cast(9 + o_orderkey % 10 + o_custkey % 3 as int) as end_hour,
        37.35e0 + (o_custkey % 30) * 0.01e0 as sw_lat, 126.70e0 + (o_orderkey % 20) * 0.02e0 as sw_lng,
        37.35e0 + (o_custkey % 30) * 0.01e0 + 0.05e0 as ne_lat, 126.70e0 + (o_orderkey % 20) * 0.02e0 + 0.08e0 as ne_lng from orders"""),
    "raw_request": ("orders", """select o_orderkey as request_id,
        case when o_orderkey % 7 = 0 then '2024/01/02' when o_orderkey % 7 = 1 then '2024-02-30'
      else concat(cast(1995 + o_orderkey % 60 as varchar(50)), '-06-15') end as date,
        case when o_orderkey % 10 = 3 then '9:00' else concat(cast(10 + o_custkey % 12 as varchar(50)), ':00') end as start_hour,
        concat(cast(12 + o_orderkey % 9 as varchar(50)), ':30') as end_hour,
        case when o_custkey % 13 = 0 then 91e0 else 37e0 + o_custkey % 3 end as sw_lat, case when o_custkey % 17 = 0 then 181e0
      else 126e0 + o_orderkey % 3 end as sw_lng,
        38e0 + o_custkey % 2 as ne_lat, 127e0 + o_orderkey % 2 as ne_lng, cast(2 + o_custkey % 18 as int) as capacity from orders"""),
    "place": ("orders", """select cast(o_custkey as varchar(50)) as business_id, o_orderpriority as query, o_orderkey as pos,
      cast(o_orderkey % 35 as int) as region_order,
        concat('biz-', cast(o_orderkey as varchar(50))) as name, '127' as x,
        case when o_orderkey % 11 = 0 then null when o_orderkey % 13 = 0 then 'n/a' else concat('37.',
      cast(2 + o_orderkey % 7 as varchar(50))) end as y from orders"""),
    "room_text": ("part", """select room_id, business_id, case when room_id % 11 = 3 then replace(name, ' ', ' ')
      when room_id % 11 = 5 then translate(name, '0123456789', '０１２３４５６７８９') else name end as name,
        case when room_id % 13 = 5 then replace(desc_text, ' ', '　') when room_id % 13 = 7 then translate(desc_text, '0123456789', '０１２３４５６７８９')
      else desc_text end as desc_text, min_price, image_count, said_max
        from (select p_partkey as room_id, cast(p_partkey % 97 as varchar(50)) as business_id,
        case p_partkey % 6 when 0 then concat('[평일] ', p_name) when 1 then concat(p_name, ' (주말)') when 2 then concat('[주말/공휴일] ', p_name)
             when 3 then concat(p_name, ' (정원 ', cast(p_size as varchar(50)), '명, 최대 ', cast(p_size + 5 as varchar(50)), '명)')
             when 4 then concat(p_name, ' (-', cast(p_size as varchar(50)), '명)') else concat('대형 ', p_name) end as name,
        case p_partkey % 7 when 0 then concat('최대 ', cast(p_size as varchar(50)), '인 수용 가능')
             when 1 then concat(cast(p_size as varchar(50)), '~', cast(p_size + 2 as varchar(50)), '인 권장, Max ', cast(p_size + 4 as varchar(50)), '인')
             when 2 then concat('기본 ', cast(1 + p_size % 6 as varchar(50)), '인, ', case p_partkey % 3 when 0 then '1인 추가시 3,000 원'
      when 1 then concat('인당 ', cast(500 * (p_size % 9) as varchar(50)), '원') else '추가 요금 2000원' end)
             when 3 then case p_partkey % 4 when 0 then '당일 예약은 전화 바랍니다' when 1 then '당일 예약 불가' when 2 then '전화 예약' else '문의: 당일도 가능' end when 4 then null
             when 5 then concat(cast(p_size as varchar(50)), '인이 합주 가능') else concat('권장 인원 ', cast(p_size as varchar(50)), '명 ',
      cast(p_size + 3 as varchar(50)), '명') end as desc_text,
        cast(case when p_partkey % 9 = 0 then null else floor(p_retailprice) end as int) as min_price, cast(case when p_partkey % 11 = 0 then null
      else p_partkey % 4 end as int) as image_count,
        cast(case when p_partkey % 4 = 0 then null else p_partkey % 70 end as int) as said_max from part) as given_rooms"""),
    "client": ("events", """select event_id, case event_id % 5 when 0 then ' ' when 1 then concat('6f1c2e34-0000-4000-8000-',
      cast(event_id % 1000 as varchar(50)))
             when 2 then concat('{6F1c2e34-0000-4000-8000-', lpad(cast(event_id as varchar(50)), 12, '0'), '}')
      when 3 then concat('urn:uuid:6f1c2e34-0000-4000-8000-', lpad(cast(event_id as varchar(50)), 12, '0')) end as device,
        case event_id % 3 when 0 then concat('6F1c2e34-0000-4000-8000-', lpad(cast(event_id as varchar(50)), 12, '0'))
      when 1 then concat('6f1c2e340000', cast(event_id as varchar(50))) end as trace,
        case when event_id % 5 = 0 then concat(' c', cast(user_id as varchar(50)), ' ') else '' end as cloud, case
      when event_id % 2 = 0 then concat(' f', cast(user_id as varchar(50)), ', g') end as forwarded,
        case when event_id % 3 = 0 then 'r' else ' ' end as real_ip, case when event_id % 7 <> 0 then concat('h',
      cast(user_id as varchar(50))) end as host from events"""),
    "room_image": ("lineitem", f"""select {_LINE} as business_id, {_ITEM} as biz_item_id, l_orderkey * 10 + l_linenumber as image_id,
        cast(l_linenumber % 3 as int) as sort_order, concat(cast(l_orderkey as varchar(50)), '.jpg') as image_url from lineitem"""),
    "favorite_change": ("events", """select cast(user_id as varchar(50)) as device_id, concat('b', cast(event_id % 7 as varchar(50))) as business_id,
        concat('i', cast(event_id % 31 as varchar(50))) as biz_item_id, case when event_type = 'error' then 'delete' else 'add' end as op, event_id as seq
        from events where event_type <> 'view'"""),
    "request_log": ("events", """select cast(user_id as varchar(50)) as ip, ts, event_type as level, event_id as pos, concat('t',
      cast(event_id % 50 as varchar(50))) as trace_id,
        'app.search' as logger, case when event_id % 5 = 0 then '/ping' when event_id % 5 = 1 then null else '/rooms' end as path from events"""),
}


def domain(spark: SparkSession, sf_dir: str, name: str, placed: bool = False) -> DataFrame:
    """The table; with ``placed`` also ``place``, which falls from row to row of the given one."""
    source, select = TABLES[name]
    given = spark.read.parquet(f"{sf_dir}/{source}.parquet")
    plain = select.replace("{", "{{").replace("}", "}}")
    if placed:
        given, plain = _placed(given), re.sub(rf"\bfrom {source}\b", f", place from {source}", plain)
    return spark.sql(re.sub(rf"\bfrom {source}\b", "from {given}", plain), given=given)


def _placed(given: DataFrame) -> DataFrame:
    """``given`` with ``place``: files in the order of their paths, rows as they stand in them."""
    own = given.columns
    given = given.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    if len(given.inputFiles()) == 1:
        return given.select(*own, (-F.col("_row")).alias("place"))
    files = sorted(r[0] for r in given.select("_file").distinct().collect())  # as many as Spark lists for reading
    numbers = given.sparkSession.createDataFrame(list(enumerate(files)), "_number long, _file string")
    return given.join(F.broadcast(numbers), "_file").select(*own, (-(F.col("_number") * (1 << 40) + F.col("_row"))).alias("place"))


def with_clause(*names: str) -> str:
    return "WITH " + ", ".join(f"{n} AS ({TABLES[n][1]})" for n in names)


#: The places searched for, in the order of the search; each is followed by what is sought there.
DISTRICTS = (
    "강남구", "강동구", "강북구", "강서구", "관악구", "광진구", "구로구", "금천구", "노원구", "도봉구", "동대문구", "동작구", "마포구",
    "서대문구", "서초구", "성동구", "성북구", "송파구", "양천구", "영등포구", "용산구", "은평구", "종로구", "중구", "중랑구",
)
CITIES = ("부산", "대구", "인천", "광주", "대전", "울산", "수원", "성남", "고양", "부천")
SOUGHT = "합주실"


def search_queries(spark: SparkSession, start: int = 0, end: int | None = None) -> DataFrame:
    """(region_order, query): districts, then cities; of these the places ``start`` to ``end``."""
    rows = list(enumerate(f"{place} {SOUGHT}" for place in (*DISTRICTS, *CITIES)))
    return spark.createDataFrame(rows[start:end], "region_order int, query string")


#: Columns of the master tables, in the order in which they are written.
MASTER = {
    "branch": "business_id string, name string, lat decimal(10,7), lng decimal(10,7)",
    "room": "business_id string, biz_item_id string, name string, max_capacity int, recommend_capacity int, base_capacity int, extra_charge decimal(15,2), price_per_hour decimal(15,2), can_reserve_one_hour boolean, requires_call boolean, image_urls array<string>",
    "room_image": "image_id long, business_id string, biz_item_id string, image_url string, sort_order int",
    "favorites": "device_id string, business_id string, biz_item_id string, created_at timestamp",
}


#: The column by which a master table is cut into ranges for reading.
RANGE_KEY = {"branch": "business_id", "room": "business_id", "room_image": "image_id", "favorites": "device_id"}


def _query(spark: SparkSession, jdbc: dict[str, str], sql: str) -> DataFrame:
    return spark.read.format("jdbc").options(**jdbc).option("query", sql).load()


def key_ranges(spark: SparkSession, table: str, key: str, jdbc: dict[str, str], parts: int) -> list[str]:
    """Conditions that cut a table into about ``parts`` ranges of equal size, nulls in the first.

    The database numbers its keys in its own order and returns every n-th, so that ranges are
    even whatever the keys look like, and cover every row once.
    """
    key = f'"{key}"'
    n = _query(spark, jdbc, f"SELECT COUNT({key}) AS n FROM {table}").first()[0]
    step = max(1, -(-n // parts))
    ordered = f"SELECT k, ROW_NUMBER() OVER () AS r FROM (SELECT {key} AS k FROM {table} WHERE {key} IS NOT NULL ORDER BY {key}) AS o"
    picked = f"SELECT DISTINCT k FROM ({ordered}) AS p WHERE MOD(r, {step}) = 0 AND r < {n}"
    cuts = [r[0] for r in _query(spark, jdbc, picked).collect()] if n > step else []
    texts = [(c, c if isinstance(c, (int, float)) else "'" + str(c).replace("'", "''") + "'") for c in cuts]
    if texts and not isinstance(texts[0][0], (int, float)):
        # The database's order of texts is not known here: it says how many cuts lie before each.
        listed = " UNION ALL ".join(f"SELECT COUNT(*) AS n, {i} AS i FROM ({picked}) AS q{i} WHERE k < {t}" for i, (_, t) in enumerate(texts))
        place = {r[1]: r[0] for r in _query(spark, jdbc, listed).collect()}
        texts = [texts[i] for i in sorted(place, key=place.get)]
    else:
        texts.sort()
    bounds = [t for _, t in texts]
    if not bounds:
        return ["1 = 1"]
    inner = [f"{key} > {a} AND {key} <= {b}" for a, b in zip(bounds, bounds[1:])]
    return [f"{key} <= {bounds[0]} OR {key} IS NULL", *inner, f"{key} > {bounds[-1]}"]


def read_master(
    spark: SparkSession, name: str, folder: str | None = None, jdbc: dict[str, str] | None = None, parts: int = 1,
    box: tuple[float, float, float, float] | None = None, capacity: int | None = None,
) -> DataFrame:
    """A master table from Parquet under ``folder``, or over JDBC with these options; of
    columns it lacks all values are null.

    Over JDBC the table is read in ``parts`` ranges of its key, each over its own connection.
    ``box`` (sw_lat, sw_lng, ne_lat, ne_lng) and ``capacity`` limit the rows by the table's own
    columns, so that the database or the Parquet reader applies them.
    """
    if jdbc is None:
        found = spark.read.parquet(f"{folder}/{name}")
    elif parts > 1:
        url, rest = jdbc["url"], {k: v for k, v in jdbc.items() if k != "url"}
        found = spark.read.jdbc(url, name, predicates=key_ranges(spark, name, RANGE_KEY[name], jdbc, parts), properties=rest)
    else:
        found = spark.read.format("jdbc").options(dbtable=name, **jdbc).load()
    if box is not None:
        found = found.filter((F.col("lat") >= box[0]) & (F.col("lng") >= box[1]) & (F.col("lat") <= box[2]) & (F.col("lng") <= box[3]))
    if capacity is not None:
        found = found.filter(F.col("max_capacity") >= capacity)
    kinds = [c.strip().split(" ") for c in re.split(r",(?![^(<]*[)>])", MASTER[name])]
    present = {c.lower() for c in found.columns}
    return found.select(*((F.col(c) if c in present else F.lit(None)).cast(kind).alias(c) for c, kind in kinds))
