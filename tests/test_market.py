"""Golden cases of the marketplace's rules, and every query against its SQL."""

import json

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from roomloom.functions import checks, masking, text
from roomloom.operators import availability, collection, merge
from roomloom.plans import queries as market
from roomloom.sources import domain, payloads
from roomloom.streaming import jobs

SF = "/root/testdata/sf0.001"

ROOMS = [  # name, desc, and what the parse must hold
    ("[평일] 무지개홀", "드럼실 최대 9인 수용 가능", {"clean_name": "무지개홀", "day_type": "weekday", "max_capacity": 9}),
    ("은하수룸 (주말)", "3~7인 권장, 최대 9인", {"clean_name": "은하수룸", "day_type": "weekend", "recommend_capacity": 5, "max_capacity": 9}),
    ("지하연습실", "기본 3인, 1인 추가시 2,500원", {"base_capacity": 3, "extra_charge": 2500}),
    ("옥상룸", "당일 이용은 문의 주세요", {"requires_call": True}),
    ("복층룸", "", {"max_capacity": None, "day_type": None, "requires_call": False}),
    ("단층룸", None, {"requires_call": False}),
    ("가람", "12명까지 들어갈 수 있어요", {"max_capacity": 12}),
    ("[주말/공휴일] 나래", "6인 권장", {"day_type": "weekend", "clean_name": "나래"}),
    ("다솜", "7 인이 합주 가능", {"max_capacity": 7}),
    ("라온", "5인 까지 사용", {"max_capacity": 5}),
    ("마루", "14인 이하", {"max_capacity": 14}),
    ("바다룸 (정원 11명, 최대 16명)", "", {"clean_name": "바다룸", "max_capacity": 16, "recommend_capacity": 11}),
    ("사랑", "권장 인원 8명 11명", {"recommend_capacity": 9, "max_capacity": 11}),
    ("아라룸 (최대 17명)", "최대 25인 수용 가능", {"max_capacity": 25}),
    ("자연룸 (-13명)", "", {"clean_name": "자연룸", "max_capacity": 13}),
    ("차오름 (-7명)", "앰프와 마이크만 적힌 글", {"clean_name": "차오름", "max_capacity": 7}),
    ("카누", "Amp AC30-2 Combo, JCM 900", {"max_capacity": None}),
    ("타래", "최대 １４인", {"max_capacity": 14, "recommend_capacity": 7}),
]


def test_room_texts(spark):
    df = spark.createDataFrame([(i, n, d) for i, (n, d, _) in enumerate(ROOMS)], "i int, name string, desc string")
    got = {r.i: r.p for r in df.select("i", text.parse_room(F.col("name"), F.col("desc")).alias("p")).collect()}
    for i, (_, _, want) in enumerate(ROOMS):
        assert {k: got[i][k] for k in want} == want, ROOMS[i]


def test_merge_truth_table(spark):
    cases = [((1, 1, 15000), (10, 8, 20000), (10, 8, 15000)), ((5, 4, 15000), (10, 8, 20000), (5, 4, 15000)), ((8, 6, 15000), (1, 1, None), (8, 6, 15000)), ((5, 4, None), (5, 4, 25000), (5, 4, 25000)), ((None, None, 0), (100, 1, 7), (100, 100, 7))]
    schema = "business_id string, biz_item_id string, max_capacity int, recommend_capacity int, price_per_hour int"
    old = spark.createDataFrame([("b", str(i), *o) for i, (_, o, _) in enumerate(cases)] + [("b", "stays", 3, 2, 1)], schema)
    new = spark.createDataFrame([("b", str(i), *n) for i, (n, _, _) in enumerate(cases)] + [("b", "new", 1, 1, 15000)], schema)
    got = {r.biz_item_id: tuple(r)[2:] for r in merge.merge_rooms(old, new).collect()}
    assert got == {**{str(i): w for i, (_, _, w) in enumerate(cases)}, "stays": (3, 2, 1), "new": (1, 1, 15000)}


def test_merge_of_all_columns(spark):
    kinds = "business_id string, biz_item_id string, name string, max_capacity int, base_capacity int, extra_charge int, requires_call boolean, image_urls array<string>"
    old = spark.createDataFrame([("b", "1", "old", 4, 2, 900, True, ["o"], False), ("b", "2", "stays", 3, 1, 5, True, ["s"], False)], f"{kinds}, can_reserve_one_hour boolean")
    new = spark.createDataFrame([("b", "1", "[평일] raw", None, None, None, None, None), ("b", "3", "n", 6, 2, 1, True, ["x", "y"])], kinds)
    got = {r.biz_item_id: tuple(r)[2:] for r in merge.merge_rooms(old, new).collect()}
    assert got == {"1": ("[평일] raw", 4, None, None, False, [], False), "2": ("stays", 3, 1, 5, True, ["s"], False), "3": ("n", 6, 2, 1, True, ["x", "y"], True)}


def test_masking(spark):
    cases = {
        "pwd=hunter2 id_token=zz9 from kim@mail.example": "pwd=*** id_token=*** from ***@***.***",
        "token=t1&user_id=42&page=3&cvc=123": "token=***&user_id=***&page=3&cvc=***",
        "database_url: 'pg://u:p@h/db' \"x-api-key\": \"two words\"": "database_url: '***' \"x-api-key\": \"***\"",
        "Set-Cookie: a=1, b=2; path=/": "Set-Cookie: ***; path=/",
        "monkey=1 tel 02-123-4567 or 1010-1234-5678": "monkey=*** tel ***-****-**** or 1010-1234-5678",
        "연락처kim@mail.example": "연락처kim@mail.example",  # letters before it belong to the same word
        "no secret here": "no secret here",
        "": "",
        None: None,
    }
    df = spark.createDataFrame([(x,) for x in cases], "x string")
    got = df.select("x", masking.mask_text(F.col("x")).alias("m"), masking.mask_body(F.col("x")).alias("b")).collect()
    assert {r.x: r.m for r in got} == cases and all(r.b == r.m for r in got)
    bodies = {
        '{"pass": null, "who": {"Mobile": "x", "n": [{"key": 1}, "address=1"]}}': '{"pass": "***", "who": {"Mobile": "***", "n": [{"key": "***"}, "address=1"]}}',
        '{"broken": key=1': '{"broken": key=***',
        '[{"secret": 1}]': '[{"secret": ***',
    }
    df = spark.createDataFrame([(x,) for x in bodies], "x string")
    assert {r.x: r.b for r in df.select("x", masking.mask_body(F.col("x")).alias("b")).collect()} == bodies
    assert set(masking.SECRET_KEYS) >= {"pwd", "bearer", "resident_number", "connection_string"} and len(set(masking.SECRET_KEYS)) == 42


def test_hours_and_ids(spark):
    df = spark.createDataFrame([("18:00", "21:00"), ("14:30", "16:00"), ("9:00", "9:00"), ("10:00", "09:00"), ("x", "10:00")], "a string, b string")
    assert [r.s for r in df.select(checks.time_slots(F.col("a"), F.col("b")).alias("s")).collect()] == [["18:00", "19:00", "20:00", "21:00"], ["14:30", "15:30"], ["09:00"], None, None]
    hours = spark.createDataFrame([(["09:00", "10:00", "11:00"],), (["09:00", "11:00"],), (["11:00", "09:00", "10:00"],), (["09:00"],), (["09:00", "09:00"],)], "h array<string>")
    assert [r.e for r in hours.select(checks.continuity_error(F.col("h")).alias("e")).collect()] == [None, "Hour-003", None, None, "Hour-003"]
    ids = spark.createDataFrame([(None,), (" ",), ("not-a-uuid",), ("{6f1c2e34-0000-4000-8000-123456789abc}",)], "d string")
    assert [r.e for r in ids.select(checks.device_error(F.col("d")).alias("e")).collect()] == ["required", "required", "invalid format", None]


def test_html_slots(spark):
    html = '<label title="2031-01-02 14시00분 (목)" class="time active"><i>x</label><label class="time" title=\'2031-01-02 15시00분\'>y<div id="reserve_time_13_20" class="reserve_time_off">'
    row = spark.createDataFrame([(html,)], "h string").select(*(payloads.label_free(F.col("h"), F.lit(h)).alias(f"l{h}") for h in (14, 15, 16)), *(payloads.cell_free(F.col("h"), F.lit("13"), F.lit(h)).alias(f"c{h}") for h in (20, 21))).first()
    assert tuple(row) == (True, False, False, True, False)


def test_escaped_label_pages(spark):
    items = '&lt;label class=&quot;active&quot; title=&quot;8월 09시00분&quot;&gt;&lt;label class=&quot;time&quot; title=&quot;09시00분&quot;&gt;&amp;'
    rows = [(json.dumps({"items": items}), True, False), (json.dumps({"items": None}), False, False), ("{}", False, False), ("<html>", False, True), (None, False, True)]
    df = payloads.label_pages(spark.createDataFrame(rows, "payload string, free boolean, bad boolean"))
    got = df.select("free", payloads.label_free(F.col("html"), F.lit(9)).alias("l"), "bad", "failed", "html").collect()
    assert all(r.free == r.l and r.bad == r.failed for r in got) and got[0].html.endswith(">&")


def test_model_answers(spark):
    df = spark.createDataFrame([("```json\n{\"a\": 1}\n```",), (" ```\n{}\n``` ",), ("{}",)], "x string")
    assert [r.m for r in df.select(text.unfenced(F.col("x")).alias("m")).collect()] == ['{"a": 1}', "{}", "{}"]
    said = {
        "named": ({"clean_name": None, "max_capacity": 3}, True), "unnamed": ({"max_capacity": 3}, False), "word": ({"clean_name": "a", "max_capacity": "3"}, False),
        "large": ({"clean_name": "a", "recommend_capacity": 51}, False), "part": ({"clean_name": "a", "max_capacity": 2.5, "extra_charge": 0}, True),
        "day": ({"clean_name": "a", "day_type": "monday"}, False), "flag": ({"clean_name": "a", "max_capacity": True, "day_type": None}, True), "list": ([1], False),
    }
    answer = spark.createDataFrame([(1, "```json\n" + json.dumps({k: v for k, (v, _) in said.items()}) + "\n```"), (2, "sorry")], "k int, response string")
    assert {r.id: r.usable for r in collection.answers(answer, ["k"]).collect()} == {k: ok for k, (_, ok) in said.items()}


def test_requests_fail_by_their_first_error(spark):
    rows = [
        ("12:00", "11:00", 91.0, "2030-01-01", 1, 0, "slot_order"), ("09:00", "10:00", 91.0, "bad", 0, 0, "lat_range"), ("09:00", "10:00", 37.0, "2030/01/01", 0, 0, "Date-001"),
        ("09:00", "10:00", 37.0, "2029-12-31", 1, 0, "Date-002"), ("09:00", "15:00", 37.0, "2030-01-01", 1, 0, "Hour-002"), ("9:00", "10:00", 37.0, "2030-01-02", 0, 0, "Room-003"),
        ("9:00", "10:00", 37.0, "2030-01-02", 3, 1, "Room-001"), ("13:00", "15:00", 37.0, "2030-01-01", 2, 0, None),
    ]
    df = spark.createDataFrame(rows, "a string, b string, lat double, date string, rooms int, bad int, want string")
    error = checks.request_error(checks.time_slots(F.col("a"), F.col("b")), (F.col("lat"), F.lit(126.0), F.lit(38.0), F.lit(127.0)), F.col("date"), F.col("rooms"), F.col("bad"), "2030-01-01", "2030-01-01 12:00")
    assert all(r.want == r.e for r in df.select("want", error.alias("e")).collect())


def test_responses_hold_rooms_and_summaries(spark):
    branches = spark.createDataFrame([("b", "house", 37.5, 127.0), ("c", None, None, 127.0)], "business_id string, name string, lat double, lng double")
    rooms = spark.createDataFrame([("b", "1", 4, 900, None), ("b", "2", 8, 700, ["i"]), ("c", "3", 9, 1, None)], "business_id string, biz_item_id string, max_capacity int, price_per_hour int, image_urls array<string>")
    slots = spark.createDataFrame([("b", i, 1, h, p, 1, int(p == 9)) for i in "12" for h in (9, 10) for p in (1, 2)] + [("b", "2", 1, 10, 9, 1, 1)], "business_id string, biz_item_id string, day int, hour int, pos int, unit_stock int, unit_booking_count int")
    box = (37.5, 127.0, 37.6, 127.1)
    requests = spark.createDataFrame([(i, 1, n, 9, e, *box) for i, n, e in ((1, 2, 9), (2, 2, 9), (3, 5, 10), (4, 2, 8))] + [(5, 1, 1, 9, 9, 38.0, 127.0, 37.0, 128.0)], "request_id int, day int, capacity int, start_hour int, end_hour int, sw_lat double, sw_lng double, ne_lat double, ne_lng double")
    joined = availability.rooms_with_branch(rooms, branches)
    assert {(r.biz_item_id, r.branch, tuple(r.image_urls)) for r in joined.collect()} == {("1", "house", ()), ("2", "house", ("i",)), ("3", "", ())}
    got = {r.request_id: r for r in availability.responses(requests, joined, branches, slots).collect()}
    assert got[1].available_biz_item_ids == got[2].available_biz_item_ids == ["1", "2"] and got[1].hour_slots == ["09:00"]
    assert {k: tuple(v) for k, v in got[2].branch_summary.items()} == {"b": (700, 2, 37.5, 127.0)}
    assert all((got[i].results, got[i].branch_summary) == ([], {}) for i in (3, 4, 5)) and got[3].hour_slots == ["09:00", "10:00"] and got[4].hour_slots == []


@pytest.mark.parametrize("name", ["jn2_box_search", "ag1_availability", "ag4_branch_summary"])
def test_pairs_of_requests_and_rooms_are_not_shuffled(spark, name):
    plan = market.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    after = plan[: plan.index("Exchange")]  # what comes behind the last shuffle
    assert "explode(ids" in after and "inline(rows" in after


def test_request_errors_meet_no_rooms(spark):
    plan = market.QUERIES["flt10_request_errors"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert not any("request_id" in line and "biz_item_id" in line for line in plan.splitlines())


def test_dealt_searches_equal_all_pairs(spark, monkeypatch):
    for limit, n in (("CHUNK", 2), ("IDS", 3), ("DEAL", 1)):
        monkeypatch.setattr(availability, limit, n)
    branches = [(f"b{i}", "n", 37.0 + i % 5 * 0.01, 127.0) for i in range(11)]
    rooms = [(b, f"{b}-{k}", k * 2, 10 - k) for b, *_ in branches for k in (1, 2, 3)]
    slots = [(b, i, 1, 9 + k % 2, k, 1, int(i.endswith("2"))) for b, i, *_ in rooms for k in range(3)]
    requests = [(i, 1, i % 5, 9, 9 + i % 3, 37.0, 127.0, 37.0 + i % 2 * 0.03, 127.0) for i in range(40)]
    tables = [
        spark.createDataFrame(requests, "request_id int, day int, capacity int, start_hour int, end_hour int, sw_lat double, sw_lng double, ne_lat double, ne_lng double"),
        availability.rooms_with_branch(spark.createDataFrame(rooms, "business_id string, biz_item_id string, max_capacity int, price_per_hour int"), spark.createDataFrame(branches, "business_id string, name string, lat double, lng double")),
        spark.createDataFrame(branches, "business_id string, name string, lat double, lng double"),
        spark.createDataFrame(slots, "business_id string, biz_item_id string, day int, hour int, pos int, unit_stock int, unit_booking_count int"),
    ]
    want = {
        (q[0], i): q[4] < 11 and not i.endswith("2")
        for q in requests for b, _, lat, _ in branches if lat <= q[7] for c, i, n, _ in rooms if c == b and n >= q[2]
    }
    assert sorted(tuple(r)[::2] for r in availability.matches(*tables[:3]).collect()) == sorted(want)
    got = availability.availability(*tables).collect()
    assert len(got) == len(want) and {(r.request_id, r.biz_item_id): r.available for r in got} == want
    summary = {(r.request_id, r.business_id): (r.min_price, r.available_count) for r in availability.request_summary(*tables).collect()}
    prices = {i: p for _, i, _, p in rooms}
    assert summary == {(q, b): (min(ps), len(ps)) for q in range(40) for b, *_ in branches if (ps := [prices[i] for (r, i), ok in want.items() if ok and r == q and i.startswith(f"{b}-")])}


@pytest.mark.parametrize("name", ["jn2_box_search", "ag1_availability", "ag4_branch_summary"])
def test_ids_are_the_inner_loop_of_pairs(spark, name):
    plan = market.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.index("explode(ids") < plan.index("inline(rows")  # the upper step comes later


def test_results_of_searches_are_not_shuffled(spark):
    plan = market.QUERIES["ag5_responses"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    after = plan[: plan.index("Exchange")]
    assert "explode(ids" in after and "collect_list(open" in after


def test_responses_in_slices_equal_a_plain_search(spark, monkeypatch):
    for limit, n in (("IDS", 5), ("CHUNK", 2), ("DEAL", 1), ("PAIRS", 8)):
        monkeypatch.setattr(availability, limit, n)
    branches = [(f"b{i}", f"n{i}", 37.0 + i % 5 * 0.01, 127.0) for i in range(11)]
    rooms = [(b, f"{b}-{k}", k * 2, 10 - k) for b, *_ in branches for k in (1, 2, 3)]
    slots = [(b, i, 1, 9, k, 1, int(i.endswith("2"))) for b, i, *_ in rooms for k in range(3)]
    box = lambda i: ((37.0, 127.0, 37.0 + i % 2 * 0.03, 127.0), (0.0, 0.0, 1.0, 1.0), (None, 127.0, 38.0, 128.0))[0 if i < 40 else i % 2 + 1]
    requests = [(i, None if i == 7 else 1, 3, 9, 9 + i % 2, *box(i)) for i in range(46)]
    branch = spark.createDataFrame(branches, "business_id string, name string, lat double, lng double")
    got = availability.responses(
        spark.createDataFrame(requests, "request_id int, day int, capacity int, start_hour int, end_hour int, sw_lat double, sw_lng double, ne_lat double, ne_lng double"),
        availability.rooms_with_branch(spark.createDataFrame(rooms, "business_id string, biz_item_id string, max_capacity int, price_per_hour int"), branch), branch,
        spark.createDataFrame(slots, "business_id string, biz_item_id string, day int, hour int, pos int, unit_stock int, unit_booking_count int"),
    ).collect()
    want = {q[0]: sorted(i for b, _, lat, _ in branches if q[0] < 40 and lat <= q[7] for c, i, n, _ in rooms if c == b and n >= 3 and i.endswith("3") and q[1] and q[4] == 9) for q in requests}
    assert len(got) == len(want) and {r.request_id: sorted(r.available_biz_item_ids) for r in got} == want
    assert all(r.results == sorted(r.results) and {x.business_id for x in r.results} == set(r.branch_summary) for r in got) and any(want.values())


def test_rows_that_tie_have_one_result(spark):
    rows = [("b", "1", 1, 9, 5, s, c) for s, c in ((3, 2), (1, 1), (2, 0))] + [("b", "1", 1, 9, 4, 9, 9)]
    kinds = "business_id string, biz_item_id string, day int, hour int, pos int, unit_stock int, unit_booking_count int"
    keys = ["business_id", "biz_item_id", "day", "hour"]
    for order in (rows, rows[::-1], rows[1:] + rows[:1]):
        df = spark.createDataFrame(order, kinds).coalesce(1)
        assert [tuple(r)[4:] for r in merge.last_wins(df, keys, ["pos"]).collect()] == [(5, 3, 2)]
        assert [tuple(r)[4:] for r in merge.first_wins(df.filter("pos = 5"), keys, ["pos"]).collect()] == [(5, 1, 1)]
        assert [r.slots for r in availability.slot_maps(df).collect()] == [{"09:00": True}]


@pytest.mark.parametrize("files", [1, 3])
@pytest.mark.parametrize("name", ["wn2_last_wins", "ag3_slot_maps"])
def test_rows_that_tie_equal_a_stable_sort(spark, tmp_path, name, files):
    """DuckDB's sort is stable with one thread; with several its choice among ties varies."""
    (tmp_path / "lineitem.parquet").mkdir()
    con = duckdb.connect(config={"threads": 1})
    rows = """SELECT i % 40 // 2 AS l_orderkey, i % 3 AS l_suppkey, 5 AS l_partkey, 1 AS l_linenumber, 12.0 * (i % 2) AS l_quantity,
      (i * 7 // 11 % 9) / 100.0 AS l_tax, (i * 5 // 13 % 11) / 100.0 AS l_discount, TIMESTAMP '2024-01-01' AS l_shipdate FROM range(600) t(i)"""
    for k in range(files):
        con.execute(f"COPY (SELECT * FROM ({rows}) WHERE {k} = l_orderkey % {files}) TO '{tmp_path}/lineitem.parquet/{k}.parquet'")
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    cursor = con.execute(market.ORACLE_SQL[name])
    columns = [c[0] for c in cursor.description]
    want = sorted(map(repr, cursor.fetchall()))
    assert sorted(repr(tuple(r[c] for c in columns)) for r in market.QUERIES[name](spark, str(tmp_path)).collect()) == want


def test_attributes_and_common_entities(spark):
    tag = """<a x='1' class="b c" CLASS='d' id=>"""
    row = spark.range(1).select(*(payloads.attribute(F.lit(tag), n, last).alias(f"{n}{last}") for n in ("class", "id", "z", "x") for last in (False, True))).first()
    assert list(row) == ["b c", "d", "", "", "", "", "1", "1"]
    parts = payloads.attribute(F.lit(tag), "class")._jc.toString()
    assert parts.count("regexp_extract_all") == 1  # the pairs are cut once
    texts = ["&amp;lt; &lt;b&gt; &quot;&apos;&#39;", "&nbsp;&lt", "a & b", "&eacute;&amp;"]
    df = spark.createDataFrame([(json.dumps({"items": t}),) for t in texts], "payload string")
    assert [r.html for r in payloads.label_pages(df).collect()] == [__import__("html").unescape(t) for t in texts]


def test_payloads_are_parsed_before_rows_are_multiplied(spark):
    plan = market.QUERIES["ud1_platform_slots"](spark, SF)._jdf.queryExecution().optimizedPlan().toString().splitlines()
    above = [line for i, line in enumerate(plan) if i < min(k for k, x in enumerate(plan) if "Generate explode" in x)]
    assert not any("from_json" in line for line in above)


def test_capacity_alone_equals_the_parsed_one(spark):
    df = spark.createDataFrame([(n, d) for n, d, _ in ROOMS], "name string, d string")
    both = df.select(text.max_capacity(F.col("name"), F.col("d")).alias("a"), text.parse_room(F.col("name"), F.col("d"))["max_capacity"].alias("b")).collect()
    assert all(r.a == r.b for r in both)
    plan = market.QUERIES["flt14_unresolved"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "clean_name" not in plan


def test_failures_of_single_rooms_and_reports(spark):
    rooms = spark.createDataFrame([("sadang", 1), ("x", 2), ("x", 3)], "business_id string, pos int")
    fail = F.when(F.col("pos") == 3, "Naver-001")
    out = collection.platform_results(rooms, {"naver": lambda df: df.withColumn("status", F.lit("free")).withColumn("error_code", fail)})
    assert {r.pos: (r.status, r.error_code) for r in out.collect()} == {1: (None, "COMMON-001"), 2: ("free", None), 3: (None, "Naver-001")}
    report = collection.error_report(out.withColumn("status_code", F.lit(503))).collect()
    assert {tuple(r) for r in report} == {("ERROR", 500, "COMMON-001", 1), ("WARNING", 503, "Naver-001", 1)}


def test_sources_and_sinks(spark, tmp_path):
    texts = spark.createDataFrame([("b", 1, "[x] 가", "d", 5, 2), ("b", 2, "나", None, None, None)], "business_id string, room_id long, name string, desc_text string, min_price int, image_count int")
    collection.save_samples(texts, str(tmp_path / "s"))
    room = json.loads(spark.read.text(str(tmp_path / "s")).first()[0])["rooms"][1]
    assert room == {"biz_item_id": 2, "raw_name": "나", "raw_desc": None, "min_price": None, "image_count": 0, "has_desc": False, "has_price": False, "name_has_tag": False}
    branch = spark.createDataFrame([("b", "n", 37.123456789)], "business_id string, name string, lat double")
    merge.write_snapshot(branch, str(tmp_path / "m" / "branch"))
    assert [str(x) for x in domain.read_master(spark, "branch", str(tmp_path / "m")).first()] == ["b", "n", "37.1234568", "None"]
    assert [tuple(r) for r in domain.search_queries(spark, 24, 26).collect()] == [(24, "중랑구 합주실"), (25, "부산 합주실")]
    log = spark.createDataFrame([(1, "t", "ERROR", "/ping"), (2, "t", "INFO", None), (3, "u", "ERROR", "/a")], "pos int, trace_id string, level string, path string")
    assert [r.pos for r in collection.log_search(log, level="ERROR").collect()] == [3] and [r.pos for r in collection.log_search(log, trace_id="t").collect()] == [2]


def test_capacity_guesses(spark):
    rows = [(1, 100, 4), (2, 150, None), (3, 200, 8), (4, 300, None), (5, None, None), (6, 200, None)]
    df = spark.createDataFrame([("b", *r) for r in rows], "business_id string, room_id int, price int, max_capacity int")
    assert {r.room_id: r.guess for r in collection.capacity_from_price(df).collect()} == {1: 4, 2: 6, 3: 8, 4: None, 5: None, 6: None}


def test_streams_equal_batches(spark, tmp_path):
    log = spark.range(60).selectExpr("cast(id % 3 as string) as ip", "timestamp'2024-01-01 00:00:00' + make_interval(0,0,0,0,0,0,id * 4) as ts")
    log.write.parquet(str(tmp_path / "log"))
    log.limit(1).selectExpr("'z' as ip", "ts + interval 1 day as ts").write.mode("append").parquet(str(tmp_path / "log"))
    stream = jobs.rate_breaches(spark.readStream.schema(log.schema).parquet(str(tmp_path / "log")))
    q = stream.writeStream.outputMode("append").format("memory").queryName("breaches").trigger(availableNow=True).start()
    q.awaitTermination()
    batch = jobs.rate_breaches(spark.read.parquet(str(tmp_path / "log")))
    assert sorted(map(tuple, spark.table("breaches").collect())) == sorted(map(tuple, batch.filter("ip <> 'z'").collect()))
    (tmp_path / "text").mkdir()
    lines = spark.createDataFrame([("token=abc",), ("plain",)], "body string")
    lines.write.mode("append").parquet(str(tmp_path / "text"))
    q = jobs.masked_log(spark.readStream.schema(lines.schema).parquet(str(tmp_path / "text"))).writeStream.format("memory").queryName("masked").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r.body for r in spark.table("masked").collect()) == ["plain", "token=***"]


def test_favorites_stream(spark, tmp_path):
    kinds = "device_id string, business_id string, biz_item_id string, op string, seq long"
    source, target = str(tmp_path / "changes"), str(tmp_path / "favorites")

    def play(rows, checkpoint):
        spark.createDataFrame(rows, kinds).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(kinds).parquet(source).writeStream.foreachBatch(jobs.favorites_into(target))
        stream.option("checkpointLocation", str(tmp_path / checkpoint)).trigger(availableNow=True).start().awaitTermination()
        return sorted(tuple(r) for r in jobs.favorites_now(spark, target).collect())

    assert jobs.favorites_now(spark, target).count() == 0
    assert play([("d", "b", "i", "add", 1), ("d", "b", "i", "add", 2), ("d", "b", "j", "delete", 3)], "one") == [("d", "b", "i")]
    assert play([("d", "b", "i", "delete", 4), ("e", "b", "i", "add", 5)], "one") == [("e", "b", "i")]
    # A new checkpoint reads all changes again, and forgets nothing.
    assert play([("f", "b", "i", "add", 6), ("e", "b", "i", "delete", 1)], "two") == [("e", "b", "i"), ("f", "b", "i")]


def test_export_adds_once_a_day(spark, tmp_path):
    folder = str(tmp_path / "unresolved")
    schema = "business_id string, biz_item_id string, max_capacity int"
    first = spark.createDataFrame([("b", "1", None), ("b", "2", 100), ("b", "3", 4)], schema)
    collection.export_unresolved(first, folder, "2024-06-15")
    collection.export_unresolved(first.unionByName(spark.createDataFrame([("b", "4", None)], schema)), folder, "2024-06-15")
    collection.export_unresolved(first, folder, "2024-06-16")
    got = spark.read.json(folder).select("export_date", "biz_item_id", "failure_reason").collect()
    day = lambda d: {(d, "1", "no_capacity_info"), (d, "2", "manual_review_flag")}
    assert len(got) == 5
    assert {(int(r[0]), r[1], r[2]) for r in got} == day(20240615) | {(20240615, "4", "no_capacity_info")} | day(20240616)


def test_flags_of_texts(spark):
    df = spark.createDataFrame([("최대 10인", 1, 15001), ("4~6인", 20, 9999), ("넓은 방", 1, 15000), (None, 20, 10000)], "t string, n int, p int")
    got = df.select(text.needs_model(F.col("t")).alias("m"), checks.suspicious(F.col("n"), F.col("p")).alias("s")).collect()
    assert [tuple(r) for r in got] == [(False, True), (False, True), (True, False), (True, False)]


def plain(v):
    if v is None or isinstance(v, (bool, str)):
        return v
    return v.isoformat() if hasattr(v, "isoformat") else round(float(v), 6)


@pytest.mark.parametrize("name", sorted(market.ORACLE_SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("supplier", "lineitem", "orders", "part", "events", "documents"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = market.QUERIES[name](spark, SF)
    cursor = con.execute(market.ORACLE_SQL[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    key = lambda r: repr(r)
    want = sorted((tuple(map(plain, r)) for r in cursor.fetchall()), key=key)
    assert sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=key) == want


def test_entry(spark):
    assert entry.entry(spark).columns == ["request_id", "business_id", "min_price", "available_count", "lat", "lng"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
