"""Master versions, streams with restarts, searches over crowded places, ranks and other work on whole tables."""

import json
import random
import re
import time
from html.parser import HTMLParser

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from roomloom.functions import masking, text
from roomloom.operators import collection, extractors, master, merge, metrics, quadtree, ranking, references, run
from roomloom.plans import keeping
from roomloom.sources import domain, folders, payloads
from roomloom.streaming import jobs

ROOM = "business_id string, biz_item_id string, max_capacity int, recommend_capacity int, price_per_hour int, name string"
KEYS = ["business_id", "biz_item_id"]


def rooms(spark, rows):
    return spark.createDataFrame([(b, i, m, 1, p, n) for b, i, m, p, n in rows], ROOM)


def files(df):
    return {r[0] for r in df.select(F.input_file_name()).distinct().collect()}


def values(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# ---------------------------------------------------------------- master tables
def test_upserts_rewrite_only_what_they_touch(spark, tmp_path):
    folder = str(tmp_path / "rooms")
    first = rooms(spark, [(f"b{i % 9}", str(i), 5, 100, "old") for i in range(300)] + [("hot", str(i), 5, 100, "old") for i in range(300)])
    master.create_master(first, folder, KEYS, buckets=16)
    before = files(master.read_version(spark, folder))
    news = rooms(spark, [("hot", "7", 1, 0, "new"), ("hot", "new", 9, 5, "new")])
    assert master.upsert_into(spark, folder, news, merge.merge_rooms) == 1
    now = master.read_version(spark, folder)
    assert values(now) == values(merge.merge_rooms(first, news))
    assert len(before - files(now)) <= 2 and len(before & files(now)) >= 14  # a hot business lies in all buckets
    assert master.upsert_into(spark, folder, news.limit(0), merge.merge_rooms) == 1  # nothing came


def test_a_killed_run_leaves_the_old_version(spark, tmp_path, monkeypatch):
    folder = str(tmp_path / "rooms")
    first = rooms(spark, [("b", str(i), 5, 100, "old") for i in range(50)])
    master.create_master(first, folder, KEYS, buckets=4)
    news = rooms(spark, [("b", "3", 9, 5, "new")])

    def killed(*_):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(master, "publish", killed)
        with pytest.raises(KeyboardInterrupt):
            master.upsert_into(spark, folder, news, merge.merge_rooms)
    assert values(master.read_version(spark, folder)) == values(first)
    master.upsert_into(spark, folder, news, merge.merge_rooms)
    assert values(master.read_version(spark, folder)) == values(merge.merge_rooms(first, news))


def test_master_deletes_and_edges(spark, tmp_path):
    folder = str(tmp_path / "rooms")
    table = rooms(spark, [("b", "1", 5, 1, "x"), ("b", None, 5, 1, "x"), ("c", "1", 5, 1, "x")])
    master.create_master(table.limit(0), folder, KEYS, buckets=3)
    assert master.read_version(spark, folder).count() == 0
    master.upsert_into(spark, folder, table, lambda old, new: merge.upsert(old, new, KEYS))
    master.delete_from(spark, folder, table.filter("biz_item_id is null"))
    assert values(master.read_version(spark, folder)) == values(table.filter("biz_item_id is not null"))
    master.delete_from(spark, folder, table)
    assert master.read_version(spark, folder).count() == 0
    with pytest.raises(ValueError, match="no master table"):
        master.read_version(spark, str(tmp_path / "none"))


def test_two_writers_do_not_both_publish(spark, tmp_path):
    folder = str(tmp_path / "p")
    folders.publish(spark, folder, 0, {"a": 1})
    with pytest.raises(Exception, match="(?i)already exists"):
        folders.publish(spark, folder, 0, {"a": 2})
    assert folders.latest(spark, folder) == (0, {"a": 1})
    spark.createDataFrame([('{"a": 3}',)], "state string").coalesce(1).write.mode("append").json(f"{folder}/pointer/number=0")
    with pytest.raises(RuntimeError, match="two writers"):
        folders.latest(spark, folder)


# ---------------------------------------------------------------- a collection run
def payload_of(business, rooms):
    at = None if business == "b" else {"coordinates": [127.0, 37.5]}
    about = {"data": {"business": {"businessId": business, "businessDisplayName": f"name {business}", **(at or {})}}}
    items = [{"bizItemId": i, "name": n, "desc": d, **({"minMaxPrice": {"minPrice": p}} if p else {})} for i, n, d, p in rooms]
    return json.dumps(about), json.dumps({"data": {"bizItems": items}})


def test_a_collection_run_saves_exports_and_reports(spark, tmp_path):
    folder = str(tmp_path)
    kinds = "business_id string, pos int, business string, rooms string"
    found = spark.createDataFrame([("q", b) for b in "abcde"] + [("r", "a"), ("q", "a")], "query string, business_id string")
    first = [("a", 1, *payload_of("a", [("1", "방", "최대 8인", 100)])), ("a", 2, *payload_of("a", [("1", "방", "최대 9인", 100), ("2", "넓은 방", None, None)])),
             ("b", 1, *payload_of("b", [("3", "방 (-5명)", None, 7)])), ("c", 1, "not json", "{}"), ("d", 1, *payload_of("d", [])), ("z", 1, *payload_of("z", [("9", "x", None, 1)]))]
    report = run.collect(found, spark.createDataFrame(first, kinds), folder, "2024-06-15", buckets=4)
    assert {(r["query"], r.success, r.failed) for r in report.collect()} == {("q", 3, 2), ("r", 1, 0)}  # e was not captured
    read = lambda name: master.read_version(spark, f"{folder}/{name}")
    assert {(r.business_id, r.lat) for r in read("branch").collect()} == {("a", 37.5), ("b", None)}  # d has no rooms, z was not found
    assert {(r.biz_item_id, r.max_capacity, r.price_per_hour) for r in read("room").collect()} == {("1", 9, 100), ("2", 100, None), ("3", 5, 7)}
    said = spark.createDataFrame([("a", "2", ("n", None, 30, 20, None, None, None), True), ("a", "1", ("n", None, 40, 20, None, None, None), False)],
                                 "business_id string, biz_item_id string, answer struct<clean_name:string,day_type:string,max_capacity:int,recommend_capacity:int,base_capacity:int,extra_charge:int,requires_call:boolean>, usable boolean")
    second = [("a", 5, *payload_of("a", [("1", "방", None, None), ("2", "넓은 방", None, None)]))]
    run.collect(found, spark.createDataFrame(second, kinds), folder, "2024-06-16", said, buckets=4)
    assert {(r.biz_item_id, r.max_capacity, r.price_per_hour) for r in read("room").collect()} == {("1", 9, 100), ("2", 30, None), ("3", 5, 7)}
    listed = spark.read.schema("biz_item_id string, failure_reason string, export_date string").json(f"{folder}/unresolved")
    assert values(listed) == [("1", "no_capacity_info", "20240616"), ("2", "no_capacity_info", "20240615")]


# ---------------------------------------------------------------- favorites
def favorites(rows):
    left = {}
    for d, b, i, op, seq in sorted(rows, key=lambda r: r[4]):
        left[(d, b, i)] = op
    return sorted(k for k, op in left.items() if op == "add")


def test_favorites_read_no_more_than_two_epochs(spark, tmp_path):
    rng, target, rows = random.Random(1), str(tmp_path / "f"), []
    step = jobs.favorites_into(target, every=3)
    for number in range(11):
        batch = [(f"d{rng.randrange(4)}", "b", f"i{rng.randrange(5)}", rng.choice(("add", "delete")), number * 100 + k) for k in range(6)]
        rows += batch
        step(spark.createDataFrame(batch, jobs._CHANGES), number)
        assert values(jobs.favorites_now(spark, target)) == favorites(rows)
    read = {re.sub(r".*/f/", "", f).rsplit("/", 1)[0] for f in jobs._changes(spark, target).inputFiles()}
    assert sum(r.startswith("snapshots") for r in read) == 1 and sum(r.startswith("changes") for r in read) <= 6
    step(spark.createDataFrame(rows[-6:], jobs._CHANGES), 10)  # a batch that runs again
    step(spark.createDataFrame(rows[:6], jobs._CHANGES), 0)  # another query reads from the start
    assert values(jobs.favorites_now(spark, target)) == favorites(rows)


def test_a_killed_snapshot_leaves_all_changes(spark, tmp_path, monkeypatch):
    target = str(tmp_path / "f")
    step = jobs.favorites_into(target, every=2)
    one, two = [("d", "b", "1", "add", 1)], [("d", "b", "1", "delete", 2), ("d", "b", "2", "add", 3)]
    step(spark.createDataFrame(one, jobs._CHANGES), 0)

    def killed(*_):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(jobs, "publish", killed)
        with pytest.raises(KeyboardInterrupt):
            step(spark.createDataFrame(two, jobs._CHANGES), 1)
    assert values(jobs.favorites_now(spark, target)) == [("d", "b", "2")]
    step(spark.createDataFrame(two, jobs._CHANGES), 1)
    assert values(jobs.favorites_now(spark, target)) == [("d", "b", "2")] and folders.latest(spark, target)[0] == 0


# ---------------------------------------------------------------- other streams
def play(stream, **options):
    for k, v in options.items():
        stream = stream.option(k, v)
    query = stream.trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def test_redelivered_and_late_records(spark, tmp_path):
    source, out, checkpoint = (str(tmp_path / n) for n in ("log", "out", "c"))
    kinds = "ip string, ts timestamp, pos long"
    row = lambda i, minute, second, ip="a": (ip, f"2024-01-01 00:{minute:02}:{second:02}", i)

    def add(rows):
        spark.createDataFrame(rows, "ip string, t string, pos long").selectExpr("ip", "cast(t as timestamp) as ts", "pos").coalesce(1).write.mode("append").parquet(source)
        stream = jobs.rate_breaches(jobs.counted(spark.readStream.schema(kinds).parquet(source)), 2, record_id="pos")
        return play(stream.writeStream.outputMode("append"), path=out, checkpointLocation=checkpoint)

    first = [row(i, 0, i) for i in range(3)]
    query = add(first + first)  # every record twice
    assert query.lastProgress is None or jobs.late_rows(query) == 0
    add([first[0], row(10, 9, 0)])  # once more, and a minute that closes the first window
    late = add([row(11, 0, 30), row(12, 0, 31), row(13, 20, 0)])  # after the window has closed
    assert jobs.late_rows(late) >= 2
    assert [(r.ip, r.n) for r in spark.read.schema("ip string, start timestamp, n long").parquet(out).collect()] == [("a", 3)]
    batch = jobs.rate_breaches(spark.read.schema(kinds).parquet(source).filter("pos < 10"), 2, record_id="pos")
    assert [(r.ip, r.n) for r in batch.collect()] == [("a", 3)]


def test_log_sink_writes_each_line_once(spark, tmp_path):
    source, out, checkpoint = (str(tmp_path / n) for n in ("log", "out", "c"))
    kinds = "pos long, ts timestamp, level string, logger string, trace_id string, body string, extras string"

    def add(first, n):
        df = spark.range(first, first + n).selectExpr("id as pos", "timestamp'2024-01-01' + make_dt_interval(cast(id as int)) as ts", "'INFO' as level", "'l' as logger", "cast(null as string) as trace_id",
                                                      "concat('line ', id, ' token=abc') as body", "cast(null as string) as extras")
        df.coalesce(1).write.mode("append").parquet(source)

    def run():
        return play(jobs.log_sink(spark.readStream.schema(kinds).option("maxFilesPerTrigger", 1).parquet(source), out, checkpoint, "body", "extras"))

    add(0, 3)
    add(3, 2)
    run()
    add(5, 4)
    run()
    # Killed after the files were written, before the batch was noted as done.
    last = max((tmp_path / "c" / "commits").glob("[0-9]*"), key=lambda p: int(p.name))
    last.unlink()
    (last.parent / f".{last.name}.crc").unlink(missing_ok=True)
    run()
    lines = sorted(r.value for r in spark.read.text(out).collect())
    assert len(lines) == 9 and all(f'"message":"line {i} token=***"' in lines[i] for i in range(9))
    assert {r.day for r in spark.read.text(out).select("day").distinct().collect()} == {20240101 + i for i in range(9)}


# ---------------------------------------------------------------- boxes
BOXES = "box int, sw_lat double, sw_lng double, ne_lat double, ne_lng double"


def brute(boxes, points):
    return sorted((b[0], p[0]) for b in boxes for p in points if None not in (*b[1:], *p[1:]) and b[1] <= p[1] <= b[3] and b[2] <= p[2] <= b[4])


@pytest.mark.parametrize("leaf_points, leaf_boxes", [(64, 4096), (2, 3)])
def test_points_in_boxes_equal_all_pairs(spark, leaf_points, leaf_boxes):
    rng = random.Random(7)
    points = [(i, rng.uniform(37, 38), rng.uniform(126, 128)) for i in range(150)] + [(i, 37.5, 127.0) for i in range(200, 260)]
    points += [(900, None, 127.0), (901, 37.5, None), (902, float("nan"), 127.0), (903, 90.0, 180.0), (904, -90.0, -180.0)]
    boxes = []
    for i in range(60):
        y, x, h = rng.uniform(36.9, 38), rng.uniform(125.9, 128), rng.choice([0.0, 0.001, 0.05, 0.5, 60])
        boxes.append((i, y, x, y + h, x + h))
    boxes += [(90, 37.5, 127.0, 37.5, 127.0), (91, -90.0, -180.0, 90.0, 180.0), (92, 38.0, 127.0, 37.0, 128.0), (93, None, 1.0, 2.0, 3.0), (94, float("nan"), 126.0, 38.0, 128.0), (90, 37.5, 127.0, 37.5, 127.0)]
    found = quadtree.points_in_boxes(spark.createDataFrame(boxes, BOXES), spark.createDataFrame(points, "id int, lat double, lng double"), leaf_points, leaf_boxes)
    assert sorted((r.box, r.id) for r in found.collect()) == brute(boxes, points)


def test_leaves_bound_points_until_they_share_a_place(spark):
    rng = random.Random(8)
    points = spark.createDataFrame([(rng.gauss(37.5, 0.01), rng.gauss(127, 0.01)) for _ in range(3000)] + [(37.5, 127.0)] * 500, "lat double, lng double")
    placed = points.withColumns({"y": quadtree._index("lat", -90, 180), "x": quadtree._index("lng", -180, 360)})
    tree = quadtree.leaves(placed, 50).collect()
    assert sum(r.n for r in tree) == 3500
    assert all(r.n <= 50 for r in tree if r.level < quadtree.DEPTH) and len([r for r in tree if r.n > 50]) == 1


def test_no_points_or_boxes(spark):
    points, boxes = spark.createDataFrame([(1, 37.5, 127.0)], "id int, lat double, lng double"), spark.createDataFrame([(1, 37.0, 126.0, 38.0, 128.0)], BOXES)
    assert quadtree.points_in_boxes(boxes, points).count() == 1
    assert quadtree.points_in_boxes(boxes.limit(0), points).count() == quadtree.points_in_boxes(boxes, points.limit(0)).count() == 0


# ---------------------------------------------------------------- ranks and guesses
def test_one_key_is_numbered_by_many_tasks(spark):
    rows = [("hot", (i * 7919) % 20_000) for i in range(20_000)] + [(f"k{i % 5}", i) for i in range(50)] + [(None, i) for i in range(10)]
    df = spark.createDataFrame(rows, "k string, v int").repartition(5)
    got = ranking.numbered_by_ranges(df, ["k"], ["v"], "place", parts=6)
    places = {(r.k, r.v): r.place for r in got.collect()}
    assert len(places) == len(rows)
    for key in {k for k, _ in rows}:
        assert [places[(key, v)] for v in sorted(v for k, v in rows if k == key)] == list(range(1, 1 + sum(k == key for k, _ in rows)))
    ranges = df.repartitionByRange(6, "k", "v").filter("k = 'hot'").groupBy(F.spark_partition_id()).count().count()
    assert ranges > 1
    same = ranking.numbered(df, ["k"], ["v"], "place", window_rows=100)
    assert values(same.select("k", "v", "place")) == values(ranking.numbered(df, ["k"], ["v"], "place").select("k", "v", "place"))
    assert ranking.numbered(df.limit(0), ["k"], ["v"], "place").count() == ranking.numbered_by_ranges(df.limit(0), ["k"], ["v"], "place").count() == 0


def test_first_pages_limit_a_key_before_the_shuffle(spark):
    df = spark.range(4000).selectExpr("cast(id % 2 as string) as query", "id as pos")
    pages = collection.first_pages(df, "query", "pos", pages=2, size=70)
    assert {r.page: r["count"] for r in pages.groupBy("page").count().collect()} == {1: 140, 2: 140}
    assert "WindowGroupLimit" in pages._jdf.queryExecution().executedPlan().toString()


def test_guesses_for_a_large_business(spark):
    known = F.when(F.col("id") % 10 == 0, (F.col("id") / 1000).cast("int"))
    df = spark.range(100_000).select(F.lit("b").alias("business_id"), F.col("id").alias("room_id"), F.col("id").cast("int").alias("price"), known.alias("max_capacity"))
    began = time.time()
    guesses = {r.room_id: r.guess for r in collection.capacity_from_price(df).collect()}
    assert time.time() - began < 30 and guesses[12345] == 12 and guesses[99_999] is None and len(guesses) == 100_000


# ---------------------------------------------------------------- markup
class Tags(HTMLParser):
    def __init__(self, markup):
        super().__init__(convert_charrefs=False)
        self.found = []
        self.feed(markup)

    def handle_starttag(self, tag, attrs):
        self.found.append((tag, attrs))

    handle_startendtag = handle_starttag


MARKUP = [
    '<label title="a 14시00분" class="time active">',
    '<label title="a > 14시00분" class="active">',
    "<LABEL CLASS=active TITLE=14시00분>",
    "<label class = 'x active' title = '14시00분'/>",
    '<!-- <label title="14시00분" class="active"> --><label title="14시00분" class="time">',
    '<!-- never closed <label title="14시00분" class="active">',
    '<script>var s = \'<label title="14시00분" class="active">\';</script><label title="14시00분">',
    '<script src="a>b">x</scripts><label title="14시00분" class="active"></script>',
    '<style><label title="14시00분" class="active"></style>',
    '<label data-title="14시00분" class="active"><labels title="14시00분" class="active">',
    '<label title="15시00분" class="active"><label title="14시00분" class="inactive">',
    '<label title="14시00분" class="active"',
    "<label\ntitle='14시00분'\n\tclass='a\nactive b' checked>",
    '< label title="14시00분" class="active">',
    '<label title class="active" title="14시00분">',
    "",
    "<" * 200 + ">",
    '<label title="14시00분" ' + " ".join(f'a{i}="{i}"' for i in range(300)) + ' class="active">',
]


def test_labels_equal_an_independent_parser(spark):
    def free(markup):
        for tag, attrs in Tags(markup).found:
            own = dict(reversed(attrs))  # the first of repeated ones
            if tag == "label" and "14시00분" in (own.get("title") or ""):
                return "active" in (own.get("class") or "").split()
        return False

    df = spark.createDataFrame([(m,) for m in MARKUP], "m string").select("m", payloads.label_free(F.col("m"), F.lit(14)).alias("f"))
    for r in df.collect():
        assert r.f == free(r.m), r.m


def test_cells_equal_an_independent_parser(spark):
    cells = ['<td id="reserve_time_7_9" class="x reserve_time_off">', "<td class=reserve_time_off id=reserve_time_7_9>", '<!--<td id="reserve_time_7_9" class="reserve_time_off">-->', '<td id="reserve_time_7_9" class="on"><i id="reserve_time_7_9" class="reserve_time_off">',
             '<td title="id=reserve_time_7_9" class="reserve_time_off">', '<td id="reserve_time_7_99" class="reserve_time_off">', '<td id="reserve_time_7_9" class="reserve_time_offer">', '<td id="a" id="reserve_time_7_9" class="reserve_time_off">']

    def free(markup):
        return any(dict(a).get("id") == "reserve_time_7_9" and "reserve_time_off" in (dict(a).get("class") or "").split() for _, a in Tags(markup).found)

    df = spark.createDataFrame([(m,) for m in cells], "m string").select("m", payloads.cell_free(F.col("m"), F.lit("7"), F.lit(9)).alias("f"))
    for r in df.collect():
        assert r.f == free(r.m), r.m


# ---------------------------------------------------------------- texts
def test_all_kinds_of_white_space_and_digits(spark):
    rows = [
        ("룸１ (정원　4명)", "최대\xa010인", "룸１", 10, None),
        ("A (정원　4명,\xa0최대 6명)", "", "A", 6, 4),
        ("B (-\xa0７명)　", None, "B", 7, None),
        ("C", "기본　３인, 1인\xa0추가 ２,０００　원", "C", None, None),
        ("D", "４～5인 4\x1c~\x1d６명", "D", 6, 5),
        ("[평일]　E", "mAx ９", "E", 9, None),
    ]
    df = spark.createDataFrame([r[:2] for r in rows], "n string, d string").select("n", text.parse_room(F.col("n"), F.col("d")).alias("p"))
    got = {r.n: r.p for r in df.collect()}
    for name, _, clean, most, rec in rows:
        assert (got[name].clean_name, got[name].max_capacity) == (clean, most), name
        assert rec is None or got[name].recommend_capacity == rec
    assert (got["C"].base_capacity, got["C"].extra_charge) == (3, 2000)
    secrets = ["password\xa0: abc", "Authorization　: x; y", "token =　'a b'", "api_key=a　b"]
    masked = [r.m for r in spark.createDataFrame([(s,) for s in secrets], "s string").select(masking.mask_text(F.col("s")).alias("m")).collect()]
    assert masked == ["password\xa0: ***", "Authorization: ***; y", "token =　'***'", "api_key=***　b"]


# ---------------------------------------------------------------- extractors, references, metrics, JDBC
def test_one_failing_room_leaves_the_others(spark):
    def read(body):
        if body == "known":
            raise collection.ExtractionError("Dream-001", "shut")
        yield "09:00", True
        if body == "late":
            raise RuntimeError("half way")
        yield "10:00", int(body) > 1

    df = spark.createDataFrame([("a", "1"), ("b", "known"), ("c", "late"), ("d", "x"), ("e", None), ("f", "2")], "id string, payload string")
    got = {(r.id, r.hour, r.status, r.error_code) for r in collection.isolated(read)(df).collect()}
    assert got == {("a", "09:00", "free", None), ("a", "10:00", "taken", None), ("b", None, None, "Dream-001"), ("c", None, None, "COMMON-001"), ("d", None, None, "COMMON-001"),
                   ("e", None, None, "COMMON-001"), ("f", "09:00", "free", None), ("f", "10:00", "free", None)}
    none = collection.isolated(lambda body: [])(df.filter("id = 'a'")).collect()
    assert [(r.id, r.hour, r.error_code) for r in none] == [("a", None, None)]
    rooms_of = df.select(F.lit("sadang").alias("business_id"), "id", "payload")
    out = collection.platform_results(rooms_of, {})
    assert {r.error_code for r in out.collect()} == {"COMMON-001"}


def test_extractors_of_the_platforms(spark):
    def schedule(*entries):
        return json.dumps({"data": {"schedule": {"bizItemSchedule": {"hourly": [dict(zip(("unitStartTime", "unitStock", "unitBookingCount"), e)) for e in entries]}}}})

    label = lambda h, mark: f"&lt;label title=&quot;{h}시00분&quot; class=&quot;{mark}&quot;&gt;"
    page = json.dumps({"items": label("09", "active") + label("10", "x") + label("10", "active")})
    cells = '<i id="reserve_time_7_9" class="reserve_time_off"><i id="reserve_time_8_10" class="reserve_time_off">'
    both = ["09:00", "10:00"]
    rows = [
        ("n", "1", "2030-01-01", both, schedule(("2030-01-01 09:00:00", 1, 1), ("2030-01-01T09:00:00", 2, 1)), {("09:00", "free", None), ("10:00", "taken", None)}),
        ("n", "2", "2030-01-01", both, schedule(("x 11:00:00", None, 1), (None, 1, 1)), {(None, None, "CRAWLER-002")}),
        ("n", "3", "2030-01-01", both, schedule(("x 11:00:00", None, 1)), {("09:00", "taken", None), ("10:00", "taken", None)}),
        ("n", "4", "2030-01-01", both, schedule(("x 10:00:00", None, 1)), {(None, None, "CRAWLER-002")}),
        ("n", "5", "2030-01-01", both, "[]", {(None, None, "CRAWLER-002")}),
        ("n", "6", "2030-01-01", both, "{}", {("09:00", "taken", None), ("10:00", "taken", None)}),
        ("n", "7", "2030-01-01", [], "{}", {(None, None, None)}),
        ("dream_sadang", "1", "2030-01-01", both, page, {("09:00", "free", None), ("10:00", "taken", None)}),
        ("hongdae_dream", "1", "2030-06-01", both, None, {("09:00", "unknown", None), ("10:00", "unknown", None)}),
        ("hongdae_dream", "2", "2030-01-01", both, None, {(None, None, "CRAWLER-002")}),
        ("sadang", "7", "2030-01-01", both, cells, {("09:00", "free", None), ("10:00", "taken", None)}),
        ("sadang", "8", "2030-01-01", both, None, {(None, None, "CRAWLER-003")}),
    ]
    df = spark.createDataFrame([r[:5] for r in rows], "business_id string, biz_item_id string, day string, hour_slots array<string>, payload string").withColumn("day", F.col("day").cast("date"))
    found = {}
    for r in collection.platform_results(df, extractors.registry("2030-01-01")).collect():
        found.setdefault((r.business_id, r.biz_item_id), set()).add((r.hour, r.status, r.error_code))
    for business, item, *_, want in rows:
        assert found[business, item] == want, (business, item)


def test_cascade_reaches_images(spark):
    branch = spark.createDataFrame([("a",), ("b",)], "business_id string")
    room = spark.createDataFrame([("a", "1"), ("b", "1"), ("b", "2"), ("c", "1"), (None, "9")], "business_id string, biz_item_id string")
    image = spark.createDataFrame([(1, "a", "1"), (2, "b", "1"), (3, "b", "2"), (4, "c", "1"), (5, "b", None)], "image_id long, business_id string, biz_item_id string")
    tables = {"branch": branch, "room": room, "room_image": image}
    lost = references.orphans(tables)
    assert values(lost["room"]) == [("c", "1")] and values(lost["room_image"]) == []
    stays, gone = references.cascade(tables, {"branch": branch.filter("business_id = 'a'"), "room": room.filter("biz_item_id = '2'").select("business_id", "biz_item_id")})
    assert [r.image_id for r in stays["room_image"].orderBy("image_id").collect()] == [2, 4, 5] and stays["branch"].count() == 1
    assert values(stays["room"]) == sorted([("b", "1"), ("c", "1"), (None, "9")], key=repr)
    assert sorted(r.image_id for r in gone["room_image"].collect()) == [1, 3]


def test_metrics_come_from_the_scan_that_writes(spark, tmp_path):
    df = rooms(spark, [("b", str(i), i % 20, 100 * i - 100, "x") for i in range(200)])
    df.write.parquet(str(tmp_path / "in"))
    seen = Observation()
    observed = metrics.observed(spark.read.parquet(str(tmp_path / "in")), seen, quantiles=True)
    assert observed._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1
    observed.write.parquet(str(tmp_path / "out"))
    row = metrics.observed_row(df, seen, quantiles=True).first()
    assert row == df.agg(*metrics.room_metrics(quantiles=True)).first()
    assert (row.rooms, row.bad_price, row.bad_max, row.price_quartiles[1]) == (200, 1, 10, 9800)


def test_master_over_jdbc_in_ranges_with_pushed_filters(spark, tmp_path):
    jdbc = {"url": f"jdbc:derby:{tmp_path}/db;create=true", "driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    branch = spark.range(500).selectExpr("concat('b', id) as business_id", "concat('n''', id) as name", "37.0 + id / 1000.0d as lat", "127.0d as lng")
    image = spark.range(1000).selectExpr("id as image_id", "'b' as business_id", "'1' as biz_item_id", "'u' as image_url", "cast(0 as int) as sort_order")
    types = "business_id VARCHAR(50), name VARCHAR(50), biz_item_id VARCHAR(50), image_url VARCHAR(50)"
    for name, df in (("branch", branch), ("room_image", image)):
        kinds = ", ".join(t for t in types.split(", ") if t.split(" ")[0] in df.columns)
        df.coalesce(1).write.format("jdbc").options(dbtable=name, createTableColumnTypes=kinds, **jdbc).save()
    whole = domain.read_master(spark, "branch", jdbc=jdbc, parts=4)
    assert whole.rdd.getNumPartitions() >= 4
    assert values(whole) == values(domain.read_master(spark, "branch", jdbc=jdbc)) and whole.count() == 500
    sizes = [r["count"] for r in whole.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) >= 4 and max(sizes) <= 130
    images = domain.read_master(spark, "room_image", jdbc=jdbc, parts=3)
    assert images.count() == images.select("image_id").distinct().count() == 1000
    some = domain.read_master(spark, "branch", jdbc=jdbc, parts=4, box=(37.1, 126.0, 37.2, 128.0))
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and re.search(r"GreaterThanOrEqual\(lat,37\.1\)|\(LAT >= 37\.1", plan, re.I)
    assert some.count() == 101
    branch.write.parquet(str(tmp_path / "files" / "branch"))
    assert domain.read_master(spark, "branch", str(tmp_path / "files"), box=(37.1, 126.0, 37.2, 128.0)).count() == 101


def test_large_streams_have_several_files_a_batch(spark, monkeypatch):
    monkeypatch.setattr(keeping, "_FILE_ROWS", 20)
    stream = keeping._stream(spark, spark.range(300), 3, "id")
    out = folders.new_folder(spark)
    sizes = []
    stream.writeStream.foreachBatch(lambda b, _: sizes.append((b.count(), b.select(F.input_file_name()).distinct().count()))).option("checkpointLocation", out).trigger(availableNow=True).start().awaitTermination()
    assert sum(n for n, _ in sizes) == 300 and [k for _, k in sizes] == [5, 5, 5]
