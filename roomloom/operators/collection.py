"""Steps of a collection run: batches, prompts, model answers, platforms and exports."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import masking, text
from .availability import PLATFORMS, platform
from .merge import unresolved_reason
from .ranking import first_rows, numbered

#: Fixed value: what a prompt says of a room without a description.
NO_CONTENT = "내용 없음"
#: Fixed value: the code of an error that has none of its own.
UNCODED = "COMMON-001"

Extractor = Callable[[DataFrame], DataFrame]


def union_pages(pages: list[DataFrame]) -> DataFrame:
    """All pages of all searches as one table, by column names."""
    return reduce(DataFrame.unionByName, pages)


def batched(items: DataFrame, key: str, order: str, size: int = 5) -> DataFrame:
    """``items`` with ``batch``, counted from 0 within a key."""
    placed = numbered(items, [key], [order], "_place")
    return placed.withColumn("batch", F.floor((F.col("_place") - 1) / size)).drop("_place")


def first_pages(items: DataFrame, key: str, order: str, pages: int = 5, size: int = 70) -> DataFrame:
    """The rows of a key's first pages, with ``page`` from 1; no task keeps more than these of a key."""
    return first_rows(items, [key], [order], "_place", pages * size).withColumn("page", F.ceil(F.col("_place") / size)).drop("_place")


def prompt_parts(name: Column, desc: Column) -> Column:
    """Struct (name, desc) of a single room's prompt."""
    return F.struct(
        text.clean_for_prompt(name).alias("name"),
        F.coalesce(F.nullif(text.clean_for_prompt(F.coalesce(desc, F.lit(""))), F.lit("")), F.lit(NO_CONTENT)).alias("desc"),
    )


def batch_prompts(items: DataFrame, key: str, item_id: str) -> DataFrame:
    """(key, batch, rooms_text); a batch holds few rooms, in the order of their ids."""
    part = F.concat(F.lit("ID: "), F.col(item_id).cast("string"), F.lit("\nName: "), "name", F.lit("\nDesc: "), F.coalesce("desc_text", F.lit("")), F.lit("\n---"))
    parts = F.sort_array(F.collect_list(F.struct(F.col(item_id).alias("id"), part.alias("part"))))
    return items.groupBy(key, "batch").agg(F.array_join(F.transform(parts, lambda x: x["part"]), "\n").alias("rooms_text"))


def usable_answer(v: Column) -> Column:
    """Whether a model's object has a name, null or not, and only numbers and words within bounds.
    Truth values count as 0 and 1, numbers in quotes do not count."""
    get = lambda c, kind="variant": F.try_variant_get(v, f"$.{c}", kind)
    absent = lambda c: get(c).isNull() | F.is_variant_null(get(c))

    def within(c: str, lo: int, hi: int) -> Column:
        kind = F.schema_of_variant(get(c))
        number = F.when(kind == "BOOLEAN", get(c, "boolean").cast("double")).when(kind.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)"), get(c, "double"))
        return absent(c) | F.coalesce(number.between(lo, hi), F.lit(False))

    day = absent("day_type") | F.coalesce((F.schema_of_variant(get("day_type")) == "STRING") & get("day_type", "string").isin("weekday", "weekend"), F.lit(False))
    return (
        get("clean_name").isNotNull() & within("max_capacity", *text.CAPACITY_BOUNDS) & within("recommend_capacity", *text.CAPACITY_BOUNDS)
        & within("extra_charge", *text.CHARGE_BOUNDS) & day
    )


def answers(responses: DataFrame, keys: list[str], response: str = "response") -> DataFrame:
    """(keys, id, answer, usable) of the models' JSON objects; a text that is none gives no rows."""
    entries = responses.select(*keys, F.explode(F.from_json(text.unfenced(F.col(response)), "map<string,variant>")).alias("id", "v"))
    kinds = {"clean_name": "string", "day_type": "string", "max_capacity": "int", "recommend_capacity": "int", "base_capacity": "int", "extra_charge": "int", "requires_call": "boolean"}
    answer = F.struct(*(F.try_variant_get("v", f"$.{c}", kind).alias(c) for c, kind in kinds.items()))
    return entries.select(*keys, "id", answer.alias("answer"), usable_answer(F.col("v")).alias("usable"))


def parsed_batches(items: DataFrame, found: DataFrame, keys: list[str], item_id: str) -> DataFrame:
    """``items`` with ``parsed``: the usable answer of their batch, else the patterns' result."""
    own = found.withColumnRenamed("id", "_id")
    joined = items.withColumn("_id", F.col(item_id).cast("string")).join(own, [*keys, "_id"], "left")
    parsed = F.when(F.col("usable"), F.col("answer")).otherwise(text.parse_room(F.col("name"), F.col("desc_text")))
    return joined.withColumn("parsed", parsed).drop("_id", "answer", "usable")


def platform_results(rooms: DataFrame, extractors: dict[str, Extractor]) -> DataFrame:
    """Each room's rows from its platform's extractor, which adds ``status`` and may add
    ``error_code`` for rooms of their own that failed: those have no status.  A platform
    without an extractor has failed as a whole: its rooms keep their rows, with an error
    code and no status."""

    def own(name: str) -> DataFrame:
        part = rooms.filter(platform(F.col("business_id")) == name)
        if name not in extractors:
            return part.withColumn("status", F.lit(None).cast("string")).withColumn("error_code", F.lit(UNCODED))
        found = extractors[name](part)
        if "error_code" not in found.columns:
            found = found.withColumn("error_code", F.lit(None).cast("string"))
        return found.withColumn("status", F.when(F.col("error_code").isNull(), F.col("status")))

    return reduce(DataFrame.unionByName, map(own, sorted({*PLATFORMS.values(), "naver"})))


class ExtractionError(Exception):
    """A failure of one room that an extractor knows, with its code."""

    def __init__(self, code: str, message: str = ""):
        super().__init__(message or code)
        self.code = code


def isolated(read: Callable[[str | None], Iterable[tuple[str, bool]]], payload: str = "payload") -> Extractor:
    """An extractor from a function that reads one payload into (hour, whether it is free).

    The rooms' rows are joined laterally with a table function.  Whatever ``read`` raises
    becomes one row of that room, with the error's code (or ``UNCODED``) and its message, and no
    status; the hours it gave before are dropped, so that a room has hours or an error.  A payload
    without hours keeps its room's row, with neither.  Other rooms never notice.
    """

    class Hours:
        def eval(self, text: str | None):
            try:
                found = [(str(hour), "free" if free else "taken", None, None) for hour, free in read(text)]
            except ExtractionError as e:
                found = [(None, None, e.code, str(e))]
            except Exception as e:  # one room's failure, whatever it is, is its row
                found = [(None, None, UNCODED, f"{type(e).__name__}: {e}")]
            yield from found or [(None, None, None, None)]

    hours = F.udtf(Hours, returnType="hour string, status string, error_code string, message string")

    def extract(rooms: DataFrame) -> DataFrame:
        return rooms.lateralJoin(hours(F.col(payload).outer()))

    return extract


def error_report(results: DataFrame) -> DataFrame:
    """(level, status, error_code, n) of the failed rows: coded errors with their own
    status are warnings, all others errors of status 500."""
    coded = F.col("error_code") != UNCODED
    failed = results.filter("error_code is not null").select(
        F.when(coded, "WARNING").otherwise("ERROR").alias("level"), F.when(coded, F.col("status_code")).otherwise(500).alias("status"), "error_code"
    )
    return failed.groupBy("level", "status", "error_code").agg(F.count("*").alias("n"))


def new_unresolved(rooms: DataFrame, exported: DataFrame, as_of: str) -> DataFrame:
    """Rooms without a usable capacity that the day's export does not hold yet."""
    reasons = rooms.withColumn("failure_reason", unresolved_reason(F.col("max_capacity"))).filter("failure_reason is not null")
    return reasons.join(exported.select("biz_item_id"), "biz_item_id", "left_anti").withColumn("export_date", F.date_format(F.lit(as_of).cast("date"), "yyyyMMdd"))


def export_unresolved(rooms: DataFrame, folder: str, as_of: str) -> None:
    """Appends to the day's JSON files under ``folder``; a second run adds nothing."""
    day = f"{folder}/export_date={as_of.replace('-', '')}"
    try:
        exported = rooms.sparkSession.read.schema("biz_item_id string").json(day)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        exported = rooms.limit(0)  # the day's first run
    new_unresolved(rooms, exported, as_of).write.mode("append").partitionBy("export_date").json(folder)


def log_lines(log: DataFrame, body: str, extras: str | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """One JSON text a row, nulls kept and secrets masked: (pos, line), and the columns ``keep``.

    ``extras`` is a column with a JSON object: its fields follow the others, the values of
    secret keys masked.
    """
    fields = F.struct(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp"), F.col("level"), F.col("logger"), F.col("trace_id"), masking.mask_text(F.col(body)).alias("message"))
    line = F.to_json(fields, {"ignoreNullFields": "false"})
    if extras:
        more = F.regexp_extract(masking.mask_json(F.col(extras)), r"(?s)^\s*\{(.*\S.*)\}\s*$", 1)
        line = F.when(F.coalesce(more, F.lit("")) == "", line).otherwise(F.concat(F.rtrim(line, F.lit("}")), F.lit(","), more, F.lit("}")))
    return log.select("pos", line.alias("line"), *keep)


def log_search(log: DataFrame, trace_id: str | None = None, level: str | None = None, skip_paths: tuple[str, ...] = ("/ping",)) -> DataFrame:
    """The records of a trace, of a level, or both, without those of the skipped paths."""
    found = log.filter(~F.coalesce(F.col("path").isin(*skip_paths), F.lit(False)))
    found = found if trace_id is None else found.filter(F.col("trace_id") == trace_id)
    return found if level is None else found.filter(F.col("level") == level)


#: What in a room's name is taken for a tag.
NAME_TAGS = ("[", "(", "평일", "주말")


def profile_flags(rooms: DataFrame) -> DataFrame:
    """``rooms`` (name, desc_text, min_price, image_count) with has_desc, has_price and name_has_tag."""
    return rooms.withColumns({
        "has_desc": F.coalesce("desc_text", F.lit("")) != "", "has_price": F.col("min_price").isNotNull(), "image_count": F.coalesce("image_count", F.lit(0)),
        "name_has_tag": reduce(lambda a, b: a | b, (F.coalesce(F.col("name"), F.lit("")).contains(t) for t in NAME_TAGS)),
    })


def sample_profile(rooms: DataFrame) -> DataFrame:
    """One row: businesses, rooms, and how many rooms have a description, a price and a tag, with shares in percent."""
    flags = profile_flags(rooms)
    share = lambda c: F.round(100 * F.count_if(c) / F.nullif(F.count("*"), F.lit(0)), 1)
    counts = [x for c, n in (("has_desc", "desc"), ("has_price", "price"), ("name_has_tag", "tag")) for x in (F.count_if(c).alias(f"with_{n}"), share(c).alias(f"{n}_percent"))]
    return flags.agg(F.count_distinct("business_id").alias("businesses"), F.count("*").alias("rooms"), *counts)


def samples(rooms: DataFrame) -> DataFrame:
    """(business_id, rooms): a business with its rooms in the order of their ids, as sample files hold them."""
    room = F.struct(F.col("room_id").alias("biz_item_id"), F.col("name").alias("raw_name"), F.col("desc_text").alias("raw_desc"), "min_price", "image_count", "has_desc", "has_price", "name_has_tag")
    return profile_flags(rooms).groupBy("business_id").agg(F.sort_array(F.collect_list(room)).alias("rooms"))


def save_samples(rooms: DataFrame, folder: str) -> None:
    """JSON lines in a new folder, a business a line."""
    samples(rooms).write.option("ignoreNullFields", "false").json(folder)


def image_order(images: DataFrame) -> DataFrame:
    """``images`` with ``place`` from 1 within a room: by sort order, then image id."""
    order = Window.partitionBy("business_id", "biz_item_id").orderBy("sort_order", "image_id")
    return images.withColumn("place", F.row_number().over(order))


def capacity_from_price(rooms: DataFrame) -> DataFrame:
    """``rooms`` (business_id, room_id, price, max_capacity) with ``guess``: between the next
    cheaper and the next dearer room of known capacity in the business, in proportion to
    the price; known capacities stay, and rooms without both neighbours get none."""
    known = F.when(F.col("max_capacity").isNotNull() & F.col("price").isNotNull(), F.struct("price", "max_capacity"))
    business = Window.partitionBy("business_id")
    so_far = lambda *order: F.last(known, ignorenulls=True).over(business.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    # Both frames grow from their start, so that a business is read once in each direction.
    below, above = so_far("price", "room_id"), so_far(F.desc("price"), F.desc("room_id"))
    part = (F.col("price") - F.col("lo.price")) / F.nullif(F.col("hi.price") - F.col("lo.price"), F.lit(0))
    between = F.col("lo.max_capacity") + part * (F.col("hi.max_capacity") - F.col("lo.max_capacity"))
    guess = F.coalesce(F.col("max_capacity"), F.floor(F.coalesce(between, F.col("lo.max_capacity") + 0 * F.col("hi.price"))).cast("int"))
    return rooms.withColumn("lo", below).withColumn("hi", above).withColumn("guess", guess).drop("lo", "hi")
