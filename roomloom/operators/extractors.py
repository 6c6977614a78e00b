"""The platforms' extractors: captured answers of many rooms and days as one row an hour.

Each takes rows (business_id, biz_item_id, day: date, hour_slots: array of ``HH:00``, payload) and gives
them with ``hour``, ``status`` (free, taken, unknown) and ``error_code`` in place of hour_slots and
payload.  A room whose payload cannot be read has one row with an error and no hour; no
other room notices.  A room that is asked for no hours keeps one row.  All is native; a payload is parsed once, however many hours are asked.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources import payloads
from .availability import beyond_horizon
from .collection import Extractor

#: Codes of answers that cannot be read, and of logins that failed.
UNREADABLE, NO_LOGIN = "CRAWLER-002", "CRAWLER-003"


def _asked(df: DataFrame, error: Column, parsed: Column, free: Callable[[Column, Column], Column], unknown: Column) -> DataFrame:
    """A row an hour by ``free(parsed, hour)``, or one with the error; ``unknown`` days need no payload."""
    code = F.when(~unknown, error)
    keys = [c for c in df.columns if c not in ("hour_slots", "payload")]
    read = df.select(*keys, code.alias("error_code"), unknown.alias("_unknown"), F.when(~unknown, parsed).alias("_parsed"), "hour_slots")  # before rows are multiplied
    hours = F.when(F.col("error_code").isNull(), F.col("hour_slots")).otherwise(F.array(F.lit(None).cast("string")))
    each = read.select(*keys, "error_code", "_unknown", "_parsed", F.explode_outer(hours).alias("hour"))
    status = F.when(F.col("hour").isNull(), F.lit(None)).when(F.col("_unknown"), "unknown").when(F.col("error_code").isNull(), F.when(F.coalesce(free(F.col("_parsed"), F.col("hour")), F.lit(False)), "free").otherwise("taken"))
    return each.select(*keys, "hour", status.alias("status"), "error_code")


def _is_object(payload: Column) -> Column:
    return F.coalesce(F.ltrim(payload).startswith("{") & F.get_json_object(payload, "$").isNotNull(), F.lit(False))


def naver(df: DataFrame) -> DataFrame:
    """Schedules: of repeated hours the last counts, an hour that is not listed is taken; entries without a
    time, and asked ones without counts, make the answer unreadable."""
    entries = F.coalesce(F.from_json("payload", payloads.SCHEDULE)["data"]["schedule"]["bizItemSchedule"]["hourly"], F.array().cast("array<struct<unitStartTime:string,unitStock:int,unitBookingCount:int>>"))
    at = lambda e: F.substring(F.right(e["unitStartTime"], F.lit(8)), 1, 5)
    holes = F.exists(entries, lambda e: e["unitStartTime"].isNull() | (F.array_contains("hour_slots", at(e)) & (e["unitStock"].isNull() | e["unitBookingCount"].isNull())))
    error = F.when(~_is_object(F.col("payload")) | F.coalesce(holes, F.lit(True)), UNREADABLE)
    marks = F.transform(entries, lambda e: F.named_struct(F.lit("hour"), at(e), F.lit("free"), e["unitBookingCount"] < e["unitStock"]))
    last = lambda marks, hour: F.element_at(F.filter(marks, lambda m: m["hour"] == hour), -1)["free"]
    return _asked(df, error, marks, lambda m, h: F.when(F.exists(m, lambda x: x["hour"] == h), last(m, h)), F.lit(False))


def dream(as_of: str) -> Extractor:
    """Site A: label pages in JSON; of repeated hours the first label counts."""
    def extract(df: DataFrame) -> DataFrame:
        pages = payloads.label_pages(df)
        error = F.when(F.col("failed"), UNREADABLE)
        far = F.coalesce(beyond_horizon(F.col("business_id"), F.col("day"), as_of), F.lit(False))
        hour = lambda h: F.split(h, ":")[0]
        out = _asked(pages, error, payloads.label_marks(F.col("html")), lambda m, h: payloads.marked_free(m, hour(h)), far)
        return out.drop("failed", "html")

    return extract


def groove(as_of: str) -> Extractor:
    """Site B: pages of cells; without a page the login has failed."""
    def extract(df: DataFrame) -> DataFrame:
        far = F.coalesce(beyond_horizon(F.col("business_id"), F.col("day"), as_of), F.lit(False))
        error = F.when(F.col("payload").isNull(), NO_LOGIN)
        hour = lambda h: F.split(h, ":")[0].cast("int")
        item = F.col("biz_item_id")
        cells = F.named_struct(F.lit("item"), item, F.lit("open"), payloads.open_cells(F.col("payload")))
        return _asked(df, error, cells, lambda c, h: payloads.cell_open(c["open"], c["item"], hour(h)), far)

    return extract


def registry(as_of: str) -> dict[str, Extractor]:
    """Platform to extractor, as ``platform_results`` takes them."""
    return {"naver": naver, "dream": dream(as_of), "groove": groove(as_of)}
