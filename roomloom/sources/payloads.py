"""Captured JSON and HTML payloads as rows."""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Fixed value: what stands behind the hour in a label's title.
HOUR_MARK = "시00분"
BUSINESS = "struct<data:struct<business:struct<businessId:string,businessDisplayName:string,coordinates:array<double>,placeId:string>>>"
ITEMS = "struct<data:struct<bizItems:array<struct<bizItemId:string,name:string,desc:string,minMaxPrice:struct<minPrice:int,maxNormalPrice:int>,bizItemResources:array<struct<resourceUrl:string>>>>>>"
SCHEDULE = "struct<data:struct<schedule:struct<bizItemSchedule:struct<hourly:array<struct<unitStartTime:string,unitStock:int,unitBookingCount:int>>>>>>"


def places(states: DataFrame, payload: str = "state") -> DataFrame:
    """Rows of the ``PlaceSummary:`` entries of search states; other entries may be anything."""
    entries = states.select(*[c for c in states.columns if c != payload], F.posexplode(F.from_json(payload, "map<string,variant>")).alias("at", "key", "v"))
    get = lambda name: F.try_variant_get("v", f"$.{name}", "string")
    return entries.filter(F.col("key").startswith("PlaceSummary:")).select(
        *[c for c in states.columns if c != payload], "at", F.coalesce(get("bookingBusinessId"), F.split("key", ":")[1]).alias("id"), *(get(c).alias(c) for c in ("name", "category", "address", "roadAddress", "x", "y"))
    )


def businesses(df: DataFrame, payload: str = "payload") -> DataFrame:
    b = F.from_json(payload, BUSINESS)["data"]["business"]
    at = F.col("b.coordinates")
    return df.withColumn("b", b).filter("b is not null").select(
        F.col("b.businessId").alias("business_id"), F.col("b.businessDisplayName").alias("name"),
        F.when(F.size(at) >= 2, F.get(at, 1)).alias("lat"), F.when(F.size(at) >= 2, F.get(at, 0)).alias("lng"), F.col("b.placeId").alias("place_id"),
    )


def rooms(df: DataFrame, payload: str = "payload") -> DataFrame:
    item = df.select(*[c for c in df.columns if c != payload], F.posexplode(F.from_json(payload, ITEMS)["data"]["bizItems"]).alias("pos", "i"))
    return item.select(
        *[c for c in df.columns if c != payload], "pos", F.col("i.bizItemId").alias("biz_item_id"), F.col("i.name").alias("name"), F.col("i.desc").alias("desc"), F.col("i.minMaxPrice.minPrice").alias("price_per_hour"),
        F.coalesce(F.transform("i.bizItemResources", lambda r: r["resourceUrl"]), F.array().cast("array<string>")).alias("image_urls"),
    )


def hours(df: DataFrame, payload: str = "payload") -> DataFrame:
    h = df.select(*[c for c in df.columns if c != payload], F.posexplode(F.from_json(payload, SCHEDULE)["data"]["schedule"]["bizItemSchedule"]["hourly"]).alias("pos", "h"))
    return h.select(*[c for c in df.columns if c != payload], "pos", F.substring(F.right(F.col("h.unitStartTime"), F.lit(8)), 1, 5).alias("hour"), (F.col("h.unitBookingCount") < F.col("h.unitStock")).alias("is_free"))


@F.pandas_udf(StringType())
def unescaped(markup: pd.Series) -> pd.Series:
    """Text with its HTML entities resolved."""
    return markup.map(html.unescape, na_action="ignore")


#: The entities that are resolved natively, the ampersand last, so that what it makes stays; and any other.
_COMMON = {"lt": "<", "gt": ">", "quot": '"', "apos": "'", "#39": "'", "amp": "&"}
_RARE = f"&(?!(?:{'|'.join(_COMMON)});)"


def _plain(markup: Column) -> Column:
    for name, sign in _COMMON.items():
        markup = F.replace(markup, F.lit(f"&{name};"), F.lit(sign))
    return markup


def label_pages(df: DataFrame, payload: str = "payload") -> DataFrame:
    """Site A: ``df`` with ``html``, the unescaped ``items`` of a JSON answer; '' if it has none.
    ``failed`` marks what is no JSON object."""
    body = F.from_json(payload, "items string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    is_object = F.coalesce(F.ltrim(payload).startswith("{") & F.get_json_object(payload, "$").isNotNull(), F.lit(False))
    items = F.coalesce(body["items"], F.lit(""))
    html_ = F.coalesce(unescaped(F.when(items.rlike(_RARE), items)), _plain(items))  # only what has other entities goes to Python
    return df.withColumn("failed", ~is_object).withColumn("html", html_)


#: An attribute: a name, and behind "=" a value in either kind of quotes or in none.
_ATTRIBUTE = r"""[^\s/>=][^\s/>=]*+(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>"'][^\s>]*+)?)?"""
#: A start tag; a ">" within quotes does not end it.
_TAG = rf"<[A-Za-z][^\s/>]*+(?:[\s/]++|{_ATTRIBUTE})*+>"
#: Pieces of markup from left to right: comments and the content of scripts and styles are
#: pieces of their own, so that no tag is found in them; all that is not closed goes to the end.
_PIECE = rf"(?is)<!--(?:-?>|.*?(?:--!?>|\z))|<(script|style)(?=[\s/>])(?:[\s/]++|{_ATTRIBUTE})*+>.*?(?:</\1(?=[\s/>])|\z)|{_TAG}"


def start_tags(markup: Column, name: str | None = None) -> Column:
    """The start tags of an element (by default of all), in order."""
    pieces = F.regexp_extract_all(markup, F.lit(_PIECE), 0)
    own = F.filter(pieces, lambda x: x.rlike(rf"(?i)^<{name}(?=[\s/>])" if name else "^<[A-Za-z]"))
    if name and name.lower() not in ("script", "style"):
        return own
    return F.transform(own, lambda x: F.when(x.rlike("(?i)^<(?:script|style)"), F.regexp_extract(x, _TAG, 0)).otherwise(x))


def attribute(tag: Column, name: str, last: bool = False) -> Column:
    """A tag's attribute, of repeated ones the first (or the last); '' if it has none."""
    pairs = F.regexp_extract_all(F.regexp_replace(tag, r"^<[A-Za-z][^\s/>]*+", ""), F.lit(_ATTRIBUTE), 0)
    own = F.filter(pairs, lambda a: a.rlike(rf"(?i)^{name}\s*(?:=|$)"))
    value = F.coalesce(F.try_element_at(own, F.lit(-1 if last else 1)), F.lit(""))
    bare = F.regexp_replace(value, r"(?s)^[^=]*+=?\s*+", "")
    return F.regexp_replace(bare, r"""(?s)^(["'])(.*)\1$""", "$2")  # each step stands once: a lambda computes again what it names again


def _has_class(tag: Column, name: str, last: bool = False) -> Column:
    return F.array_contains(F.split(attribute(tag, "class", last), r"\s+"), name)


def label_marks(markup: Column) -> Column:
    """Site A, a page parsed once: array of (title, active) of its labels, in order."""
    return F.transform(start_tags(markup, "label"), lambda x: F.named_struct(F.lit("title"), attribute(x, "title"), F.lit("active"), _has_class(x, "active")))


def marked_free(marks: Column, hour: Column) -> Column:
    """Whether the first label of an hour is active; no label is not."""
    title = F.concat(F.lpad(hour.cast("string"), 2, "0"), F.lit(HOUR_MARK))
    return F.coalesce(F.get(F.filter(marks, lambda m: m["title"].contains(title)), 0)["active"], F.lit(False))


def label_free(markup: Column, hour: Column) -> Column:
    """Site A: whether the first label of an hour is active, of a page that is asked once."""
    return marked_free(label_marks(markup), hour)


def open_cells(markup: Column) -> Column:
    """Site B, a page parsed once: the ids of the elements that are marked as open."""
    open_ = F.filter(start_tags(markup), lambda x: _has_class(x, "reserve_time_off", last=True))
    return F.transform(open_, lambda x: attribute(x, "id", last=True))


def cell_open(cells: Column, item: Column, hour: Column) -> Column:
    return F.coalesce(F.array_contains(cells, F.concat(F.lit("reserve_time_"), item, F.lit("_"), hour.cast("string"))), F.lit(False))


def cell_free(markup: Column, item: Column, hour: Column) -> Column:
    """Site B: whether an element of an item and hour is marked as open, of a page that is asked once."""
    return cell_open(open_cells(markup), item, hour)
