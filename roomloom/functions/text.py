"""Capacity, price and day rules from free Korean room texts, as column expressions."""

from __future__ import annotations

import re
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that name a room's size, in order of precedence.
SIZE_WORDS = (("대형", 15), ("중형", 8), ("소형", 4), ("대합주실", 15), ("소합주실", 4))
#: White space and digits as the patterns mean them, wherever a text comes from.
BLANKS = "\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
S, D = f"[{BLANKS}]", "[0-9\uff10-\uff19]"
#: Patterns of the capacity rules.
BOTH = rf"\({S}*정원{S}*({D}+){S}*(?:인|명){S}*,{S}*최대{S}*({D}+){S}*(?:인|명){S}*\)"
QUOTA = rf"정원{S}*({D}+){S}*(?:인|명)"
MOST = rf"(?i)(?:최대|max){S}*({D}+)"
UP_TO = rf"({D}+){S}*(?:인|명){S}*(?:까지|이하|수용)"
POSSIBLE = rf"({D}+){S}*(?:인|명)(?:이|이서)?{S}*(?:합주|이용|수용)?{S}*가능"
MINUS = rf"\({S}*-{S}*({D}+){S}*(?:인|명){S}*\)"
RANGE = rf"({D}+){S}*[~\-]{S}*({D}+){S}*(?:인|명)"
ADVISED = rf"권장{S}*인원{S}*({D}+){S}*(?:인|명){S}*({D}+){S}*(?:인|명)"
BASE = rf"기본{S}*({D}+)"
EXTRA = rf"(?d)(?:1인|인당){S}*(?:추가)?.*?({D}+(?:,{D}+)?){S}*원"
NAME_PARTS = (
    rf"{S}*\(?{S}*정원{S}*{D}+{S}*(?:인|명){S}*,?{S}*(?:최대{S}*{D}+{S}*(?:인|명))?{S}*\)?",
    rf"{S}*\(?{S}*최대{S}*{D}+{S}*(?:인|명){S}*\)?",
    rf"{S}*\({S}*-{S}*{D}+{S}*(?:인|명){S}*\)",
)
#: What a text must hold for a pattern to find anything in it: one of these strings.
NEEDS = {
    BOTH: ("정원",), QUOTA: ("정원",), MOST: ("최대", "max", "Max", "MAX"), UP_TO: ("까지", "이하", "수용"), POSSIBLE: ("가능",),
    MINUS: ("-",), RANGE: ("~", "-"), ADVISED: ("권장",), BASE: ("기본",), EXTRA: ("원",),
    NAME_PARTS[0]: ("정원",), NAME_PARTS[1]: ("최대",), NAME_PARTS[2]: ("-",),
}
#: Full-width digits in order, marks of the kinds of days, and what asks for a call on the day itself.
_WIDE = "０１２３４５６７８９"
WEEKDAY_MARKS = ("[평일]", "(평일)")
WEEKEND_MARKS = ("[주말]", "(주말)", "주말/공휴일")
WEEKEND_PARTS = r"\[주말[^\]]*\]|\(주말[^)]*\)|\[주말/공휴일\]"
SAME_DAY, CALL_WORDS = "당일", ("전화", "문의")
#: What shows that the patterns will find a capacity, and the bounds of a valid result.
CLEAR_CAPACITY = rf"최대{S}*{D}+|{D}+[~\-]{D}+인"
CAPACITY_BOUNDS, CHARGE_BOUNDS = (1, 50), (0, 50000)


def strip(c: Column) -> Column:
    return F.regexp_replace(c, f"^{S}+|{S}+$", "")


def may_match(c: Column, pattern: str) -> Column:
    """Whether the text has what the pattern needs; "max" in mixed case is looked for as well."""
    some = reduce(or_, map(c.contains, NEEDS[pattern]))
    return some | c.rlike("(?i)max") if pattern == MOST else some


def number(c: Column, pattern: str, group: int = 1) -> Column:
    """The group as a whole number; null where nothing matches."""
    found = F.translate(F.regexp_extract(c, pattern, group), _WIDE, "0123456789").try_cast("int")
    return F.when(may_match(c, pattern), found)


def clean_for_prompt(c: Column) -> Column:
    """Without tags and odd signs, white space squeezed."""
    c = F.regexp_replace(c, "<[^>]+>", "")
    c = F.regexp_replace(c, r"(?U)[^\w\s가-힣~\-,]", " ")
    return strip(F.regexp_replace(c, r"(?U)\s+", " "))


def size_from_name(name: Column) -> Column:
    out = F.lit(None).cast("int")
    for word, size in reversed(SIZE_WORDS):
        out = F.when(name.contains(word), size).otherwise(out)
    return out


def day_type(name: Column) -> Column:
    has = lambda marks: reduce(or_, map(name.contains, marks))
    return F.when(has(WEEKDAY_MARKS), "weekday").when(has(WEEKEND_MARKS), "weekend")


def clean_name(name: Column) -> Column:
    day = day_type(name)
    weekday = "|".join(re.escape(m) for m in WEEKDAY_MARKS)
    out = (
        F.when(day == "weekday", strip(F.regexp_replace(name, weekday, "")))
        .when(day == "weekend", strip(F.regexp_replace(name, WEEKEND_PARTS, "")))
        .otherwise(name)
    )

    def without(rest: tuple[str, ...]):
        if not rest:
            return lambda c: c
        step = lambda c: strip(F.when(may_match(c, rest[0]), F.regexp_replace(c, rest[0], "")).otherwise(c))
        return lambda c: _once(step(c), without(rest[1:]))

    return _once(out, without(NAME_PARTS))


def _once(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once a row."""
    return F.transform(F.array(value), body)[0]


def capacity(text: Column) -> Column:
    """Struct (max, rec) by the rules in their order; 0 counts as not found for the later rules."""
    found = {"most": MOST, "quota": QUOTA, "up_to": UP_TO, "possible": POSSIBLE, "minus": MINUS}
    pairs = {"range": RANGE, "advised": ADVISED, "both": BOTH}
    numbers = [number(text, p).alias(k) for k, p in found.items()] + [number(text, p, g).alias(f"{k}{g}") for k, p in pairs.items() for g in (1, 2)]
    some = lambda c: F.nullif(c, F.lit(0))
    half = lambda x, y: F.floor((x + y) / 2).cast("int")

    def rules(n: Column) -> Column:
        single = F.coalesce(some(n["most"]), some(n["up_to"]), some(n["possible"]), n["minus"], n["possible"], n["up_to"], n["most"])
        ranged = n["range1"].isNotNull()
        advised = some(n["quota"]).isNull() & n["advised1"].isNotNull()
        most = F.when(ranged, F.coalesce(some(single), n["range2"])).when(advised, F.coalesce(some(single), n["advised2"])).otherwise(single)
        rec = F.when(ranged, half(n["range1"], n["range2"])).when(advised, half(n["advised1"], n["advised2"])).otherwise(n["quota"])
        both = n["both2"].isNotNull()
        return F.struct(F.when(both, n["both2"]).otherwise(most).alias("max"), F.when(both, n["both1"]).otherwise(rec).alias("rec"))

    nothing = F.struct(F.lit(None).cast("int").alias("max"), F.lit(None).cast("int").alias("rec"))
    return F.when(text.rlike(D), _once(F.struct(*numbers), rules)).otherwise(nothing)


def _texts(name: Column, desc: Column) -> Column:
    return F.struct(F.coalesce(name, F.lit("")).alias("name"), F.coalesce(desc, F.lit("")).alias("desc"))


def _set(c: Column) -> Column:
    return F.coalesce(c, F.lit(0)) != 0


def _chosen(name: Column, desc: Column) -> Column:
    """The description's capacity, or the name's where that has neither number."""
    return _once(capacity(desc), lambda c: F.when(_set(c["max"]) | _set(c["rec"]), c).otherwise(capacity(name)))


def max_capacity(name: Column, desc: Column) -> Column:
    """The ``max_capacity`` of ``parse_room``, without the work for its other fields."""
    return _once(_texts(name, desc), lambda t: _chosen(t["name"], t["desc"]))["max"]


def parse_room(name: Column, desc: Column) -> Column:
    """Struct of clean_name, day_type, max_capacity, recommend_capacity, base_capacity,
    extra_charge and requires_call; both texts are worked out once a row, wherever the optimizer puts this."""
    return _once(_texts(name, desc), lambda t: _parsed_room(t["name"], t["desc"]))


def _parsed_room(name: Column, desc: Column) -> Column:
    def whole(c: Column) -> Column:
        default = F.when(c["max"] > 4, F.floor(c["max"] / 2).cast("int")).otherwise(c["max"])
        charge = F.translate(F.regexp_extract(desc, EXTRA, 1), _WIDE + ",", "0123456789").try_cast("int")
        return F.struct(
            clean_name(name).alias("clean_name"),
            day_type(name).alias("day_type"),
            c["max"].alias("max_capacity"),
            F.when(_set(c["max"]) & ~_set(c["rec"]), default).otherwise(c["rec"]).alias("recommend_capacity"),
            number(desc, BASE).alias("base_capacity"),
            F.when(may_match(desc, EXTRA), charge).alias("extra_charge"),
            (desc.contains(SAME_DAY) & reduce(or_, map(desc.contains, CALL_WORDS))).alias("requires_call"),
        )

    return _once(_chosen(name, desc), whole)


def valid_result(r: Column) -> Column:
    """Whether a parsed struct is usable."""
    within = lambda c, lo, hi: F.coalesce(c.between(lo, hi), F.lit(True))
    return (
        r["clean_name"].isNotNull() & within(r["max_capacity"], *CAPACITY_BOUNDS) & within(r["recommend_capacity"], *CAPACITY_BOUNDS) & within(r["extra_charge"], *CHARGE_BOUNDS)
        & F.coalesce(r["day_type"].isin("weekday", "weekend"), F.lit(True))
    )


def cascade(name: Column, desc: Column, response: Column) -> Column:
    """The parsed room: size word, then patterns, then a valid model response, then patterns."""
    word = size_from_name(name)

    def pick(parsed: Column) -> Column:
        named = parsed.withField("max_capacity", word)
        by_text = F.coalesce(parsed["max_capacity"], F.lit(0)) != 0
        return F.when(word.isNotNull(), named).when(by_text, parsed).when(valid_result(response), response).otherwise(parsed)

    return _once(parse_room(name, desc), pick)


def unfenced(response: Column) -> Column:
    """A model's answer without the code fence around it."""
    return strip(F.regexp_replace(F.regexp_replace(strip(response), "^```(?:json)?", ""), "```$", ""))


def needs_model(desc: Column) -> Column:
    """Whether the patterns are likely to miss the capacity of a description."""
    return ~F.coalesce(desc, F.lit("")).rlike(CLEAR_CAPACITY)
