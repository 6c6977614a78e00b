"""Validity of requests, rooms, ids and coordinates, as columns of error codes (null: valid)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def time_slots(start: Column, end: Column) -> Column:
    """Hourly ``HH:mm`` from start to end, both included; null if start is after end."""
    at = lambda c: F.try_to_timestamp(F.concat(F.lit("2000-01-01 "), F.lpad(c, 5, "0")), F.lit("yyyy-MM-dd HH:mm"))
    a, b = at(start), at(end)
    return F.when(a <= b, F.transform(F.sequence(a, F.when(a <= b, b).otherwise(a), F.expr("INTERVAL 1 HOUR")), lambda t: F.date_format(t, "HH:mm")))


def box_error(sw_lat: Column, sw_lng: Column, ne_lat: Column, ne_lng: Column) -> Column:
    return (
        F.when(~(sw_lat.between(-90, 90) & ne_lat.between(-90, 90)), "lat_range")
        .when(~(sw_lng.between(-180, 180) & ne_lng.between(-180, 180)), "lng_range")
        .when(sw_lat >= ne_lat, "lat_order")
        .when(sw_lng >= ne_lng, "lng_order")
    )


def date_error(date: Column, as_of: str) -> Column:
    parsed = F.try_to_date(date, "yyyy-MM-dd")
    return F.when(~date.rlike(r"^\d{4}-\d{2}-\d{2}$"), "Date-001").when(parsed.isNull(), "invalid_date").when(parsed < F.lit(as_of).cast("date"), "Date-002")


def hour_error(slot: Column, date: Column, now: str) -> Column:
    """``now`` is ``yyyy-MM-dd HH:mm``; a slot that is now is past."""
    return F.when(~slot.rlike(r"^\d{2}:\d{2}$"), "Hour-001").when((date == now[:10]) & (slot <= now[11:16]), "Hour-002")


def continuity_error(slots: Column) -> Column:
    """Sorted slots must follow each other by an hour."""
    minutes = F.transform(F.array_sort(slots), lambda s: F.substring(s, 1, 2).cast("int") * 60 + F.substring(s, 4, 2).cast("int"))
    steps = F.transform(F.slice(minutes, 2, F.greatest(F.size(minutes), F.lit(1))), lambda m, i: m - F.get(minutes, i))
    return F.when((F.size(slots) > 1) & F.exists(steps, lambda d: d != 60), "Hour-003")


def room_error(*keys: Column) -> Column:
    out = F.lit(None).cast("string")
    for c in keys:
        out = F.when(F.coalesce(c, F.lit("")) == "", "Room-001").otherwise(out)
    return out


def request_error(slots: Column, box: tuple[Column, Column, Column, Column], date: Column, rooms: Column, incomplete: Column, as_of: str, now: str) -> Column:
    """The first of a request's errors: hours, box, date, hours that are past or not in a
    row, no rooms, rooms without a required field.

    ``rooms`` counts the rooms found, ``incomplete`` those of them that lack a field;
    ``now`` is ``yyyy-MM-dd HH:mm``.
    """
    hours = F.filter(F.transform(slots, lambda s: hour_error(s, date, now)), lambda e: e.isNotNull())
    return F.coalesce(
        F.when(slots.isNull(), "slot_order"), box_error(*box), date_error(date, as_of), F.get(hours, 0), continuity_error(slots),
        F.when(F.coalesce(rooms, F.lit(0)) == 0, "Room-003"), F.when(incomplete > 0, "Room-001"),
    )


def day_bounds(date: Column) -> Column:
    """Struct (start, end): the first and the last second of a day, as the schedules are asked for."""
    day = F.date_format(date, "yyyy-MM-dd")
    return F.struct(F.concat(day, F.lit("T00:00:00")).alias("start"), F.concat(day, F.lit("T23:59:59")).alias("end"))


def coordinate_error(x: Column, y: Column) -> Column:
    """Why a place's text coordinates cannot be used: missing, not numbers, outside the city."""
    numeric = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"
    lat, lng = y.try_cast("double"), x.try_cast("double")
    return (
        F.when((F.coalesce(x, F.lit("")) == "") | (F.coalesce(y, F.lit("")) == ""), "missing")
        .when(~(x.rlike(numeric) & y.rlike(numeric)), "not_numeric")
        .when(~(lat.between(37.4, 37.7) & lng.between(126.7, 127.2)), "out_of_range")
    )


def device_error(device: Column) -> Column:
    plain = F.regexp_replace(F.regexp_replace(F.trim(device), "^(?i:urn:uuid:)?", ""), "[{}-]", "")
    return F.when(F.trim(F.coalesce(device, F.lit(""))) == "", "required").when(~plain.rlike("^[0-9a-fA-F]{32}$"), "invalid format")


def trace_id(candidate: Column) -> Column:
    """The id if it is one, else a new one."""
    return F.when(candidate.rlike("^(?i)[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$"), candidate).otherwise(F.uuid())


def client_ip(cloud: Column, forwarded: Column, real: Column, host: Column) -> Column:
    some = lambda c: F.nullif(F.trim(c), F.lit(""))
    return F.coalesce(some(cloud), some(F.split(forwarded, ",")[0]), some(real), some(host), F.lit("unknown"))


def suspicious(max_capacity: Column, price: Column, large: int = 20) -> Column:
    """A dear room for one, or a cheap one for many."""
    return ((max_capacity == 1) & (price > 15000)) | ((max_capacity >= large) & (price < 10000))
