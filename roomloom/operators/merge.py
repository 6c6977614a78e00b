"""Keyed merges into master tables, first- and last-wins dedup."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: the capacity that marks a room as not yet known.
UNKNOWN = 100


def first_wins(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Of the rows of a key the first by ``order``, and of those that tie the least; combines before the shuffle."""
    return _one(df, keys, order, F.min)


def last_wins(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Of the rows of a key the last by ``order``, and of those that tie the greatest; combines before the shuffle."""
    return _one(df, keys, order, F.max)


def _one(df: DataFrame, keys: list[str], order: list[str], pick: Callable[[Column], Column]) -> DataFrame:
    """The least or greatest row of a key, compared by ``order``, then by all other columns as they stand."""
    rest = [c for c in df.columns if c not in keys]
    row = F.struct(*order, *(c for c in rest if c not in order))
    return df.groupBy(*keys).agg(pick(row).alias("r")).select(*keys, *(f"r.{c}" for c in rest))


def upsert(existing: DataFrame, incoming: DataFrame, keys: list[str], rules: dict[str, Column] | None = None) -> DataFrame:
    """``existing`` with ``incoming``: new rows win, nulls included, except in columns
    with a rule over ``old.`` and ``new.`` columns; rows without news stay."""
    old = existing.withColumn("_old", F.lit(True)).alias("old")
    new = incoming.withColumn("_new", F.lit(True)).alias("new")
    joined = old.join(new, [F.col(f"old.{k}").eqNullSafe(F.col(f"new.{k}")) for k in keys], "full")
    out = []
    for c in existing.columns:
        if c in keys:
            value = F.coalesce(f"new.{c}", f"old.{c}")
        elif c in incoming.columns:
            value = F.when(F.col("new._new"), (rules or {}).get(c, F.col(f"new.{c}"))).otherwise(F.col(f"old.{c}"))
        else:
            value = F.col(f"old.{c}")
        out.append(value.alias(c))
    return joined.select(*out)


def kept_capacity(c: str) -> Column:
    """A manual capacity survives a new value that says nothing."""
    new, old = F.coalesce(F.col(f"new.{c}"), F.lit(UNKNOWN)), F.col(f"old.{c}")
    keep = ((new <= 1) | (new == UNKNOWN)) & (old > 1) & (old != UNKNOWN)
    return F.when(keep, old).otherwise(new)


def kept_price(c: str) -> Column:
    new, old = F.col(f"new.{c}"), F.col(f"old.{c}")
    return F.when((F.coalesce(new, F.lit(0)) == 0) & (old > 0), old).otherwise(new)


def merge_rooms(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """All columns of ``existing`` that ``incoming`` has, by their rules: capacities and price
    keep manual values, a call is required only if the news say so, images are never
    null, and the rest is overwritten, nulls included.  ``can_reserve_one_hour`` is not
    part of the news: it stays, and is true for new rooms."""
    rules = {"max_capacity": kept_capacity("max_capacity"), "recommend_capacity": kept_capacity("recommend_capacity"), "price_per_hour": kept_price("price_per_hour")}
    if "requires_call" in incoming.columns:
        rules["requires_call"] = F.coalesce("new.requires_call", F.lit(False))
    if "image_urls" in incoming.columns:
        rules["image_urls"] = F.coalesce("new.image_urls", F.array().cast("array<string>"))
    merged = upsert(existing, incoming, ["business_id", "biz_item_id"], rules)
    if "can_reserve_one_hour" in merged.columns:
        merged = merged.withColumn("can_reserve_one_hour", F.coalesce("can_reserve_one_hour", F.lit(True)))
    return merged


def sync_coordinates(branches: DataFrame, places: DataFrame) -> DataFrame:
    """Coordinates of known branches are replaced, their names kept; new ones are added.
    Of several hits (by ``pos``) the last gives coordinates, the first a new branch's name."""
    hits = places.groupBy("business_id").agg(F.min_by("name", "pos").alias("name"), F.max_by(F.struct("lat", "lng"), "pos").alias("at")).select("business_id", "name", "at.lat", "at.lng")
    return upsert(branches, hits, ["business_id"], {"name": F.coalesce("old.name", "new.name")})


def current_favorites(changes: DataFrame) -> DataFrame:
    """The set after all adds and deletes, the later winning for each key."""
    keys = ["device_id", "business_id", "biz_item_id"]
    return changes.groupBy(*keys).agg(F.max_by("op", "seq").alias("op")).filter("op = 'add'").select(*keys)


def unresolved_reason(max_capacity: Column) -> Column:
    return F.when(max_capacity.isNull(), "no_capacity_info").when(max_capacity == UNKNOWN, "manual_review_flag")


def write_snapshot(table: DataFrame, folder: str) -> None:
    """The merged table in a new folder: never over the one it was read from."""
    table.write.mode("errorifexists").parquet(folder)
