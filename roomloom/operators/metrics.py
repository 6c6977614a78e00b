"""Counts, shares and ranges of rooms, observed on the scan that writes them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from .merge import UNKNOWN

#: The table's rules, as (name, what breaks it).
RULES = (("price", "price_per_hour < 0"), ("max", "max_capacity < 1"), ("max_recommend", "max_capacity < recommend_capacity"))


def room_metrics(quantiles: bool = False, within: tuple[int, int] = (2, 15)) -> list[Column]:
    """Aggregates of one pass: rows, broken rules, known capacities, ranges; with ``quantiles``
    also approximate quartiles of prices, from sketches of bounded size."""
    most, price = F.col("max_capacity"), F.col("price_per_hour")
    known = F.count_if(most != UNKNOWN)
    out = [
        F.count("*").alias("rooms"), *(F.count_if(F.expr(rule)).alias(f"bad_{name}") for name, rule in RULES),
        known.alias("known_capacity"), F.round(100 * known / F.nullif(F.count("*"), F.lit(0)), 1).alias("known_percent"),
        F.min(most).alias("least"), F.max(most).alias("most"), F.min(price).alias("cheapest"), F.max(price).alias("dearest"), F.count_if(~most.between(*within)).alias("outside"),
    ]
    if quantiles:
        out.append(F.approx_percentile(price, [0.25, 0.5, 0.75], 10_000).alias("price_quartiles"))
    return out


def observed(rooms: DataFrame, seen: Observation, quantiles: bool = False) -> DataFrame:
    """``rooms`` whose next action, such as the write of a merge, also fills ``seen``."""
    return rooms.observe(seen, *room_metrics(quantiles))


def observed_row(rooms: DataFrame, seen: Observation, quantiles: bool = False) -> DataFrame:
    """The observed values as a table of one row; ``rooms`` gives their types and is not read."""
    schema = rooms.agg(*room_metrics(quantiles)).schema
    return rooms.sparkSession.createDataFrame([tuple(seen.get[c] for c in schema.names)], schema)
