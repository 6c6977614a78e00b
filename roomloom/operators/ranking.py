"""Row numbers within a key without one task a key."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.folders import written

#: Rows of one key that a task numbers by a plain window.
WINDOW_ROWS = 1_000_000


def numbered_by_ranges(df: DataFrame, keys: list[str], order: list[str], name: str, parts: int | None = None) -> DataFrame:
    """``df`` with ``name``, from 1 within a key, however many rows a key has, in ``parts`` ranges
    (by default as many as Spark finds fit).

    Rows are cut into ranges of (keys, order), so that one key's rows lie in several, and
    written in order with their place in the range.  A key has one count for each of its
    ranges; the sum of those before is added to the place.
    """
    part, at, start, n, before = "_part", "_at", "_start", "_n", "_before"
    ranged = df.repartitionByRange(*([parts] if parts else []), *keys, *order).sortWithinPartitions(*keys, *order)
    place = F.monotonically_increasing_id()
    rows = written(ranged.withColumn(part, F.spark_partition_id()).withColumn(at, place.bitwiseAND((1 << 33) - 1)))
    pieces = rows.groupBy(*keys, part).agg(F.count("*").alias(n), F.min(at).alias(start))
    earlier = Window.partitionBy(*keys).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    offsets = pieces.withColumn(before, F.coalesce(F.sum(n).over(earlier), F.lit(0))).alias("o")
    r = rows.alias("r")
    same = [F.col(f"r.{part}") == F.col(f"o.{part}"), *(F.col(f"r.{k}").eqNullSafe(F.col(f"o.{k}")) for k in keys)]
    number = F.col(f"r.{at}") - F.col(f"o.{start}") + F.col(f"o.{before}") + 1
    return r.join(offsets, same).select(*(F.col(f"r.{c}") for c in df.columns), number.alias(name))


def numbered(df: DataFrame, keys: list[str], order: list[str], name: str, window_rows: int = WINDOW_ROWS) -> DataFrame:
    """``df`` with the row number within a key: by a window while no key has more than
    ``window_rows`` rows, else by ranges.  The numbers are the same; rows of equal order
    may come in any order."""
    largest = df.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0
    if largest > window_rows:
        return numbered_by_ranges(df, keys, order, name)
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long"))


def first_rows(df: DataFrame, keys: list[str], order: list[str], name: str, n: int) -> DataFrame:
    """The first ``n`` rows of a key, numbered; each task keeps no more of a key before the shuffle."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn(name, place).filter(F.col(name) <= n)
