"""Connected components of an edge table, by large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def components(edges: DataFrame, max_steps: int = 60) -> DataFrame:
    """(node, label): for every node of ``edges`` (a, b: long) but the smallest of
    its component, that smallest node.

    Each step hangs neighbours on the smallest one they see; a node's neighbours
    are only ever reduced to a minimum, never gathered.  Labels that do not settle in
    ``max_steps`` steps raise: unfinished ones would split components.
    """
    now = written(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    mark = None
    for _ in range(max_steps):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = large.groupBy("u").agg(F.min("v").alias("m"))
        hung = large.join(small, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = written(hung.unionByName(small.select("u", F.col("m").alias("v"))).distinct())
        seen = now.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
        if seen == mark or not seen.n:
            break
        mark = seen
    else:
        raise ArithmeticError(f"components did not settle in {max_steps} steps")
    return now.select(F.col("u").alias("node"), F.col("v").alias("label"))
