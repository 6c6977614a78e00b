"""A corpus in five stages: quality rules, near-dedup, decontamination, personal data, packing.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept, and all
but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roomloom.llm import leaks, neardup, packing, pii, quality
from roomloom.llm.common import if_small, small_arrow_batches, written
from roomloom.llm.queries import table, tokenizer_path

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _with_text(docs: DataFrame, text: str) -> DataFrame:
    changed = F.col(text)
    return docs.select("doc_id", changed.alias("text"), "lang", "source", F.length(changed).cast("long").alias("n_chars"))


def _numbered(docs: DataFrame) -> DataFrame:
    """``docs`` with a written key of each row, as ids may be null or repeated."""
    return written(docs.select(*COLUMNS).withColumn("_row", F.monotonically_increasing_id()))


def _without(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """``docs`` without the rows of these keys."""
    return docs.join(if_small(written(rows.select("_row").distinct())), "_row", "left_anti").select(*COLUMNS)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go, and from the others the lines that are common on their host."""
    return _with_text(quality.judge(docs).filter("kept"), "clean_text")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies one row stays: the one with the smallest id, null last."""
    small_arrow_batches(spark)
    docs = _numbered(docs)
    groups = written(neardup.near_duplicates(docs, id_col="_row").select("_row", "component_id").join(docs.select("_row", "doc_id"), "_row"))
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "_row")
    stays = groups.groupBy("component_id").agg(F.min(order)["_row"].alias("_row"))
    return _without(docs, groups.join(stays, "_row", "left_anti"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item of three words or more go, and no others that share their id."""
    docs = _numbered(docs)
    return _without(docs, leaks.find_leaks(docs, table(spark, sf_dir, "benchmark"), id_col="_row", min_words=3))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of personal data are replaced by their kind."""
    found = pii.find_pii(docs)
    return _with_text(found.withColumn("masked", pii.masked(F.coalesce("text", F.lit("")), F.col("pii"))), "masked")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 2048 tokens.

    The executors still hold what the stages before took, so the workers get less memory.
    """
    small_arrow_batches(spark)
    return packing.pack(docs, tokenizer_path("byte_bpe_50k.json"), length=2048, max_pieces=200_000, slice_bytes=2_000_000)


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("packing", pack),
]

#: Packing, like near-dedup's links over rewritten texts, is not a matter of SQL.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each but the last is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
