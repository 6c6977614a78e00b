"""What the corpus operators share: tables in the shared folder, checked broadcasts, words."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed value: a word of the contracts is a run of anything but these.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"

_own_folder: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """A new folder under ``spark.checkpoint.dir``, which driver and executors share.

    Where that setting is unset, a temporary folder of this machine serves a local
    master, as in tests; a cluster must name its folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        if "base" not in _own_folder:
            _own_folder["base"] = tempfile.mkdtemp(prefix="spark-")
        base = _own_folder["base"]
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends here.

    The files stay until the owner of ``spark.checkpoint.dir`` clears it.
    """
    spark = df.sparkSession
    path = shared_folder(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_arrow_batches(spark: SparkSession, size: str = "8m") -> None:
    """Bound what one batch brings into a Python worker, however long the texts are.

    A setting of the session, read when a query runs: an application sets it, as the
    queries and the pipeline do; operators leave the session alone.
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def stored_bytes(df: DataFrame) -> int:
    """About what the rows take in memory: their strings and arrays as they are, 16 bytes for any other value."""
    def width(name: str, kind: str) -> Column:
        if kind in ("string", "binary"):
            return F.coalesce(F.octet_length(name), F.lit(0)) + 16
        return F.greatest(F.size(name), F.lit(0)) * 16 + 16 if kind.startswith("array") else F.lit(16)

    return df.agg(F.sum(sum((width(f"`{n}`", k) for n, k in df.dtypes), F.lit(0)).cast("long")).alias("n")).first().n or 0


def if_small(df: DataFrame, max_bytes: int = 64 << 20) -> DataFrame:
    """``df`` marked for broadcast when it has at most ``max_bytes``, else as it is.

    Use it on written tables of plain columns only: it reads them.
    """
    return F.broadcast(df) if stored_bytes(df) <= max_bytes else df


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names for new columns, those given with underscores behind them until no column of ``df`` has them."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once for a row, however often ``body`` uses it."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    """Array of the words of a text; null has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def ascii_lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
