"""Exact k-means over integer vectors that scans a vector again only when its bounds allow a change.

Every scan of a vector leaves a record: its cluster and the gap between the distance
to the second nearest centroid (lower) and to its own (upper).  A round moves the own
centroid by ``a`` and any other by at most ``b``, so the gap shrinks by at most a + b.
That drift is the same for all records of a cluster and is added up in one offset a
cluster; a record is stored once, under the key gap + offset at its birth, and stands
until the offset reaches the key.  The records of a cluster ordered by that key are its
heap: they lie in sorted files, and popping is a range read of those keys that the
round's drift has passed, which Parquet answers from its statistics.  Only popped
vectors are read, compared with all centroids in exact integers, and pushed again as
records of the round.  Whether a record stands follows from its own key, so no state is
joined or rewritten; sums of the clusters change by the vectors that changed cluster.

The driver holds k centroids and the sums of k clusters.  Every round is a written
table in the shared folder, so that lost executors repeat no earlier round.

Defined cases: vectors that are null, of other than ``dims`` components, or with null or
non-finite components are left out; an empty table gives no rows, fewer vectors than k
give fewer centroids.  Rows with a null id are clustered, but never start a centroid; repeated
ids are rows of their own.  Among equal start hashes the smaller vector comes first;
equal distances go to the smaller number; an empty cluster keeps its centroid.  Other
columns are not read.  Integers beyond 2^27 would overflow the distances: they raise.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_folder

LIMIT = 1 << 27
#: More than rounding can move a gap: distances stay below 2^32, known to 2^-20.
SLACK = 1e-3


def finite_vectors(vector: str, dims: int | None) -> Column:
    """Whether a vector has ``dims`` components (None: any number), none of them null, NaN or infinite."""
    def good(e: Column) -> Column:
        return e.isNotNull() & ~F.isnan(e.cast("double")) & (F.abs(e.cast("double")) < F.lit(float("inf")))

    whole = F.col(vector).isNotNull() & F.forall(vector, good)
    return whole if dims is None else whole & (F.size(vector) == dims)


def integers(df: DataFrame, vector: str, id_col: str, scale: int, dims: int) -> DataFrame:
    """(id, x): floor(scale * component) of the usable vectors."""
    def whole(e: Column) -> Column:
        v = F.floor(e.cast("double") * scale)
        return F.when(F.abs(e.cast("double") * scale) < LIMIT, v).otherwise(F.raise_error(F.lit("a component is too large for exact distances")).cast("long")).cast("int")

    return df.filter(finite_vectors(vector, dims)).select(F.col(id_col).alias("id"), F.transform(vector, whole).alias("x"))


def _matrix(column: pa.ChunkedArray | pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dims)


def _squares(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.stack([((x - c) ** 2).sum(axis=1) for c in centres], axis=1)


def _scanned(rows: DataFrame, centres: np.ndarray, offsets: list[float], schema: str) -> DataFrame:
    """(id, x, was) with ``cluster`` and ``key`` from distances to all centroids."""
    k, dims = centres.shape

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            d = _squares(_matrix(b.column("x"), dims), centres)
            near = d.argmin(axis=1)
            own = np.take_along_axis(d, near[:, None], 1)[:, 0]
            d[np.arange(len(d)), near] = np.iinfo(np.int64).max
            gap = np.sqrt(d.min(axis=1).astype(float)) - np.sqrt(own.astype(float)) if k > 1 else np.full(len(d), np.inf)
            yield pa.RecordBatch.from_arrays(
                [b.column("id"), b.column("x"), b.column("was"), pa.array(near, pa.int32()), pa.array(gap + np.array(offsets)[near])],
                names=["id", "x", "was", "cluster", "key"],
            )

    return rows.select("id", "x", "was").mapInArrow(scan, schema)


class _Heaps:
    """The records of all rounds, one folder a round."""

    def __init__(self, spark: SparkSession, schema: str):
        self.spark, self.schema, self.base, self.rounds = spark, schema, shared_folder(spark), 0

    def push(self, records: DataFrame) -> DataFrame:
        path = f"{self.base}/round={self.rounds}"
        records.sortWithinPartitions("cluster", "key").write.parquet(path)
        self.rounds += 1
        return self.spark.read.schema(self.schema).parquet(path)

    def _read(self, first: int, last: int) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(*(f"{self.base}/round={r}" for r in range(first, last)))

    def expired(self, before: list[float], now: list[float]) -> DataFrame:
        """Records that stood under the offsets ``before`` and do not under ``now``; those of
        the last round have met none yet."""
        newest = self._read(self.rounds - 1, self.rounds).filter(_any_cluster(now, lambda n: F.col("key") <= n + SLACK))
        if self.rounds == 1:
            return newest
        passed = [(b, n) for b, n in zip(before, now)]
        older = self._read(0, self.rounds - 1).filter(_any_cluster(passed, lambda p: (F.col("key") > p[0] + SLACK) & (F.col("key") <= p[1] + SLACK)))
        return newest.unionByName(older)

    def standing(self, now: list[float]) -> DataFrame:
        """One record of each vector: all of the last round, and the older that still stand."""
        newest = self._read(self.rounds - 1, self.rounds)
        if self.rounds == 1:
            return newest
        return newest.unionByName(self._read(0, self.rounds - 1).filter(_any_cluster(now, lambda n: F.col("key") > n + SLACK)))


def _any_cluster(values: list, test) -> Column:
    return reduce(lambda a, b: a | b, ((F.col("cluster") == j) & test(v) for j, v in enumerate(values)))


def _starts(vectors: DataFrame, k: int, seed: int) -> list[list[int]]:
    """The vectors of the smallest hashes of ``seed:id``."""
    hashed = vectors.filter("id is not null").withColumn("h", F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256))
    return [list(r.x) for r in hashed.orderBy("h", "x").limit(k).collect()]


def _moved_sums(records: DataFrame, sums: list[list[int]], counts: list[int]) -> None:
    """Takes vectors that changed cluster from the old sums and adds them to the new."""
    dims = len(sums[0])
    changed = records.filter("was is null or was <> cluster").groupBy("was", "cluster")
    for r in changed.agg(F.count("*").alias("n"), *(F.sum(F.col("x")[i].cast("long")).alias(f"s{i}") for i in range(dims))).collect():
        for j, sign in ((r["cluster"], 1), (r["was"], -1)):
            if j is not None:
                counts[j] += sign * r["n"]
                sums[j] = [s + sign * r[f"s{i}"] for i, s in enumerate(sums[j])]


def cluster(vectors: DataFrame, k: int, rounds: int, seed: int = 3, id_col: str = "vec_id", vector: str = "embedding", scale: int = 1024, dims: int = 64) -> DataFrame:
    """(id, cluster, distance, cluster_inertia, inertia, centroid) of every usable vector after
    ``rounds`` rounds and a last assignment; distances are squared."""
    spark = vectors.sparkSession
    kind = dict(vectors.dtypes)[id_col]
    schema = f"id {kind}, x array<int>, was int, cluster int, key double"
    x = integers(vectors, vector, id_col, scale, dims)
    centres = _starts(x, k, seed)
    k = len(centres)
    if not k:
        out = f"id {kind}, cluster int, distance long, cluster_inertia long, inertia long, centroid array<long>"
        return spark.createDataFrame([], out)
    offsets = [0.0] * k
    sums, counts = [[0] * dims for _ in range(k)], [0] * k
    heaps = _Heaps(spark, schema)
    popped = x.withColumn("was", F.lit(None).cast("int"))
    for turn in range(rounds + 1):
        records = heaps.push(_scanned(popped, np.array(centres, np.int64), offsets, schema))
        if turn == rounds:
            break
        _moved_sums(records, sums, counts)
        after = [[s // n for s in row] if n else c for row, n, c in zip(sums, counts, centres)]
        drift = [float(np.sqrt(float(sum((p - q) ** 2 for p, q in zip(a, b))))) for a, b in zip(after, centres)]
        most = [max((d for i, d in enumerate(drift) if i != j), default=0.0) for j in range(k)]
        before, offsets = offsets, [o + own + other for o, own, other in zip(offsets, drift, most)]
        centres = after
        popped = heaps.expired(before, offsets).select("id", "x", F.col("cluster").alias("was"))
    return _described(heaps, offsets, centres, kind)


def _described(heaps: _Heaps, offsets: list[float], centres: list[list[int]], kind: str) -> DataFrame:
    """Every standing record with its distance and the sums of distances."""
    dims, known = len(centres[0]), np.array(centres, np.int64)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = known[b.column("cluster").to_numpy(zero_copy_only=False)]
            d = ((_matrix(b.column("x"), dims) - own) ** 2).sum(axis=1)
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("cluster"), pa.array(d, pa.int64())], names=["id", "cluster", "distance"])

    measured = heaps.standing(offsets).mapInArrow(measure, f"id {kind}, cluster int, distance long")
    total = {r["cluster"]: r["n"] for r in measured.groupBy("cluster").agg(F.sum("distance").alias("n")).collect()}
    per_cluster = F.array(*(F.lit(total.get(j, 0)).cast("long") for j in range(len(centres))))
    parts = F.array(*(F.array(*(F.lit(v).cast("long") for v in c)) for c in centres))
    return measured.select(
        "id", "cluster", "distance", F.get(per_cluster, F.col("cluster")).alias("cluster_inertia"),
        F.lit(sum(total.values())).cast("long").alias("inertia"), F.get(parts, F.col("cluster")).alias("centroid"),
    )


def centroid_digest(centroid: Column) -> Column:
    """Lower-case hex sha256 of the components in decimal, joined by commas."""
    return F.sha2(F.array_join(F.transform(centroid, lambda v: v.cast("string")), ","), 256)
