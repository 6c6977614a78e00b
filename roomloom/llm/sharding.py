"""Sharding by histogram sort.

Rows are ordered by the key (64-bit text hash, id), so equal texts lie side by side.  The driver keeps, for every wanted cut, an interval of
keys that must contain it.  In each round it spreads probes over the open
intervals; every partition counts bytes and rows between probes, the counts are
summed, and each interval shrinks to the piece that holds its cut.  When all
cuts are within tolerance, the rows are exchanged once.

A cut falls between two different texts, so that copies stay together, if such a
place lies within ``tolerance``, or no further off than the largest text's size;
otherwise, as inside a large group of copies, between two ids.

Rows are numbered in ranges that both these cuts and even cuts by the number of rows
bound, so that no task holds many of either bytes or rows.

Defined cases: a null text has no bytes (size 1, crc32 of nothing); a null id
sorts before all others; rows with equal text and id cannot be cut apart and
take neighbouring slots in any order; an empty table gives no rows.  Extra
columns are not carried.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

_TOP = 1 << 63
_SPAN = 1 << 64
_LAST = _SPAN * _SPAN - 1


def _split(keys: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Whole-number keys as (hash, id) pairs of longs."""
    hashes = np.array([(k // _SPAN) - _TOP for k in keys], np.int64)
    ids = np.array([(k % _SPAN) - _TOP for k in keys], np.int64)
    return hashes, ids


def bucket_of(hashes: np.ndarray, ids: np.ndarray, at: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """How many of the sorted boundaries ``at`` are not above each row's key."""
    low = np.searchsorted(at[0], hashes, "left")
    high = np.searchsorted(at[0], hashes, "right")
    tied = np.flatnonzero(low < high)
    first = low[tied]
    for k in np.unique(first).tolist():  # boundaries inside one text, side by side
        own = tied[first == k]
        low[own] = k + np.searchsorted(at[1][k : high[own[0]]], ids[own], "right")
    return low


def _counts(rows: DataFrame, keys: list[int]) -> dict[int, tuple[int, int, int, int]]:
    """bucket -> (bytes, rows, smallest key, largest key), summed over all partitions."""
    at = rows.sparkSession.sparkContext.broadcast(_split(keys))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        boundaries = at.value
        n = len(boundaries[0]) + 1
        size, number = np.zeros(n, np.int64), np.zeros(n, np.int64)
        ends: dict[int, tuple] = {}
        for batch in batches:
            h, d, s = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            if not len(h):
                continue
            order = np.lexsort((d, h))
            h, d, s = h[order], d[order], s[order]
            b = bucket_of(h, d, boundaries)
            size += np.bincount(b, s, n).astype(np.int64)
            number += np.bincount(b, minlength=n)
            first = np.flatnonzero(np.diff(b, prepend=-1))
            last = np.append(first[1:], len(b)) - 1
            for k, i, j in zip(b[first].tolist(), first, last, strict=True):
                lo, hi = (int(h[i]), int(d[i])), (int(h[j]), int(d[j]))
                old = ends.get(k)
                ends[k] = (min(old[0], lo), max(old[1], hi)) if old else (lo, hi)
        keep = sorted(ends)
        if keep:
            columns = [keep, size[keep], number[keep], *zip(*((*ends[k][0], *ends[k][1]) for k in keep), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(np.asarray(c, np.int64)) for c in columns], names=list("bsnhdij"))

    found = (
        rows.select("hash", "key_id", "size").mapInArrow(count, "b long, s long, n long, h long, d long, i long, j long")
        .groupBy("b")
        .agg(F.sum("s").alias("s"), F.sum("n").alias("n"), F.min(F.struct("h", "d")).alias("lo"), F.max(F.struct("i", "j")).alias("hi"))
        .collect()  # at most one row for each probe
    )
    number = lambda p: (p[0] + _TOP) * _SPAN + p[1] + _TOP
    return {r.b: (r.s, r.n, number(r.lo), number(r.hi)) for r in found}


def find_cuts(rows: DataFrame, parts: int, tolerance: float, probes: int = 24, rounds: int = 60) -> tuple[list[int], list[int]]:
    """Sorted cut keys that deal ``rows`` (hash, key_id, size) into ``parts`` even
    ranges, and the number of rows before each range; raises if ``rounds`` do not find them."""
    total = _counts(rows, [])
    if not total:
        return [], [0]
    size, number, lowest, highest = total[0]
    goals = [size * i / parts for i in range(1, parts)]
    slack = tolerance * size / parts
    largest = rows.agg(F.max("size")).first()[0]
    # For each goal: keys lo < cut <= hi, with the exact bytes and rows below both.
    spans = [[lowest // _SPAN * _SPAN, 0, 0, min((highest // _SPAN + 1) * _SPAN, _LAST), size, number] for _ in goals]
    cuts: list[tuple[int, int] | None] = [None] * len(goals)

    def settle(i: int) -> None:
        lo, below, rows_below, hi, upto, rows_upto = spans[i]
        goal = goals[i]
        options = [(abs(below - goal), lo, rows_below), (abs(upto - goal), hi, rows_upto)]
        between_texts = [o for o in options if o[1] % _SPAN == 0]
        # Where one text's rows fill the span, only its ids can be cut apart.
        one_text = lo // _SPAN == (hi - 1) // _SPAN
        found = [o for o in between_texts if o[0] <= (max(slack, largest) if one_text else slack)]
        if not found and one_text:
            found = [o for o in options if o[0] <= slack]
        if not found and (hi - lo <= 1 or rows_upto - rows_below <= 1):
            found = between_texts or options
        if found:
            cuts[i] = min(found)[1:]

    for _ in range(rounds):
        wanted: set[int] = set()
        for i, cut in enumerate(cuts):
            if cut is None:
                lo, hi = spans[i][0], spans[i][3]
                if hi // _SPAN - lo // _SPAN > 1:  # between texts
                    a, b = lo // _SPAN, hi // _SPAN
                    wanted.update((a + (b - a) * k // (probes + 1)) * _SPAN for k in range(1, probes + 1))
                    wanted.add((a + 1) * _SPAN)
                else:
                    wanted.update(lo + (hi - lo) * k // (probes + 1) for k in range(1, probes + 1))
                    if hi // _SPAN > lo // _SPAN:
                        wanted.add(hi // _SPAN * _SPAN)
        keys = sorted(wanted)
        if not keys:
            break
        counts = _counts(rows, keys)
        below = rows_below = 0
        edges = []  # (key, bytes below, rows below): each probe, and each end of what lies between
        for b in range(len(keys) + 1):
            if b:
                edges.append((keys[b - 1], below, rows_below))
            if b in counts:
                s, n, low, high = counts[b]
                # The same rows lie below any key from the probe on to the first row; best is one between texts.
                edges.append((max(keys[b - 1], low // _SPAN * _SPAN) if b else low // _SPAN * _SPAN, below, rows_below))
                below, rows_below = below + s, rows_below + n
                after = min((high // _SPAN + 1) * _SPAN, _LAST)
                edges.append((min(keys[b], after) if b < len(keys) else after, below, rows_below))
        edges.sort()
        bytes_below = [e[1] for e in edges]  # ascending, as the keys are
        for i, cut in enumerate(cuts):
            if cut is None:
                span, k = spans[i], bisect_right(bytes_below, goals[i])
                if k and span[0] < edges[k - 1][0] < span[3]:
                    span[:3] = edges[k - 1]
                if k < len(edges) and span[0] < edges[k][0] < span[3]:
                    span[3:] = edges[k]
                settle(i)
    if None in cuts:
        raise ArithmeticError(f"no cuts within the tolerance after {rounds} rounds")
    ordered = sorted(cuts)
    return [k for k, _ in ordered], [0, *(n for _, n in ordered)]


def shard(
    docs: DataFrame, shards: int = 16, tolerance: float = 0.002, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(id, size, text_crc32, shard, slot): shards of near equal bytes, slots from 0 without gaps.

    ``tolerance``: how far a shard's end may lie from its even place, as a share
    of a shard.  Each shard is laid out in several ranges, so that no task
    holds a whole shard; the slot of a row is the exact number of rows before
    its range in the shard plus its place in the range.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = written(
        docs.select(
            F.col(id_col).alias("id"),
            F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))).alias("key_id"),
            F.xxhash64(text).alias("hash"),
            (F.octet_length(text) + 1).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
        )
    )
    cuts, before = find_cuts(rows, shards, tolerance)
    finer = find_cuts(rows.withColumn("size", F.lit(1).cast("long")), max(shards, int(spark.conf.get("spark.sql.shuffle.partitions"))), 0.2)
    first_rows = {0: 0} | dict(zip(finer[0], finer[1][1:], strict=True)) | dict(zip(cuts, before[1:], strict=True))
    shard_of = np.searchsorted(np.array(cuts, object), list(sorted(first_rows)), "right").tolist() if cuts else [0]
    shard_rows = dict(enumerate(before))
    # Of each range: its shard, and the rows before it within its shard.
    base = [first_rows[k] - shard_rows[s] for k, s in zip(sorted(first_rows), shard_of, strict=True)]
    at = spark.sparkContext.broadcast((_split(sorted(first_rows)[1:]), np.array(shard_of), np.array(base)))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h, d = (batch.column(batch.schema.names.index(c)).to_numpy(zero_copy_only=False) for c in ("hash", "key_id"))
            cuts, shard_of, base = at.value
            k = bucket_of(h, d, cuts)
            new = [pa.array(k, pa.int64()), pa.array(shard_of[k], pa.int32()), pa.array(base[k], pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=[*batch.schema.names, "range", "shard", "base"])

    kind = dict(rows.dtypes)["id"]
    placed = rows.mapInArrow(place, f"id {kind}, key_id long, hash long, size long, text_crc32 long, range long, shard int, base long")
    order = Window.partitionBy("range").orderBy("hash", "key_id")
    slot = (F.col("base") + F.row_number().over(order) - 1).alias("slot")
    return placed.select(F.col("id").alias(id_col), "size", "text_crc32", "shard", slot)
