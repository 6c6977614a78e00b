"""Packing by order-preserving dynamic programming.

The ids of the documents, in the order of the input, form one stream in each
partition.  Windows are cut from it at document ends (free), sentence ends (a
small penalty) or, where a sentence outgrows a window, anywhere (a large one), so
that padding plus penalties plus a price for each window is least:

    f(j) = price + penalty(j) + min( min over j - L <= i < j of f(i) + L - (j - i),
                                     min over powers of two p <= L of f(j - p) )

as a window is padded to L, but not when its length is a power of two.  The price keeps
short windows of that kind a last resort: without it they cost nothing, and a stream falls
into many more sequences than it fills.  The first minimum is over f(i) + i, so a
monotone queue gives it in constant time.

The programme runs over stretches of about ``stretch`` ids that end with a
document; the windows of a stretch are optimal for it.

Defined cases: a null or empty text is its end id alone; repeated rows are packed
each on its own; an empty table gives no rows; extra columns are not carried.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import encoder, slices

#: Marks that end a sentence.
SENTENCE_ENDS = (".", "!", "?", "\n")


def best_cuts(points: list[int], penalties: list[float], length: int, window_price: float = 0.0) -> list[int]:
    """The cheapest subset of ``points`` (ascending, from 0 to the end) as window cuts.

    ``penalties[k]`` is the price of cutting at ``points[k]``, ``window_price`` that of each
    window; neighbouring points are at most ``length`` apart.
    """
    n = len(points)
    cost = [0.0] * n
    back = [0] * n
    # All (point, earlier point) at a power of two from each other, by point.
    at = np.array(points)
    place = np.full(points[-1] + 1, -1)
    place[at] = np.arange(n)
    found = [(k := np.flatnonzero(at >= p), place[at[k] - p]) for p in (1 << b for b in range(length.bit_length())) if p <= length]
    later, earlier = (np.concatenate([f[i] for f in found]) for i in (0, 1))
    later, earlier = later[earlier >= 0], earlier[earlier >= 0]
    order = np.argsort(later, kind="stable")
    earlier = earlier[order].tolist()
    bounds = np.searchsorted(later[order], np.arange(n + 1)).tolist()
    queue: deque[tuple[float, int, int]] = deque([(0.0, 0, 0)])  # f(i) + i ascending, position, index
    for k in range(1, n):
        j = points[k]
        while queue[0][1] < j - length:
            queue.popleft()
        head = queue[0]
        best, source = head[0] + length - j, head[2]
        for i in earlier[bounds[k] : bounds[k + 1]]:
            if cost[i] < best:
                best, source = cost[i], i
        best += penalties[k] + window_price
        cost[k], back[k] = best, source
        value = best + j
        while queue and queue[-1][0] >= value:
            queue.pop()
        queue.append((value, j, k))
    cuts = [n - 1]
    while cuts[-1]:
        cuts.append(back[cuts[-1]])
    return [points[k] for k in reversed(cuts)]


def cut_points(ids: np.ndarray, ends: np.ndarray, sentence: np.ndarray, length: int, sentence_penalty: float, other_penalty: float) -> tuple[list[int], list[float]]:
    """Where a stretch may be cut and at what price: document ends, sentence ends,
    and as many others as keep neighbours ``length`` apart at most."""
    price = np.full(len(ids) + 1, np.inf)
    price[1:][sentence[ids]] = sentence_penalty
    price[ends] = 0
    price[0] = price[-1] = 0
    points = np.flatnonzero(np.isfinite(price))
    gaps = np.diff(points)
    for i in np.flatnonzero(gaps > length):
        extra = np.arange(points[i] + length, points[i + 1], length)
        price[extra] = other_penalty
    points = np.flatnonzero(np.isfinite(price))
    return points.tolist(), price[points].tolist()


def pack(
    docs: DataFrame,
    tokenizer_path: str,
    length: int = 2048,
    sentence_penalty: float = 2.0,
    other_penalty: float = 32.0,
    window_price: float | None = None,
    stretch: int = 500_000,
    max_pieces: int = 800_000,
    slice_bytes: int = 8_000_000,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row a piece: (id, start, length, ids, doc_tokens, sequence_id, offset).

    ``ids`` are little-endian unsigned 32-bit; the pieces of a ``sequence_id`` in
    order of ``offset`` are the sequence.  ``window_price`` is a thirty-second of the length
    unless given.  No row is shuffled.  ``max_pieces`` (the
    encoder's cache) and ``slice_bytes`` (texts encoded at once) set a worker's
    memory against its time; the first changes no row, the second only where a
    stretch ends.
    """
    kind = dict(docs.dtypes)[id_col]
    each = length / 32 if window_price is None else window_price

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = encoder(tokenizer_path, max_pieces)
        vocabulary = tokens.tokenizer.get_vocab_size()
        decoded = tokens.tokenizer.decode_batch([[i] for i in range(vocabulary)])
        sentence = np.fromiter((x.endswith(SENTENCE_ENDS) for x in decoded), bool, vocabulary)
        base = TaskContext.get().partitionId() << 40
        number = held = 0
        own: list[pa.Array] = []
        ids: list[np.ndarray] = []

        def windows() -> Iterator[pa.RecordBatch]:
            nonlocal number
            sizes = np.array([len(x) for x in ids])
            flat, ends = np.concatenate(ids), np.cumsum(sizes)
            cuts = np.array(best_cuts(*cut_points(flat, ends, sentence, length, sentence_penalty, other_penalty), length, each))
            edges = np.union1d(cuts, np.concatenate([[0], ends]))
            start, size = edges[:-1], np.diff(edges)
            doc = np.searchsorted(ends, start, "right")
            sequence = np.searchsorted(cuts, start, "right") - 1
            doc_ids = pa.concat_arrays(own)
            for a in range(0, len(start), 2000):
                s = slice(a, a + 2000)
                yield pa.RecordBatch.from_arrays(
                    [
                        doc_ids.take(pa.array(doc[s])),
                        pa.array(start[s] - (ends - sizes)[doc[s]]),
                        pa.array(size[s]),
                        pa.array([flat[i : i + n].astype("<u4").tobytes() for i, n in zip(start[s], size[s], strict=True)], pa.binary()),
                        pa.array(sizes[doc[s]]),
                        pa.array(base + number + sequence[s]),
                        pa.array(start[s] - cuts[sequence[s]]),
                    ],
                    names=["id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"],
                )
            number += len(cuts) - 1

        for batch in batches:
            for a, b in slices(batch.column(1), slice_bytes):
                own.append(batch.column(0)[a:b])
                ids += tokens.encode(batch.column(1)[a:b])
                held += sum(map(len, ids[-(b - a):]))
                if held >= stretch:
                    yield from windows()
                    own, ids, held = [], [], 0
        if ids:
            yield from windows()

    pieces = docs.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(
        run, f"id {kind}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
    )
    return pieces.withColumnRenamed("id", id_col) if id_col != "id" else pieces
