"""Near-dedup: banded MinHash, odd sketches, exact confirmation, components.

A document's set is its distinct shingles of five lower-cased words.  128 MinHash
samples a set give 32 bands of 4 (a pair at similarity 0.75 shares no band once
in 200,000), and are folded into an odd sketch: a bitmap of 512 bits in which
every (place, sample) flips one bit.  The XOR of two sketches has a bit for every
sample that differs, so its population count estimates high similarities
closely, and drops candidates far below the threshold.  A second odd sketch, of
1024 bits, folds the shingles themselves: its XOR counts those that only one of
two sets holds.  With the sets' sizes that tells small sets of similarity 0.7
from those of 0.75; for sets of many thousands it fills up and drops nothing.
Survivors are confirmed on their full sets.

Equal sets are one node.  Every node first meets one other only: of the smallest
nodes by id of its buckets (documents with an equal band) the one that most of
them name.  Where much is left apart, more stars follow: who is not of a bucket's
largest component meets one member of it.  Buckets that still hold several components
are then searched for links between those: the members of each component but the
bucket's largest one are dealt to all cells of the bucket, of about ``block`` nodes
each, and meet there what belongs to other components.  So the largest component never
meets itself, and no links are lost.

Defined cases: a text without words has an empty set and is linked with nothing;
rows that share an id are one document for links (what either links is linked), and
each keeps its own set size; rows without id link others like any row, and get a null
component, being kept then, only where no id is reachable; an empty table gives no
rows; extra columns are not carried.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import if_small, written
from .components import components
from .hashing import mixed, numbers, shingles, word_hashes, word_table
from .tokens import slices

SAMPLES, ROWS, BITS, SET_BITS = 128, 4, 512, 1024
BANDS = SAMPLES // ROWS

_U = np.uint64


def minhashes(own: np.ndarray) -> np.ndarray:
    """The smallest value of the set under each of ``SAMPLES`` hash functions."""
    a, b = numbers(11, SAMPLES) | _U(1), numbers(12, SAMPLES)
    best = np.full(SAMPLES, ~_U(0))
    for i in range(0, len(own), 2048):
        part = own[None, i : i + 2048]
        np.minimum(best, (a[:, None] * part + b[:, None]).min(1), out=best)
    return best


def band_keys(samples: np.ndarray) -> np.ndarray:
    """One key for each band and its place, of rows of samples."""
    out = np.repeat(numbers(13, BANDS)[None, :], len(samples), 0)
    for k in range(ROWS):
        out = mixed(out + samples[:, k::ROWS])
    return out.view(np.int64)


def odd_sketches(samples: np.ndarray) -> np.ndarray:
    """Parity bitmaps of (place, sample), as rows of longs."""
    at = (mixed(samples + numbers(14, SAMPLES)[None, :]) % _U(BITS)).astype(np.int64)
    n = len(samples)
    parity = np.bincount((np.arange(n)[:, None] * BITS + at).ravel(), minlength=n * BITS).astype(np.uint8) & 1
    return np.packbits(parity.reshape(n, BITS), axis=1, bitorder="little").view(np.int64)


def set_sketch(own: np.ndarray) -> np.ndarray:
    """Parity bitmap of the set itself, as a row of longs."""
    at = (mixed(own + numbers(15, 1)) % _U(SET_BITS)).astype(np.int64)
    parity = np.bincount(at, minlength=SET_BITS).astype(np.uint8) & 1
    return np.packbits(parity, bitorder="little").view(np.int64)


def most_bits(similarity: float) -> int:
    """Expected population count of the XOR of two sketches at a similarity."""
    flips = 2 * SAMPLES * (1 - similarity)
    return math.ceil(BITS / 2 * (1 - (1 - 2 / BITS) ** flips))


def _sets(texts: pa.Array, size: int) -> list[np.ndarray]:
    words, bounds = word_hashes(texts, word_table())
    return [np.unique(shingles(words[a:b], size)) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


def _digest(own: np.ndarray) -> bytes | None:
    return hashlib.blake2b(own.tobytes(), digest_size=16).digest() if len(own) else None


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("h"), F.col(text_col).alias("text"))


def fingerprints(docs: DataFrame, size: int, id_col: str, text_col: str) -> DataFrame:
    """(id, h, n, digest, bands, sketch, whole) a row, ``h`` a hash of its text; the last four are null for an empty set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch.column(2), 1_000_000):
                sets = _sets(batch.column(2)[a:b], size)
                samples = np.stack([minhashes(s) for s in sets])
                bands, sketch, empty = band_keys(samples), odd_sketches(samples), np.array([not len(s) for s in sets])
                whole = np.stack([set_sketch(s) for s in sets])
                lists = lambda x: pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1]), pa.int32()), pa.array(x.ravel()), mask=pa.array(empty))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[a:b], batch.column(1)[a:b], pa.array([len(s) for s in sets], pa.int64()), pa.array([_digest(s) for s in sets], pa.binary()), lists(bands), lists(sketch), lists(whole)],
                    names=["id", "h", "n", "digest", "bands", "sketch", "whole"],
                )

    return _rows(docs, id_col, text_col).mapInArrow(run, "id long, h long, n long, digest binary, bands array<long>, sketch array<long>, whole array<long>")


def flat(nodes: DataFrame) -> DataFrame:
    """(node, n, s0.., w0..): a column for each long of the sketches, so that ``alike`` is compiled small."""
    return nodes.select("node", "n", *(F.col(c)[k].alias(f"{c[0]}{k}") for c, bits in (("sketch", BITS), ("whole", SET_BITS)) for k in range(bits // 64)))


def differing_bits(x: str, y: str, kind: str, bits: int) -> Column:
    return sum((F.bit_count(F.col(f"{x}.{kind}{k}").bitwiseXOR(F.col(f"{y}.{kind}{k}"))) for k in range(bits // 64)), F.lit(0))


def most_set_bits(both_sizes: Column, threshold: int) -> Column:
    """What the XOR of two sets' sketches may count where the sets reach the threshold.

    Such sets differ in at most (100 - t) / (100 + t) of the sum of their sizes.
    The count never exceeds that number d; where many of d share a bit, seven
    standard deviations above the mean count of d is the smaller bound.
    """
    d, b = F.floor(both_sizes * (100 - threshold) / (100 + threshold)), SET_BITS
    one, two = F.pow(F.lit(1 - 2 / b), d), F.pow(F.lit(1 - 4 / b), d)
    variance = F.greatest((b + b * (b - 1) * two - b * b * one * one) / 4, F.lit(0.0))
    return F.least(d.cast("double"), b / 2 * (1 - one) + 7 * F.sqrt(variance))


def alike(x: str, y: str, limit: int, threshold: int) -> Column:
    """Whether the sizes and sketches of two flat tables' nodes leave room for the threshold."""
    n, m = F.col(f"{x}.n"), F.col(f"{y}.n")
    return (
        (100 * F.least(n, m) >= threshold * F.greatest(n, m))
        & (differing_bits(x, y, "s", BITS) <= limit)
        & (differing_bits(x, y, "w", SET_BITS) <= most_set_bits(n + m, threshold))
    )


def confirm(pairs: DataFrame, docs: DataFrame, nodes: DataFrame, threshold: int, size: int, id_col: str, text_col: str, max_broadcast_bytes: int, spread: int = 1024) -> DataFrame:
    """Those of ``pairs`` (a, b) of nodes whose full sets reach the threshold.

    A node's set is made anew from one of its texts.  Where many pairs share a ``b``,
    as at the hub of a star, they meet it in several places of ``spread`` pairs.
    """
    places = written(pairs.groupBy("b").agg(F.ceil(F.count("*") / spread).cast("int").alias("places")))
    ends = pairs.select(F.col("a").alias("node"), F.lit(1).alias("places")).unionByName(places.select(F.col("b").alias("node"), "places"))
    wanted = ends.groupBy("node").agg(F.max("places").alias("places")).join(nodes.select("node", "id", "h", "digest"), "node")
    wanted = if_small(written(wanted), max_broadcast_bytes).alias("w")
    rows = _rows(docs, id_col, text_col).alias("r")
    texts = rows.join(wanted, (F.col("r.h") == F.col("w.h")) & F.col("r.id").eqNullSafe(F.col("w.id"))).select("node", "places", "text", "digest")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch.column(2), 1_000_000):
                own = _sets(batch.column(2)[a:b], size)
                # Texts of equal hash are told apart by their sets.
                same = [i for i, s in enumerate(own) if _digest(s) == batch.column(3)[a + i].as_py()]
                at = pa.array(same, pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b].take(at), batch.column(1)[a:b].take(at), pa.array([own[i].tobytes() for i in same], pa.binary())], names=["node", "places", "own"])

    # Repeated rows, and those without id, may give a node's text more than once.
    own = texts.mapInArrow(sets, "node long, places int, own binary").dropDuplicates(["node"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = (np.frombuffer(v.as_buffer(), _U) for v in (x, y))
                both = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(100 * both >= threshold * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays(batch.columns[:2], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))

    left = own.select(F.col("node").alias("a"), F.col("own").alias("x"))
    right = own.select(F.col("node").alias("b"), F.explode(F.sequence(F.lit(0), F.col("places") - 1)).alias("place"), F.col("own").alias("y"))
    dealt = pairs.join(places, "b").select("a", "b", F.pmod(F.xxhash64("a"), F.col("places")).cast("int").alias("place"))
    return dealt.join(left, "a").join(right, ["b", "place"]).select("a", "b", "x", "y").mapInArrow(compare, "a long, b long").distinct()


def same_documents(prints: DataFrame, nodes: DataFrame) -> DataFrame | None:
    """Edges (a, b) between the nodes that rows of one id name; None if every id names one."""
    named = prints.filter("n > 0 and id is not null").select("id", "digest").distinct()
    several = written(named.groupBy("id").agg(F.count("*").alias("n"), F.min("digest").alias("least")).filter("n > 1"))
    if not several.limit(1).count():
        return None
    number = lambda c: nodes.select(F.col("digest").alias(c), F.col("node").alias(f"{c}_node"))
    own = named.join(several, "id").filter("digest <> least").join(number("digest"), "digest").join(number("least"), "least")
    return own.select(F.col("digest_node").alias("a"), F.col("least_node").alias("b")).distinct()


def apart(members: DataFrame, labels: DataFrame) -> DataFrame:
    """(band, members, node, label, travels) of the buckets that hold several components;
    who is not of the largest one travels."""
    known = labels.select("node", "label")
    labelled = members.select("band", "members", "node").join(known, "node", "left").withColumn("label", F.coalesce("label", "node"))
    by_label = labelled.groupBy("band", "label").agg(F.count("*").alias("size"))
    largest = by_label.groupBy("band").agg(F.max_by("label", F.struct("size", "label")).alias("largest"), F.count("*").alias("labels")).filter("labels > 1").select("band", "largest")
    return written(labelled.join(largest, "band").select("band", "members", "node", "label", (F.col("label") != F.col("largest")).alias("travels")))


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = 5,
    threshold: int = 75,
    sketch_floor: float = 0.5,
    block: int = 1024,
    more_stars: int = 4,
    star_above: int = 32,
    max_broadcast_bytes: int = 64 << 20,
) -> DataFrame:
    """(id, n_shingles, component_id, kept) for every row.

    Two documents are linked when 100 * intersection >= ``threshold`` * union of
    their sets; ``component_id`` is the smallest id reachable.  ``sketch_floor``
    is the estimated similarity below which a candidate is not confirmed, some
    six standard deviations under the default threshold.  Up to ``more_stars`` further
    stars go before the search of whole buckets while that would meet more than
    ``star_above`` pairs a node; they change its work and not its result.
    """
    limit = most_bits(sketch_floor)
    prints = written(fingerprints(docs, shingle, id_col, text_col))
    # One numbered node for each distinct set, with its smallest id and the text of that row.
    witness = F.min(F.struct(F.col("id").isNull(), "id", "h")).alias("w")
    grouped = prints.filter("n > 0").groupBy("digest").agg(witness, *(F.first(c).alias(c) for c in ("n", "bands", "sketch", "whole")))
    nodes = written(grouped.select(F.monotonically_increasing_id().alias("node"), "w.id", "w.h", "digest", "n", "bands", "sketch", "whole"))
    banded = nodes.select("node", "id", F.explode("bands").alias("band"))
    # Of a bucket the node with the smallest id: copies are more like their original than like each other.
    least = F.coalesce(F.min_by("node", "id"), F.min("node")).alias("least")
    shared = banded.groupBy("band").agg(least, F.min("id").alias("least_id"), F.count("*").alias("members")).filter("members > 1")
    members = written(banded.drop("id").join(shared, "band"))

    sketches = flat(nodes)
    # One star a node: the least node that it meets in most buckets, of several the one with the smallest id.
    stars = (
        members.filter("node <> least").groupBy(F.col("node").alias("a"), F.col("least").alias("b")).agg(F.count("*").alias("bands"), F.first("least_id").alias("least_id"))
        .groupBy("a").agg(F.max_by("b", F.struct("bands", F.col("least_id").isNotNull(), -F.col("least_id"))).alias("b"))
    )
    x, y = sketches.alias("x"), sketches.alias("y")
    first = written(
        stars.join(x, F.col("a") == F.col("x.node")).join(y, (F.col("b") == F.col("y.node")) & alike("x", "y", limit, threshold)).select("a", "b")
    )
    check = lambda pairs: written(confirm(pairs, docs, nodes, threshold, shingle, id_col, text_col, max_broadcast_bytes))
    links = check(first)
    if (shared_ids := same_documents(prints, nodes)) is not None:
        links = written(links.unionByName(shared_ids))
    labels = components(links)

    # What the stars left apart: buckets with several components.
    tested, before = first, None
    pending = apart(members, labels)
    for number in range(more_stars):
        work = pending.groupBy("band").agg((F.count_if("travels") * F.first("members")).alias("pairs"), F.first("members").alias("members")).agg(F.sum("pairs"), F.sum("members")).first()
        if (work[0] or 0) <= star_above * (work[1] or 0) or before and work[0] > before / 2:
            break  # little is left, or the last star joined little
        before = work[0]
        # Another star: who is not of a bucket's largest component meets one member of it.
        hubs = pending.filter("not travels").groupBy("band").agg(F.min_by("node", F.xxhash64("node", F.lit(number))).alias("hub"))
        tries = pending.filter("travels").join(hubs, "band").select(F.col("node").alias("a"), F.col("hub").alias("b")).distinct().join(tested, ["a", "b"], "left_anti")
        x, y = sketches.alias("x"), sketches.alias("y")
        met = tries.join(x, F.col("a") == F.col("x.node")).join(y, (F.col("b") == F.col("y.node")) & alike("x", "y", limit, threshold)).select("a", "b")
        met = written(met)
        tested = tested.unionByName(met)
        links = written(links.unionByName(check(met)))
        labels = components(links)
        pending = apart(members, labels)
    cells = F.ceil(F.col("members") / block).cast("int")
    seen = pending.join(sketches, "node")
    y = seen.withColumn("cell", F.pmod(F.xxhash64("node"), cells).cast("int")).alias("y")
    x = seen.filter("travels").withColumn("cell", F.explode(F.sequence(F.lit(0), cells - 1))).alias("x")
    met = x.join(
        y,
        (F.col("x.band") == F.col("y.band")) & (F.col("x.cell") == F.col("y.cell")) & (F.col("x.label") != F.col("y.label"))
        & (~F.col("y.travels") | (F.col("x.node") > F.col("y.node"))) & alike("x", "y", limit, threshold),
    ).select(F.greatest("x.node", "y.node").alias("a"), F.least("x.node", "y.node").alias("b"))
    rest = written(met.distinct().join(tested.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")), ["a", "b"], "left_anti"))
    if rest.limit(1).count():
        labels = components(links.unionByName(check(rest)))

    placed = nodes.select("digest", "node", "id").join(labels, "node", "left").select("digest", "id", F.coalesce("label", "node").alias("label"))
    least = placed.groupBy("label").agg(F.min("id").alias("component_id"))
    node_labels = placed.join(least, "label").select("digest", "component_id")
    out = prints.select("id", "n", "digest").join(node_labels, "digest", "left")
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))
