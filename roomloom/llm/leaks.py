"""Benchmark decontamination: a BM25 index of the test items, searched with block-max WAND.

Terms are runs of three lower-cased words, so that ordinary prose meets few
postings; an item of one or two words is one run of its own length.  The index keeps
for each term its postings in item order, cut into blocks of ``block`` items, with
the largest weight of every block and of the whole list.  Weights are divided by the
item's own score, so that one threshold serves all items.  Every passage of every
document is a query: windows of ``passage`` words, each starting half a window after the
last, so that any item of up to half of them lies whole in one.  Longer items are searched
by themselves, in windows of the power of two that is at least twice their length, so
that a long item changes nothing for the others.

Passages whose terms' upper bounds do not add up to the threshold are done.  In the
others a pivot is found, the first item at which the upper bounds of the lists so far
reach the threshold; if the maxima of the pivot's blocks do not, all these lists skip
behind the block, else they move to the pivot and it is scored.  All items at or above
the threshold are verified: the question is the item without its last sentence, the
answer is that sentence, and both are sought in the passage as runs of five words.

Up to ``index_items`` items of up to ``index_bytes`` bytes the index is broadcast.  More are dealt
into parts of that size by hash: the documents are read once, their passages that may hold a term (a
bitmap of fixed size tells) are joined by term with the parts that have it, and each
part's index is built by the tasks that search it.  Weights come from counts over all
items, so that scores do not depend on the number of parts.

Defined cases: null or empty texts and items match nothing; items under ``min_words``
words are left out, none by default; equal items each match; repeated rows of a
document give one row; null ids are kept; an empty table gives no rows; extra columns
are not carried.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written
from .hashing import shingles, word_hashes, word_table
from .tokens import slices

_U = np.uint64
_TERM, _SHINGLE = 3, 5
_SENTENCE = re.compile(r"(?<=[.!?])\s+|\n+")


def question_and_answer(text: str) -> tuple[str, str]:
    """The item without its last sentence, and that sentence; of one sentence both are the item."""
    parts = [p for p in _SENTENCE.split(text.strip()) if p]
    if len(parts) < 2:
        return text, text
    return text[: text.rstrip().rindex(parts[-1])], parts[-1]


def _words(text: str) -> np.ndarray:
    return word_hashes(pa.array([text]), word_table(marks=True))[0]


@dataclass
class Index:
    """Postings of all terms in a row: term ``t`` owns ``starts[t]:starts[t+1]``, and
    of the blocks ``block_starts[t]:block_starts[t+1]``."""

    item_ids: list
    terms: np.ndarray
    starts: np.ndarray
    items: np.ndarray
    weights: np.ndarray
    block_starts: np.ndarray
    blocks: np.ndarray
    block_max: np.ndarray
    term_max: np.ndarray
    block: int
    longest: int
    sizes: list
    whole: list
    question: list
    answer: list


@dataclass
class Counts:
    """Over all indexes: the number of items with a term, their mean number of terms,
    and of sorted terms the number of items that hold them."""

    n_items: int
    mean: float
    terms: np.ndarray
    df: np.ndarray


def _terms(words: np.ndarray) -> np.ndarray:
    """The runs of an item's words that are its terms."""
    return shingles(words, _TERM)


def item_terms(items: DataFrame) -> DataFrame:
    """(part, item, text, n_words, n_terms, terms) of the items (part, item, text) with a word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [_words(t or "") for t in batch.column(2).to_pylist()]
            runs = [_terms(w) for w in words]
            numbers = [pa.array([len(x) for x in each], pa.int64()) for each in (words, runs)]
            own = pa.array([np.unique(r).view(np.int64) for r in runs], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([*batch.columns, *numbers, own], names=["part", "item", "text", "n_words", "n_terms", "terms"])

    found = items.select("part", "item", "text").mapInArrow(run, "part int, item long, text string, n_words long, n_terms long, terms array<long>")
    return found.filter("n_terms > 0")


def build_index(rows: list[tuple], block: int = 32, k1: float = 1.2, b: float = 0.75, overall: Counts | None = None) -> Index | None:
    """The index of (item id, text) rows, weighed by ``overall`` or else by themselves; None if no item has a term."""
    rows = [(i, t, w) for i, t in rows if t and len(w := _words(t))]
    if not rows:
        return None
    words = [r[2] for r in rows]
    own = [np.unique(_terms(w), return_counts=True) for w in words]
    terms, term = np.unique(np.concatenate([t for t, _ in own]), return_inverse=True)
    item = np.repeat(np.arange(len(own)), [len(t) for t, _ in own])
    tf = np.concatenate([c for _, c in own]).astype(float)
    n_terms = np.array([c.sum() for _, c in own], float)
    overall = overall or Counts(len(own), n_terms.mean(), terms, np.bincount(term))
    df = overall.df[np.searchsorted(overall.terms, terms)]
    idf = np.log(1 + (overall.n_items - df + 0.5) / (df + 0.5))
    weight = idf[term] * tf * (k1 + 1) / (tf + k1 * (1 - b + b * (n_terms / overall.mean)[item]))
    weight /= np.bincount(item, weight)[item]
    order = np.lexsort((item, term))
    term, item, weight = term[order], item[order], weight[order]
    count = lambda x: np.concatenate([[0], np.cumsum(np.bincount(x, minlength=len(terms)))])
    first = np.flatnonzero(np.diff(term * (len(own) + 1) + item // block, prepend=-1))
    # Parts under five words are sought as a whole, as one run of their own length.
    sets = lambda ws: [(min(len(w), _SHINGLE), np.unique(shingles(w, _SHINGLE))) for w in ws]
    split = [question_and_answer(r[1]) for r in rows]
    return Index(
        [r[0] for r in rows], terms, count(term), item, weight, count(term[first]), item[first] // block, np.maximum.reduceat(weight, first),
        np.maximum.reduceat(weight, count(term)[:-1]), block, max(map(len, words)), sorted({min(len(w), _TERM) for w in words}), sets(words), sets([_words(q) for q, _ in split]), sets([_words(a) for _, a in split]),
    )


class _List:
    """A place in the postings of one term."""

    __slots__ = ("at", "block_end", "block_start", "end", "index", "item", "term")

    def __init__(self, index: Index, term: int):
        self.index, self.term = index, term
        self.at, self.end = int(index.starts[term]), int(index.starts[term + 1])
        self.block_start, self.block_end = int(index.block_starts[term]), int(index.block_starts[term + 1])
        self.item = int(index.items[self.at])

    def move_to(self, item: int) -> bool:
        """To the first posting at or behind ``item``; whether there is one."""
        self.at = bisect_left(self.index.items, item, self.at, self.end)
        if self.at < self.end:
            self.item = int(self.index.items[self.at])
        return self.at < self.end

    def max_in(self, block: int) -> float:
        k = self.block_start = bisect_left(self.index.blocks, block, self.block_start, self.block_end)
        return float(self.index.block_max[k]) if k < self.block_end and self.index.blocks[k] == block else 0.0


def block_max_wand(index: Index, terms: list[int], threshold: float) -> Iterator[tuple[int, float]]:
    """(item, score) of the items that score ``threshold`` or more for the distinct ``terms``."""
    lists = [_List(index, t) for t in terms]
    bound = {t: float(index.term_max[t]) for t in terms}
    while lists:
        lists.sort(key=lambda x: x.item)
        reach, k = 0.0, 0
        while k < len(lists) and (reach := reach + bound[lists[k].term]) < threshold:
            k += 1
        if k == len(lists):
            return
        pivot = lists[k].item
        while k + 1 < len(lists) and lists[k + 1].item == pivot:
            k += 1
        near, far = lists[: k + 1], lists[k + 1 :]
        block = pivot // index.block
        if sum(x.max_in(block) for x in near) < threshold:
            # Nothing before the next list's item, or the block's end, can reach it.
            goal = min((block + 1) * index.block, far[0].item if far else (block + 1) * index.block)
        else:
            goal = pivot
            if near[0].item == pivot:
                score = sum(float(index.weights[x.at]) for x in near)
                if score >= threshold:
                    yield pivot, score
                goal = pivot + 1
        lists = [x for x in near if x.move_to(goal)] + far


def search(index: Index, passage: np.ndarray, term: np.ndarray, threshold: float) -> list[tuple[int, int, float]]:
    """(passage, item, score) of all scores at or above ``threshold``, for queries
    given as distinct (passage, term) pairs, sorted."""
    threshold -= 1e-9
    found: list[tuple[int, int, float]] = []
    if not len(passage):
        return found
    first = np.flatnonzero(np.diff(passage, prepend=passage[0] - 1))
    reach = np.add.reduceat(index.term_max[term], first)
    last = np.append(first[1:], len(passage))
    for k in np.flatnonzero(reach >= threshold).tolist():
        own = term[first[k] : last[k]].tolist()
        found += [(int(passage[first[k]]), item, score) for item, score in block_max_wand(index, own, threshold)]
    return found


def _share(part: tuple[int, np.ndarray], words: np.ndarray) -> float:
    """The share of a part's runs that ``words`` hold."""
    size, wanted = part
    if not size:
        return 1.0
    return float(np.isin(wanted, shingles(words, size)).mean()) if len(words) >= size else 0.0


def _bits(terms: np.ndarray, bits: int) -> np.ndarray:
    return terms >> _U(64 - bits)


def term_places(words: np.ndarray, bounds: np.ndarray, sizes: list[int], known: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, document, term) of the runs of ``sizes`` words inside documents whose bit is set in ``known``."""
    bits, places, terms, docs = len(known).bit_length() - 1, [], [], []
    for size in sizes:
        if len(words) < size:
            continue
        runs = shingles(words, size)
        at = np.flatnonzero(known[_bits(runs, bits)])
        doc = np.searchsorted(bounds, at, "right") - 1
        inside = at + size <= bounds[doc + 1]
        places.append(at[inside])
        docs.append(doc[inside])
        terms.append(runs[at[inside]])
    if not places:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, _U)
    return np.concatenate(places), np.concatenate(docs), np.concatenate(terms)


def windows_of(at: np.ndarray, doc: np.ndarray, bounds: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(window, which of ``at`` it holds, most): window ``doc * (most + 1) + k`` starts ``k * step`` words into its document."""
    half = (at - bounds[doc]) // step
    most = int(half.max()) + 1
    window = doc * (most + 1) + half
    # A word lies in the window that starts at its half and in the one before.
    return np.concatenate([window, window[half > 0] - 1]), np.concatenate([np.arange(len(at)), np.flatnonzero(half > 0)]), most


def held_items(index: Index, known: np.ndarray, words: np.ndarray, bounds: np.ndarray, width: int, threshold: float, overlap: float) -> dict[tuple[int, int], tuple[float, float, float]]:
    """(document, item) -> its best score and overlaps, of the verified items."""
    at, doc, run = term_places(words, bounds, index.sizes, known)
    term = np.searchsorted(index.terms, run)
    hit = index.terms[np.minimum(term, len(index.terms) - 1)] == run
    at, term, doc = at[hit], term[hit], doc[hit]
    best: dict[tuple[int, int], tuple[float, float, float]] = {}
    if not len(at):
        return best
    step = width // 2
    window, which, most = windows_of(at, doc, bounds, step)
    query = np.unique(window * len(index.terms) + term[which])
    for w, i, score in search(index, query // len(index.terms), query % len(index.terms), threshold):
        d, k = divmod(w, most + 1)
        start = bounds[d] + k * step
        held = words[start : min(start + width, bounds[d + 1])]
        asked, answered = _share(index.question[i], held), _share(index.answer[i], held)
        if asked >= overlap and (answered >= overlap or _share(index.whole[i], held) >= overlap):
            best[d, i] = max(best.get((d, i), (0.0,)), (score, asked, answered))
    return best


def known_bits(terms: np.ndarray) -> np.ndarray:
    """A bitmap of some 32 places for each term."""
    bits = max(16, len(terms).bit_length() + 5)
    known = np.zeros(1 << bits, bool)
    known[_bits(terms, bits)] = True
    return known


def _found(ids: pa.Array, index: Index, best: dict[tuple[int, int], tuple[float, float, float]]) -> pa.RecordBatch:
    columns = [pa.array([v[k] for v in best.values()], pa.float64()) for k in range(3)]
    keys = [ids.take(pa.array([k[0] for k in best])), pa.array([index.item_ids[k[1]] for k in best], pa.int64())]
    return pa.RecordBatch.from_arrays([*keys, *columns], names=["id", "item", "score", "question_overlap", "answer_overlap"])


def by_broadcast(texts: DataFrame, rows: list[tuple], width: int, schema: str, threshold: float, overlap: float, overall: Counts | None) -> DataFrame:
    """All pairs of ``texts`` (id, text) and ``rows`` (item, text), with one index that every worker holds."""
    spark = texts.sparkSession
    index = build_index(rows, overall=overall)
    if index is None:
        return spark.createDataFrame([], schema)
    shared = spark.sparkContext.broadcast(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        known = known_bits(index.terms)
        for batch in batches:
            for a, b in slices(batch.column(1), 1_000_000):
                words, bounds = word_hashes(batch.column(1)[a:b], word_table(marks=True))
                if best := held_items(index, known, words, bounds, width, threshold, overlap):
                    yield _found(batch.column(0)[a:b], index, best)

    return texts.mapInArrow(run, schema)


def counts_over(rows: list[tuple]) -> Counts | None:
    """Counts of all items of a benchmark that is small enough to be broadcast."""
    index = build_index(rows)
    n_terms = [len(_terms(w)) for _, t in rows if t and len(w := _words(t))]
    return index and Counts(len(index.item_ids), float(np.mean(n_terms)), index.terms, np.diff(index.starts))


def term_bitmap(terms: DataFrame, bits: int = 27) -> np.ndarray:
    """One bit for each value of the terms' first ``bits``: of fixed size, and put together in pieces of 4,096."""
    slot = F.shiftrightunsigned("term", 64 - bits)
    pieces = terms.select(F.shiftright(slot, 12).alias("piece"), slot.bitwiseAND(F.lit(4095)).cast("int").alias("bit")).groupBy("piece").agg(F.collect_set("bit").alias("own"))
    known = np.zeros(1 << bits, bool)
    for r in pieces.toLocalIterator():
        known[(r.piece << 12) + np.array(r.own)] = True
    return known


def by_parts(texts: DataFrame, items: DataFrame, everything: DataFrame, n_parts: int, width: int, schema: str, threshold: float, overlap: float, salts: int = 16) -> DataFrame:
    """The same with the items, some of ``everything``, in ``n_parts`` indexes; one reading of ``texts``."""
    spark = texts.sparkSession
    part = F.pmod(F.xxhash64("item", "text"), F.lit(n_parts)).cast("int")
    items = written(items.withColumn("part", part))
    total = everything.agg(F.count("*").alias("n"), F.avg("n_terms").alias("mean")).first()
    each = items.select("part", "item", "text", F.explode("terms").alias("term"))
    own_terms = each.select("term").distinct()
    df = written(everything.select(F.explode("terms").alias("term")).join(own_terms, "term", "left_semi").groupBy("term").agg(F.count("*").alias("df")))
    shared = spark.sparkContext.broadcast(np.packbits(term_bitmap(df)))
    sizes = sorted(r[0] for r in items.select(F.least("n_words", F.lit(_TERM))).distinct().collect())  # 1 to 3
    kind = dict(texts.dtypes)["id"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.unpackbits(shared.value).astype(bool)
        number = TaskContext.get().partitionId() << 40
        step = width // 2
        for batch in batches:
            for a, b in slices(batch.column(1), 1_000_000):
                words, bounds = word_hashes(batch.column(1)[a:b], word_table(marks=True))
                at, doc, run = term_places(words, bounds, sizes, known)
                if not len(at):
                    continue
                window, which, most = windows_of(at, doc, bounds, step)
                order = np.argsort(window, kind="stable")
                window, run = window[order], run[which[order]]
                first = np.flatnonzero(np.diff(window, prepend=-1))
                own = np.split(run, first[1:])
                d, k = np.divmod(window[first], most + 1)
                start = bounds[d] + k * step
                held = [words[i:j].tobytes() for i, j in zip(start, np.minimum(start + width, bounds[d + 1]), strict=True)]
                columns = [batch.column(0)[a:b].take(pa.array(d)), pa.array(number + np.arange(len(first))), pa.array(held, pa.binary()), pa.array([np.unique(x).view(np.int64) for x in own], pa.list_(pa.int64()))]
                number += len(first)
                yield pa.RecordBatch.from_arrays(columns, names=["id", "window", "words", "terms"])

    windows = written(texts.mapInArrow(cut, f"id {kind}, window long, words binary, terms array<long>"))
    routes = windows.select("window", F.explode("terms").alias("term")).join(each.select("term", "part").distinct(), "term").select("window", "part").distinct()
    asked = windows.select("id", "window", "words").join(routes, "window").select("part", F.pmod(F.xxhash64("window"), F.lit(salts)).cast("int").alias("salt"), "id", "words")
    counts = each.join(df, "term").groupBy("part", "item", "text").agg(F.collect_list(F.struct("term", "df")).alias("counts"))  # an item's own terms
    dealt = counts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    none = lambda t: F.lit(None).cast(t)
    both = dealt.select("part", "salt", F.lit(False).alias("asks"), "item", "text", "counts", none(kind).alias("id"), none("binary").alias("words")).unionByName(
        asked.select("part", "salt", F.lit(True).alias("asks"), none("long").alias("item"), none("string").alias("text"), none("array<struct<term:long,df:long>>").alias("counts"), "id", "words")
    )

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The items of a part and salt come before its passages."""
        now, index, known, rows, terms = None, None, None, [], {}
        for batch in batches:
            part, salt, asks, item, text, counts = (batch.column(k).to_pylist() for k in range(6))
            for i in range(len(part)):
                if (part[i], salt[i]) != now:
                    now, index, rows, terms = (part[i], salt[i]), None, [], {}
                if not asks[i]:
                    rows.append((item[i], text[i]))
                    terms.update((c["term"], c["df"]) for c in counts[i])
                    continue
                if index is None:
                    keys = np.array(list(terms), np.int64).view(_U)
                    order = np.argsort(keys)
                    index = build_index(rows, overall=Counts(total.n, total.mean, keys[order], np.array(list(terms.values()))[order]))
                    known = known_bits(index.terms)
                words = np.frombuffer(batch.column(7)[i].as_buffer(), _U)
                if best := held_items(index, known, words, np.array([0, len(words)]), width, threshold, overlap):
                    yield _found(batch.column(6)[i : i + 1], index, best)

    return both.repartition("part", "salt").sortWithinPartitions("part", "salt", "asks").mapInArrow(ask, schema)


def find_leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    threshold: float = 0.4,
    overlap: float = 0.75,
    passage: int = 128,
    min_words: int = 1,
    index_items: int = 20_000,
    index_bytes: int = 32 << 20,
) -> DataFrame:
    """(id, item id, score, question_overlap, answer_overlap): the items a document holds.

    A scored item is verified when ``overlap`` of the question's runs of five
    words are in the passage, and as many of the answer's or of the whole item's.
    """
    asked = benchmark.select(F.lit(0).alias("part"), F.col(item_col).cast("long").alias("item"), F.col(item_text_col).alias("text"))
    twice = F.pow(F.lit(2), F.ceil(F.log2(F.col("n_words") * 2))).cast("long")
    width = F.when(F.col("n_words") * 2 <= passage, F.lit(passage)).otherwise(twice)
    items = written(item_terms(asked).filter(F.col("n_words") >= min_words).withColumn("width", width))
    sizes = items.groupBy("width").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes")).orderBy("width").collect()  # a row for each power of two
    schema = f"id {dict(docs.dtypes)[id_col]}, item long, score double, question_overlap double, answer_overlap double"
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    parts = lambda n, size: max(1, -(-n // index_items), -(-size // index_bytes))
    pairs = docs.sparkSession.createDataFrame([], schema)
    if sizes and parts(sum(r.n for r in sizes), sum(r.bytes for r in sizes)) == 1:
        rows = [tuple(r) for r in items.select("width", "item", "text").collect()]  # index_items rows and index_bytes bytes at most
        overall = counts_over([r[1:] for r in rows]) if len(sizes) > 1 else None
        for r in sizes:
            pairs = pairs.unionByName(by_broadcast(texts, [x[1:] for x in rows if x[0] == r.width], r.width, schema, threshold, overlap, overall))
    else:
        for r in sizes:
            own = items.filter(F.col("width") == r.width).drop("width")
            pairs = pairs.unionByName(by_parts(texts, own, items, parts(r.n, r.bytes), r.width, schema, threshold, overlap))
    best = pairs.groupBy("id", "item").agg(*(F.max(c).alias(c) for c in ("score", "question_overlap", "answer_overlap")))
    return best.withColumnsRenamed({"id": id_col, "item": item_col})
