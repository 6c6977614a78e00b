"""Suffix-array dedup of byte strings that repeat across documents.

All strings of ``size`` bytes of a document with the same least hash of their
``gram``-byte substrings form runs of neighbours; equal strings have the same least
hash, so only strings of equal hash need to be compared.  Each document has a home, a
partition that its id and text decide.

1. Every task sends the hashes of its runs and their homes, once for each slice of
   texts, to the partition of the hash; hashes seen in two slices, or in two documents
   of one, are possible repeats, and are sent to the homes that have them.
2. At home, the runs of these hashes are found again, and each distinct one of a slice
   is sent to the partition of its hash, with the smallest and largest id that hold it:
   not the documents, so a run that a third of all documents share is sent once a slice.
3. Runs with equal hash meet in one task, which builds a suffix array of their
   distinct bytes in two stages: suffixes smaller than their successors are sorted
   directly, the others are induced by scanning the buckets in order.  Adjacent
   common prefixes of ``size`` or more bytes give the classes of equal strings, and
   each class its smallest document.  Homes with a larger one are told, for each run,
   the smallest documents of its strings.
4. At home, each document finds its runs among these by a hash of their bytes, and
   loses what strings cover that also start in a smaller document.

No step needs the driver, and the number of steps is the same at every size.  What
meets in one task are the different runs of one hash: contexts of one substring of
``gram`` bytes, which are not split.

Defined cases: a null text is empty; a null id is smaller than all others; rows
with equal id do not count as smaller than each other, and each is judged by its own
text; matches never cross documents; an empty table gives no rows; extra columns are
not carried.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial, reduce

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .hashing import joined_bytes, mixed, span_hashes
from .tokens import slices

_U = np.uint64
_STEP = 0x9E3779B97F4A7C15


def gram_hashes(data: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all ``size``-byte substrings, by doubling."""
    n = len(data) - size + 1
    power, width, at, out = data.astype(_U) + _U(1), 1, 0, None
    rest = size
    while rest:
        if rest & 1:
            piece = power[at : at + n]
            out = piece.copy() if out is None else out * _U(pow(_STEP, width, 1 << 64)) + piece
            at += width
        rest >>= 1
        if rest:
            power = power[: len(power) - width] * _U(pow(_STEP, width, 1 << 64)) + power[width:]
            width *= 2
    return mixed(out)


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """The least of every ``width`` neighbours."""
    have = 1
    while have < width:
        step = min(have, width - have)
        x = np.minimum(x[: len(x) - step], x[step:])
        have += step
    return x


def runs_of(data: np.ndarray, bounds: np.ndarray, size: int, gram: int, most: int = 64) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, first start, number of starts, hash) of the runs of all strings of ``size`` bytes."""
    empty = np.empty(0, np.int64)
    if len(data) < size:
        return empty, empty, empty, np.empty(0, _U)
    least = sliding_min(gram_hashes(data, gram), size - gram + 1)
    starts = np.arange(len(least))
    doc = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))[: len(least)]
    inside = starts + size <= bounds[1:][doc]
    change = np.ones(len(least), bool)
    change[1:] = (least[1:] != least[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(change & inside)
    if not len(first):
        return empty, empty, empty, np.empty(0, _U)
    # A run ends where the next begins, or at the last string of its document.
    edges = np.flatnonzero(change | ~inside)
    stop = np.append(edges, len(least))[np.searchsorted(edges, first, "right")]
    count = stop - first
    # Runs grow long only where text repeats itself; cut evenly, its pieces are alike.
    pieces = -(-count // most)
    step = np.arange(int(pieces.sum())) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    first, count = np.repeat(first, pieces) + most * step, np.repeat(count, pieces) - most * step
    # Least hashes are small numbers; mixed again they spread over all partitions.
    return doc[first], first, np.minimum(count, most), mixed(least[first])


def _is_smaller(text: np.ndarray) -> np.ndarray:
    """Which suffixes are smaller than their successors; equal bytes follow what comes after them."""
    n = len(text)
    sign = np.zeros(n, np.int8)
    sign[:-1] = np.sign(text[1:].astype(np.int16) - text[:-1])
    sign[-1] = -1  # the end is smaller than every byte
    at = np.where(sign != 0, np.arange(n), n)
    return sign[np.minimum.accumulate(at[::-1])[::-1]] > 0


def _sort_directly(at: np.ndarray, words: np.ndarray, depth: int) -> np.ndarray:
    """``at`` sorted by the ``depth`` bytes from each, eight at a time, ties again."""
    at = at[np.argsort(words[at], kind="stable")]
    key = words[at]
    same = np.concatenate([[False], key[1:] == key[:-1]])
    done = 8
    while done < depth and same.any():
        tied = same.copy()
        tied[:-1] |= same[1:]
        place = np.flatnonzero(tied)
        group = np.cumsum(~same)[place]
        key = words[np.minimum(at[place] + done, len(words) - 1)]
        order = np.lexsort((key, group))
        at[place] = at[place][order]
        key = key[order]
        equal = np.concatenate([[False], (key[1:] == key[:-1]) & (group[1:] == group[:-1])])
        same[place] = equal
        done += 8
    return at


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """Start places in the order of their suffixes, by ``depth`` bytes at least, of
    a text whose bytes are over 0 or separate its parts."""
    n = len(text)
    padded = np.concatenate([text, np.zeros(8, np.uint8)]).astype(_U)
    words = reduce(lambda acc, k: (acc << _U(8)) | padded[k : k + n], range(1, 8), padded[:n].copy())
    words = np.append(words, _U(0))  # what lies behind the end
    smaller = _is_smaller(text)
    direct = _sort_directly(np.flatnonzero(smaller), words, depth + 8)
    direct_bucket = text[direct]
    edges = np.searchsorted(direct_bucket, np.arange(257))
    induced: list[list[np.ndarray]] = [[] for _ in range(256)]
    if n and not smaller[-1]:
        induced[text[-1]].append(np.array([n - 1]))  # its successor is the end
    out = []
    for byte in range(256):
        # Larger suffixes of a bucket come first; those with a predecessor of the
        # same byte add to the bucket itself.
        own = []
        wave = np.concatenate(induced[byte]) if induced[byte] else np.empty(0, np.int64)
        induced[byte] = []
        while len(wave):
            own.append(wave)
            before = wave[wave > 0] - 1
            wave = before[(text[before] == byte) & ~smaller[before]]
        bucket = np.concatenate([*own, direct[edges[byte] : edges[byte + 1]]]) if own or edges[byte] < edges[byte + 1] else None
        if bucket is None:
            continue
        out.append(bucket)
        before = bucket[bucket > 0] - 1
        before = before[~smaller[before] & (text[before] > byte)]
        heads = text[before]
        order = np.argsort(heads, kind="stable")
        before, heads = before[order], heads[order]
        for part in np.split(before, np.flatnonzero(np.diff(heads)) + 1) if len(before) else ():
            induced[text[part[0]]].append(part)
    return np.concatenate(out) if out else np.empty(0, np.int64)


def common_prefix(text: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """For each of ``at`` but the first, whether ``size`` bytes are the same as of the one before it."""
    same = np.ones(max(0, len(at) - 1), bool)
    for k in range(size):
        live = np.flatnonzero(same)
        if not len(live):
            break
        same[live] = text[at[live] + k] == text[at[live + 1] + k]
    return same


def least_owners(pieces: list[bytes], documents: np.ndarray, size: int) -> list[np.ndarray]:
    """For every string of ``size`` bytes in each distinct piece, the smallest
    document of a piece that holds it."""
    lengths = np.array([len(p) for p in pieces])
    # Bytes are shifted by one, pieces end with zero: no string spans two of them.
    text = np.frombuffer(b"\xff".join(pieces) + b"\xff", np.uint8) + np.uint8(1)
    ends = np.cumsum(lengths + 1)
    order = suffix_array(text, size)
    piece = np.repeat(np.arange(len(pieces)), lengths + 1)[order]
    begins = order + size < ends[piece]
    order, piece = order[begins], piece[begins]
    group = np.concatenate([[0], np.cumsum(~common_prefix(text, order, size))])
    first = np.flatnonzero(np.diff(group, prepend=-1))
    owner = np.empty(len(text), np.int64)
    owner[order] = np.minimum.reduceat(documents[piece], first)[group]
    return [owner[e - n - 1 : e - size] for e, n in zip(ends, lengths, strict=True)]


def _packed(*columns: np.ndarray | bytes) -> bytes:
    """Columns of whole numbers, their bytes of equal weight side by side, compressed."""
    parts = []
    for c in columns:
        raw = c if isinstance(c, bytes) else np.ascontiguousarray(c.view(np.uint8).reshape(len(c), c.itemsize).T).tobytes()
        parts += [len(raw).to_bytes(4, "little"), raw]
    return zstandard.ZstdCompressor(level=3).compress(b"".join(parts))


def _unpacked(data: bytes, *kinds: str) -> list:
    """The columns again; kind ``bytes`` or a numpy type."""
    raw, at, out = memoryview(zstandard.ZstdDecompressor().decompress(data)), 0, []
    for kind in kinds:
        n = int.from_bytes(raw[at : at + 4], "little")
        part, at = raw[at + 4 : at + 4 + n], at + 4 + n
        if kind == "bytes":
            out.append(bytes(part))
        else:
            width = np.dtype(kind).itemsize
            out.append(np.ascontiguousarray(np.frombuffer(part, np.uint8).reshape(width, -1).T).view(kind).ravel())
    return out


def _split_by(keys: np.ndarray) -> Iterator[tuple[int, slice]]:
    """(key, where it lies) of sorted keys."""
    if not len(keys):
        return
    edges = np.flatnonzero(np.diff(keys, prepend=keys[:1] - 1)).tolist()
    for i, j in zip(edges, [*edges[1:], len(keys)], strict=True):
        yield int(keys[i]), slice(i, j)


def _spread(begin: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All places ``begin[k]`` to ``begin[k] + count[k]``, and the k of each."""
    of = np.repeat(np.arange(len(count)), count)
    return np.repeat(begin - (np.cumsum(count) - count), count) + np.arange(len(of)), of


def send_hashes(batches: Iterator[pa.RecordBatch], size: int, gram: int, fine: int, slice_bytes: int) -> Iterator[pa.RecordBatch]:
    """Step 1, of (key, home, text): rows (bucket, body) with hashes, homes and marks for hashes of several ids."""
    for batch in batches:
        for a, b in slices(batch.column(2), slice_bytes):
            data, bounds = joined_bytes(batch.column(2)[a:b])
            ids, homes = (batch.column(k)[a:b].to_numpy(zero_copy_only=False) for k in (0, 1))
            doc, _, _, key = runs_of(data, bounds, size, gram)
            if not len(key):
                continue
            key >>= _U(16)
            order = np.lexsort((homes[doc], key))
            key, own, home = key[order], ids[doc[order]], homes[doc[order]]
            new = np.concatenate([[True], key[1:] != key[:-1]])
            first = np.flatnonzero(new)
            several = np.minimum.reduceat(own, first) < np.maximum.reduceat(own, first)
            once = np.flatnonzero(new | np.concatenate([[True], home[1:] != home[:-1]]))
            key, home, several = key[once], home[once], several[np.cumsum(new)[once] - 1]
            for k, at in _split_by(_bucket(key, fine)):
                body = _packed(key[at].astype("<u8"), home[at].astype("<u4"), several[at].astype("u1"))
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([body], pa.binary())], names=["bucket", "body"])


def _bucket(short: np.ndarray, fine: int) -> np.ndarray:
    """The partition of a hash of 48 bits."""
    return ((short >> _U(16)) * _U(fine) >> _U(32)).astype(np.int64)


def repeated_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Step 1, at the hash: rows (home, body) with the possible repeats of each home."""
    found: list[tuple] = []
    for batch in batches:
        found += [_unpacked(body.as_py(), "<u8", "<u4", "u1") for body in batch.column(1)]
    if not found:
        return
    key, home, several = (np.concatenate(c) for c in zip(*found, strict=True))
    row = np.repeat(np.arange(len(found)), [len(f[0]) for f in found])
    order = np.argsort(key, kind="stable")
    key, home, several, row = key[order], home[order], several[order], row[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    good = (np.minimum.reduceat(row, first) < np.maximum.reduceat(row, first)) | (np.maximum.reduceat(several, first) > 0)
    keep = np.repeat(good, np.diff(np.append(first, len(key))))
    key, home = key[keep], home[keep].astype(np.int64)
    order = np.lexsort((key, home))
    key, home = key[order], home[order]
    for h, at in _split_by(home):
        body = _packed(np.unique(key[at]).astype("<u8"))
        yield pa.RecordBatch.from_arrays([pa.array([h], pa.int32()), pa.array([body], pa.binary())], names=["home", "body"])


class _AtHome:
    """What lies at a home: what it was told first, then its texts, in slices."""

    def __init__(self, batches: Iterator[pa.RecordBatch], slice_bytes: int):
        self.batches, self.slice_bytes = batches, slice_bytes
        self.told: list[bytes] = []
        self.home: int | None = None

    def slices(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]]:
        """(bytes, bounds, keys, ids) of consecutive texts; all of ``told`` is there before the first."""
        grow = zstandard.ZstdDecompressor()
        texts, keys, ids, held = [], [], [], 0

        def joined():
            bounds = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
            return np.frombuffer(b"".join(texts), np.uint8), bounds, np.array(keys, np.int64), pa.concat_arrays(ids)

        for batch in self.batches:
            homes, is_text, bodies, numbers = (batch.column(k).to_pylist() for k in range(4))
            for i in range(len(homes)):
                self.home = homes[i]
                if not is_text[i]:
                    self.told.append(bodies[i])
                    continue
                texts.append(grow.decompress(bodies[i]))
                keys.append(numbers[i])
                ids.append(batch.column(4)[i : i + 1])
                held += len(texts[-1])
                if held >= self.slice_bytes:
                    yield joined()
                    texts, keys, ids, held = [], [], [], 0
        if texts:
            yield joined()


def send_runs(batches: Iterator[pa.RecordBatch], size: int, gram: int, fine: int, slice_bytes: int) -> Iterator[pa.RecordBatch]:
    """Step 2: rows (bucket, home, body) with the distinct bytes of runs, their hashes, and the least and largest key."""
    at_home, wanted = _AtHome(batches, slice_bytes), None
    for data, bounds, keys, _ in at_home.slices():
        if wanted is None:
            wanted = np.unique(np.concatenate([_unpacked(x, "<u8")[0] for x in at_home.told])) if at_home.told else np.empty(0, _U)
            at_home.told = []
        doc, start, count, key = runs_of(data, bounds, size, gram)
        if not len(wanted) or not len(key):
            continue
        short = key >> _U(16)
        keep = np.flatnonzero(wanted[np.minimum(np.searchsorted(wanted, short), len(wanted) - 1)] == short)
        if not len(keep):
            continue
        bucket = _bucket(short[keep], fine)
        order = np.lexsort((key[keep], bucket))
        keep, bucket, view = keep[order], bucket[order], data.tobytes()
        for k, at in _split_by(bucket):
            own = keep[at]
            distinct: dict[bytes, int] = {}
            which = np.array([distinct.setdefault(view[x : x + n + size - 1], len(distinct)) for x, n in zip(start[own].tolist(), count[own].tolist(), strict=True)])
            low, least, most = np.empty(len(distinct), "<u4"), np.full(len(distinct), np.iinfo(np.int64).max), np.full(len(distinct), np.iinfo(np.int64).min)
            low[which] = key[own] & _U(0xFFFFFFFF)
            np.minimum.at(least, which, keys[doc[own]])
            np.maximum.at(most, which, keys[doc[own]])
            pieces = list(distinct)
            body = _packed(b"".join(pieces), np.array([len(p) for p in pieces], "<u4"), low, least.astype("<i8"), most.astype("<i8"))
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([at_home.home], pa.int32()), pa.array([body], pa.binary())], names=["bucket", "home", "body"])


def compare_runs(batches: Iterator[pa.RecordBatch], size: int, block_bytes: int = 400_000) -> Iterator[pa.RecordBatch]:
    """Step 3: rows (home, body) with hashes of runs, their numbers of segments, and each segment's first string and smallest document."""
    pieces, n_pieces = [], 0
    which, lows, leasts, mosts, homes = [], [], [], [], []
    for batch in batches:
        for home, body in zip(batch.column(1).to_pylist(), batch.column(2), strict=True):
            data, lengths, low, least, most = _unpacked(body.as_py(), "bytes", "<u4", "<u4", "<i8", "<i8")
            ends = np.concatenate([[0], np.cumsum(lengths.astype(np.int64))])
            pieces.append(pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(ends), pa.py_buffer(data)]))
            which.append(np.arange(n_pieces, n_pieces + len(lengths)))
            n_pieces += len(lengths)
            lows.append(low)
            leasts.append(least)
            mosts.append(most)
            homes.append(np.full(len(lengths), home))
    if not pieces:
        return
    encoded = pa.concat_arrays(pieces).dictionary_encode()
    distinct, piece = encoded.dictionary, encoded.indices.to_numpy().astype(np.int64)[np.concatenate(which)]
    del pieces, encoded
    low, home, most = np.empty(len(distinct), "<u4"), np.concatenate(homes), np.concatenate(mosts)
    low[piece] = np.concatenate(lows)
    least = np.full(len(distinct), np.iinfo(np.int64).max)
    np.minimum.at(least, piece, np.concatenate(leasts))
    # Each home asks for a run once, for its largest document.
    order = np.lexsort((home, piece))
    piece, home, most = piece[order], home[order], most[order]
    first = np.flatnonzero(np.concatenate([[True], (piece[1:] != piece[:-1]) | (home[1:] != home[:-1])]))
    piece, home, most = piece[first], home[first], np.maximum.reduceat(most, first)
    # Runs of equal hash are compared, some hundred thousand bytes of them at a time.
    by_low = np.argsort(low, kind="stable")
    lengths = np.diff(np.frombuffer(distinct.buffers()[1], np.int64, len(distinct) + 1, 8 * distinct.offset))
    new = np.flatnonzero(np.concatenate([[True], low[by_low][1:] != low[by_low][:-1]]))
    sums = np.concatenate([[0], np.cumsum(lengths[by_low])])
    asked = np.searchsorted(piece, np.arange(len(distinct) + 1))  # where the homes of each distinct run lie
    answers: list[tuple] = []
    i = 0
    while i < len(by_low):
        k = np.searchsorted(sums, sums[i] + block_bytes)
        k = int(new[np.searchsorted(new, k)]) if k <= new[-1] else len(by_low)
        own = by_low[i:k]
        i = k
        data = distinct.take(pa.array(own)).to_pylist()
        owners = least_owners(data, least[own], size)
        n = np.array([len(o) for o in owners])
        flat, begin = np.concatenate(owners), np.cumsum(n) - n
        at, of = _spread(asked[own], asked[own + 1] - asked[own])
        smallest = np.minimum.reduceat(flat, begin)
        told = smallest[of] < most[at]
        at, of = at[told], of[told]
        if not len(at):
            continue
        starts = np.cumsum(lengths[own]) - lengths[own]
        names = span_hashes(np.frombuffer(b"".join(data), np.uint8), starts, lengths[own])
        opens = np.concatenate([[True], flat[1:] != flat[:-1]])
        opens[begin] = True
        segment = np.flatnonzero(opens)
        seg_first = np.searchsorted(segment, begin)
        seg_count = np.diff(np.append(seg_first, len(segment)))
        places, row = _spread(seg_first[of], seg_count[of])
        answers.append((home[at], names[of], seg_count[of], segment[places] - begin[of[row]], flat[segment[places]]))
    if not answers:
        return
    home, name, n, start, owner = (np.concatenate(c) for c in zip(*answers, strict=True))
    order = np.argsort(home, kind="stable")
    seg_begin = np.cumsum(n) - n
    for h, at in _split_by(home[order]):
        own = order[at]
        places, _ = _spread(seg_begin[own], n[own])
        body = _packed(name[own].astype("<u8"), n[own].astype("<u2"), start[places].astype("<u2"), owner[places].astype("<i8"))
        yield pa.RecordBatch.from_arrays([pa.array([h], pa.int32()), pa.array([body], pa.binary())], names=["home", "body"])


def merged_ranges(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal (document, start, end) of ranges that touch or overlap."""
    order = np.lexsort((start, doc))
    doc, start, end = doc[order], start[order], end[order]
    # Ends grow by document, so that a running maximum stays inside it.
    reach = int(end.max()) + 1 if len(end) else 1
    far = np.maximum.accumulate(end + doc * reach) - doc * reach
    new = np.concatenate([[True], (doc[1:] != doc[:-1]) | (start[1:] > far[:-1])])[: len(doc)]
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(doc)) - 1
    return doc[first], start[first], far[last[: len(first)]]


def cut_texts(batches: Iterator[pa.RecordBatch], size: int, gram: int, slice_bytes: int) -> Iterator[pa.RecordBatch]:
    """Step 4: (id, n_bytes, removed, kept) of every text."""
    list_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    at_home, name = _AtHome(batches, slice_bytes), None
    for data, bounds, keys, ids in at_home.slices():
        if name is None:
            told = [_unpacked(x, "<u8", "<u2", "<u2", "<i8") for x in at_home.told]
            name, n, seg_start, owner = (np.concatenate(c) for c in zip(*told, strict=True)) if told else (np.empty(0, t) for t in ("u8", "u2", "u2", "i8"))
            n, seg_start = n.astype(np.int64), seg_start.astype(np.int64)
            order, seg_begin = np.argsort(name), np.cumsum(n) - n
            name, n, seg_begin, at_home.told = name[order], n[order], seg_begin[order], []
        doc, start, count, _ = runs_of(data, bounds, size, gram)
        d = s = e = np.empty(0, np.int64)
        if len(name) and len(start):
            own = span_hashes(data, start, count + size - 1)
            at = np.minimum(np.searchsorted(name, own), len(name) - 1)
            hit = np.flatnonzero(name[at] == own)
            places, row = _spread(seg_begin[at[hit]], n[at[hit]])
            run = hit[row]
            first = seg_start[places]
            ends_run = np.concatenate([row[1:] != row[:-1], [True]])[: len(row)]
            stop = np.where(ends_run, count[run], np.concatenate([first[1:], [0]])[: len(row)])
            gone = owner[places] < keys[doc[run]]
            run, first, stop = run[gone], first[gone], stop[gone]
            offset = start[run] - bounds[doc[run]]
            d, s, e = merged_ranges(doc[run], offset + first, offset + stop - 1 + size)
        edges = np.searchsorted(d, np.arange(len(keys) + 1)).tolist()
        starts, ends, view = s.tolist(), e.tolist(), data.tobytes()
        removed, kept = [], []
        for i, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
            own = list(zip(starts[edges[i] : edges[i + 1]], ends[edges[i] : edges[i + 1]], strict=True))
            cuts = [0, *(x for pair in own for x in pair), b - a]
            removed.append([{"start": x, "end": y} for x, y in own])
            kept.append(b"".join(view[a + x : a + y] for x, y in zip(cuts[::2], cuts[1::2], strict=True)))
        yield pa.RecordBatch.from_arrays([ids, pa.array(np.diff(bounds)), pa.array(removed, list_type), pa.array(kept, pa.binary())], names=["id", "n_bytes", "removed", "kept"])


def remove_repeats(docs: DataFrame, size: int = 50, gram: int = 20, id_col: str = "doc_id", text_col: str = "text", slice_bytes: int = 1_200_000) -> DataFrame:
    """(id, n_bytes, removed: array of (start, end) in bytes, kept: binary) for every row.

    Each byte goes that a string of ``size`` bytes covers which also starts in a
    document with a smaller id.
    """
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    fine = 2 * parts
    kind = dict(docs.dtypes)[id_col]
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("id"), F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))).alias("key"), text.alias("text"), F.pmod(F.xxhash64(id_col, text), F.lit(parts)).cast("int").alias("home")
    )
    nothing = lambda t: F.lit(None).cast(t)

    def squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            texts = [packer.compress(t) for t in batch.column(3).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(texts, pa.binary())], names=["id", "key", "home", "body"])

    def at_home(told: DataFrame, texts: DataFrame) -> DataFrame:
        """What each home is told before its texts, which travel compressed."""
        packed = texts.select("id", "key", "home", "text").mapInArrow(squeeze, f"id {kind}, key long, home int, body binary")
        both = told.select("home", F.lit(False).alias("is_text"), "body", nothing("long").alias("key"), nothing(kind).alias("id")).unionByName(
            packed.select("home", F.lit(True).alias("is_text"), "body", "key", "id")
        )
        return both.repartitionById(parts, "home").sortWithinPartitions("is_text")

    own = {"size": size, "gram": gram, "slice_bytes": slice_bytes}
    long_enough = rows.filter(F.octet_length("text") >= size)
    hashes = long_enough.select("key", "home", "text").mapInArrow(partial(send_hashes, fine=fine, **own), "bucket int, body binary")
    repeats = hashes.repartitionById(fine, "bucket").mapInArrow(repeated_hashes, "home int, body binary")
    runs = at_home(repeats, long_enough).mapInArrow(partial(send_runs, fine=fine, **own), "bucket int, home int, body binary")
    answers = runs.repartitionById(fine, "bucket").mapInArrow(partial(compare_runs, size=size), "home int, body binary")
    out = at_home(answers, rows).mapInArrow(partial(cut_texts, **own), f"id {kind}, n_bytes long, removed array<struct<start:long,end:long>>, kept binary")
    return out.withColumnRenamed("id", id_col) if id_col != "id" else out
