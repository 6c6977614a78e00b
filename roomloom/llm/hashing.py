"""Hashes of words, shingles and byte strings of whole slices of texts at once, in numpy."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_U = np.uint64


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (splitmix64)."""
    x = x.astype(_U, copy=True)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def numbers(seed: int, n: int) -> np.ndarray:
    """``n`` fixed pseudo-random 64-bit values."""
    return mixed((np.arange(1, n + 1, dtype=_U) + _U(seed << 32)) * _U(0x9E3779B97F4A7C15))


_BYTE = numbers(1, 256)
_BASE = int(numbers(2, 1)[0]) | 1
_BACK = pow(_BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(1, _U)
    while len(out) < n:
        out = np.concatenate([out, out * _U(pow(base, len(out), 1 << 64))])
    return out[:n]


_tables: dict[str, np.ndarray] = {}


def _table(name: str, base: int, n: int) -> np.ndarray:
    if len(_tables.get(name, ())) < n:
        _tables[name] = _powers(base, 1 << n.bit_length())
    return _tables[name][:n]


def joined_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of the texts (null: none) in a row, and where each text starts, with the end."""
    texts = pc.fill_null(texts, "")
    lengths = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    data = b"".join(texts.cast(pa.binary()).to_pylist())
    return np.frombuffer(data, np.uint8), np.concatenate([[0], np.cumsum(lengths)])


def word_table(lower: bool = True, marks: bool = False) -> np.ndarray:
    """A byte table: A-Z to a-z if ``lower``; white space, and with ``marks`` also
    ASCII punctuation, to 32."""
    t = np.arange(256, dtype=np.uint8)
    if lower:
        t[65:91] += 32
    t[9:14] = 32
    if marks:
        t[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = 32
    return t


def word_hashes(texts: pa.Array, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A hash of every word, and how many words come before each text, with the total."""
    data, bounds = joined_bytes(texts)
    n = len(data)
    if not n:
        return np.empty(0, _U), np.zeros(len(bounds), np.int64)
    data = table[data]
    inside = data != 32
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    starts_of_text = bounds[:-1][bounds[:-1] < n]
    first[starts_of_text] = inside[starts_of_text]
    starts = np.flatnonzero(first)
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    ends_of_text = bounds[1:][bounds[1:] > 0] - 1
    last[ends_of_text] = inside[ends_of_text]
    ends = np.flatnonzero(last) + 1
    sums = np.concatenate([np.zeros(1, _U), np.cumsum(_BYTE[data] * _table("up", _BASE, n))])
    hashes = (sums[ends] - sums[starts]) * _table("down", _BACK, n)[starts]
    hashes += (ends - starts).astype(_U) * _BYTE[255]
    return mixed(hashes), np.searchsorted(starts, bounds)


def span_hashes(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, step: int = 1 << 20) -> np.ndarray:
    """Hashes of the byte strings at ascending ``starts``, whatever stands around them."""
    out = np.empty(len(starts), _U)
    i = 0
    while i < len(starts):
        base = int(starts[i])
        k = int(np.searchsorted(starts, base + step))
        stop = int((starts[i:k] + lengths[i:k]).max())
        sums = np.concatenate([np.zeros(1, _U), np.cumsum(_BYTE[data[base:stop]] * _table("up", _BASE, stop - base))])
        s = starts[i:k] - base
        out[i:k] = (sums[s + lengths[i:k]] - sums[s]) * _table("down", _BACK, stop - base)[s]
        i = k
    return mixed(out + lengths.astype(_U) * _BYTE[255])


def shingles(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of ``size`` words; a shorter sequence is one shingle, none if empty."""
    n = len(words)
    if not n:
        return words
    size = min(size, n)
    out = np.zeros(n - size + 1, _U)
    for k in range(size):
        out = (out + words[k : n - size + 1 + k]) * _U(0xD6E8FEB86659FD93)
        out ^= out >> _U(32)
    return mixed(out + _U(size))
