"""Token ids of whole texts, by the ``tokenizers`` library.

Both vocabularies used here split a text before the merges, never join a visible
character with the white space after it, and never join letters with the ASCII
punctuation after them or with a line end.  A text can therefore be cut at such
places: the ids of a text are the ids of its words, in order, and the ids of a word
those of its parts.  Words and parts are encoded once and remembered.

A text that may hold a special token's string is encoded as a whole, so that it gets
the ids that the library gives by default.
"""

from __future__ import annotations

import os
import re
from itertools import chain, repeat
from unicodedata import normalize

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Fixed value: the id that ends every document.
END_ID = 1

#: Python's notion of white space contains the tokenizers' own, so a cut made
#: here is one that they make too.
_CUT = re.compile(r"(?<=\S)(?= )")
#: Letters with ASCII punctuation behind them, once or on both sides of a line end.  A
#: tokenizer takes these apart.  An apostrophe may belong to the letters after it, so
#: it is not among the marks.
_LETTERS = r"([^\W\d_]+)([!-&(-/:-@\[-^`{-~]*)"
_APART = re.compile(rf"{_LETTERS}(?:(\n){_LETTERS})?")
_MARK = "|"


def _stays_letters(word: str) -> bool:
    """Whether letters stay letters when a vocabulary composes and lower-cases them."""
    return word.isascii() or normalize("NFC", word).lower().isalpha()


class _Ids:
    """Rows of ids, added at the end; row 0 is empty."""

    def __init__(self) -> None:
        self.flat = np.empty(1 << 16, np.uint32)
        self.starts, self.counts, self.used = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64), 0
        self.rows = 1

    @staticmethod
    def _room(x: np.ndarray, used: int, more: int) -> np.ndarray:
        return x if used + more <= len(x) else np.concatenate([x[:used], np.zeros(max(used, more), x.dtype)])

    def add(self, ids: np.ndarray, counts: np.ndarray) -> int:
        """The number of the first of the new rows."""
        first, n = self.rows, len(counts)
        self.flat = self._room(self.flat, self.used, len(ids))
        self.starts, self.counts = self._room(self.starts, first, n), self._room(self.counts, first, n)
        self.flat[self.used : self.used + len(ids)] = ids
        self.counts[first : first + n] = counts
        self.starts[first : first + n] = self.used + np.cumsum(counts) - counts
        self.used, self.rows = self.used + len(ids), first + n
        return first

    def take(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of ``rows`` one after the other, and where each row's end."""
        counts = self.counts[rows]
        ends = np.cumsum(counts)
        total = int(ends[-1]) if len(ends) else 0
        return self.flat[np.repeat(self.starts[rows] - (ends - counts), counts) + np.arange(total)], ends


class PieceEncoder:
    """Encodes texts word by word, remembering about ``max_pieces`` words and as many parts.

    The memory is a cache and nothing else: when it is full the words of the last
    texts stay, and others met again are encoded again.
    """

    def __init__(self, tokenizer_path: str, max_pieces: int = 500_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_path)
        # A vocabulary of lower-case words has one entry for both cases.
        self.lower = self._plain("A") == self._plain("a")
        # Where white space is dropped it is never part of a token.
        self.drops_space = not self._plain(" \n\t ")
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.mark = self._plain(_MARK)[0]
        self.max_pieces = max_pieces
        self.parts: dict[str, int] = {}
        self.part_ids = _Ids()
        self._forget()

    def _keep(self, words: list[str], lead: str) -> None:
        """Forgets all words but these."""
        old, ids = self.words[lead], self.word_ids
        rows = np.fromiter(map(old.get, words, repeat(-1)), np.int64, len(words))
        known = np.flatnonzero(rows >= 0)
        flat, ends = ids.take(rows[known])
        self._forget()
        first = self.word_ids.add(flat, np.diff(ends, prepend=0))
        self.words[lead].update(zip([words[i] for i in known.tolist()], range(first, first + len(known)), strict=True))

    def _plain(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _forget(self) -> None:
        self.word_ids = _Ids()
        self.end_row = self.word_ids.add(np.array([END_ID]), np.array([1]))
        # Words after a space, and words where a text starts.
        self.words: dict[str, dict[str, int]] = {" ": {}, "": {}}

    def _encoded(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all pieces, and how many each has."""
        counts, ids = [np.empty(0, np.int64)], [np.empty(0, np.uint32)]
        for i in range(0, len(pieces), 8192):  # in steps: an encoding holds far more memory than its ids
            rows = [e.ids for e in self.tokenizer.encode_batch_fast(pieces[i : i + 8192], add_special_tokens=False)]
            counts.append(np.fromiter(map(len, rows), np.int64, len(rows)))
            ids.append(np.fromiter(chain.from_iterable(rows), np.uint32, int(counts[-1].sum())))
        return np.concatenate(ids), np.concatenate(counts)

    def _encoded_letters(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same for pieces of letters only, many joined by a mark that none of them holds."""
        joined = [_MARK.join([*pieces[i : i + 1024], ""]) for i in range(0, len(pieces), 1024)]
        ids, _ = self._encoded(joined)
        marks = np.flatnonzero(ids == self.mark)
        if len(marks) != len(pieces):  # no such vocabulary is known
            return self._encoded(pieces)
        return np.delete(ids, marks), np.diff(marks, prepend=-1) - 1

    def _add_parts(self, new: list[str]) -> None:
        letters, others = [], []
        for part in new:
            bare = part.removeprefix(" ")
            (letters if bare.isalpha() and _stays_letters(bare) else others).append(part)
        for own, encode in ((letters, self._encoded_letters), (others, self._encoded)):
            first = self.part_ids.add(*encode(own))
            self.parts.update(zip(own, range(first, first + len(own)), strict=True))

    def _learn(self, words: list[str], lead: str) -> int:
        """Adds distinct new words; the row of the first of them."""
        flat: list[str] = []
        sizes: list[int] = []
        for word in words:
            if self.lower and word.isascii():
                word = word.lower()
            cut = None if word.isalpha() else _APART.fullmatch(word)
            if cut and (word.isascii() or all(map(_stays_letters, filter(None, cut.group(1, 4))))):
                own = [p for p in cut.groups() if p]
                flat.append(lead + own[0])
                flat += own[1:]
                sizes.append(len(own))
            else:
                flat.append(lead + word)
                sizes.append(1)
        if len(self.parts) > self.max_pieces:
            self.parts, self.part_ids = {}, _Ids()
        rows = np.fromiter(map(self.parts.get, flat, repeat(-1)), np.int64, len(flat))
        if len(missing := np.flatnonzero(rows < 0)):
            new = list(dict.fromkeys(flat[i] for i in missing.tolist()))
            self._add_parts(new)
            rows[missing] = [self.parts[flat[i]] for i in missing.tolist()]
        ids, ends = self.part_ids.take(rows)
        last = ends[np.cumsum(sizes) - 1]
        first = self.word_ids.add(ids, np.diff(last, prepend=0))
        self.words[lead].update(zip(words, range(first, first + len(words)), strict=True))
        return first

    def _rows(self, words: list[str], lead: str) -> np.ndarray:
        """The row of each of the distinct ``words``."""
        rows = np.fromiter(map(self.words[lead].get, words, repeat(-1)), np.int64, len(words))
        if len(missing := np.flatnonzero(rows < 0)):
            rows[missing] = self._learn([words[i] for i in missing.tolist()], lead) + np.arange(len(missing))
        return rows

    def _with_care(self, text: str) -> np.ndarray:
        """For a text with white space before a space: cuts only after visible characters."""
        pieces = _CUT.split(text)
        ids, ends = self._encoded(distinct := list(dict.fromkeys(pieces)))
        ends = np.cumsum(ends)
        place = {p: i for i, p in enumerate(distinct)}
        starts = np.concatenate([[0], ends])
        return np.concatenate([*(ids[starts[k] : starts[k + 1]] for k in map(place.__getitem__, pieces)), [END_ID]]).astype(np.uint32)

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """One uint32 array of ids, with ``END_ID`` last, for each text (null: empty)."""
        if not len(texts):
            return []
        texts = pc.fill_null(texts, "")
        lists = pc.split_pattern(texts, " ")
        bounds = lists.offsets.to_numpy().astype(np.int64)
        inner = lists.values.slice(bounds[0], int(bounds[-1] - bounds[0]))
        bounds -= bounds[0]
        encoded = inner.dictionary_encode()
        words, at = encoded.dictionary.to_numpy(zero_copy_only=False).tolist(), encoded.indices.to_numpy()
        lead = "" if self.drops_space else " "
        if sum(map(len, self.words.values())) > self.max_pieces:
            self._keep(words, lead)
        rows = self._rows(words, lead)[at]
        if not self.drops_space:
            firsts = inner.take(pa.array(bounds[:-1])).dictionary_encode()
            rows[bounds[:-1]] = self._rows(firsts.dictionary.to_pylist(), "")[firsts.indices.to_numpy()]
        n = len(texts)
        ends = bounds[1:] + np.arange(1, n + 1)
        whole = np.empty(len(at) + n, np.int64)
        is_end = np.zeros(len(whole), bool)
        is_end[ends - 1] = True
        whole[~is_end] = rows
        whole[is_end] = self.end_row
        ids, id_ends = self.word_ids.take(whole)
        edges = np.concatenate([[0], id_ends[ends - 1]]).tolist()
        out = [ids[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)]
        if not self.drops_space:
            bare = pc.binary_length(pc.utf8_rtrim_whitespace(encoded.dictionary)).to_numpy()
            odd = (bare == 0) | (bare < pc.binary_length(encoded.dictionary).to_numpy())
            unclear = odd[at]
            for i in np.flatnonzero(np.add.reduceat(unclear, bounds[:-1])).tolist():
                out[i] = self._with_care(texts[i].as_py())
        for token in self.special:
            for i in np.flatnonzero(pc.match_substring(texts, token, ignore_case=True)).tolist():
                out[i] = np.array([*self._plain(texts[i].as_py()), END_ID], np.uint32)
        return out


_encoders: dict[tuple[str, int], PieceEncoder] = {}


def encoder(tokenizer_path: str, max_pieces: int = 500_000) -> PieceEncoder:
    """The worker's encoder for a vocabulary; Python workers serve many tasks."""
    key = tokenizer_path, max_pieces
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = PieceEncoder(tokenizer_path, max_pieces)
    return _encoders[key]


def slices(texts: pa.Array, size: int = 8_000_000):
    """Index ranges of consecutive texts with about ``size`` bytes each."""
    lengths = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    start, total = 0, 0
    for i, n in enumerate(lengths.tolist()):
        total += n
        if total >= size:
            yield start, i + 1
            start, total = i + 1, 0
    if start < len(texts):
        yield start, len(texts)
