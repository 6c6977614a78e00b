"""Toxic documents: a lexicon learned from labels, met by Levenshtein automata, weighed in context.

Words that stand in more toxic than clean labelled documents, beyond what chance gives
among as many words, form the lexicon; a word's weight is its log odds.  The lexicon is a
trie, and a word of a text walks all Levenshtein automata of its terms at once: a state
is the set of (trie node, edits so far), built when it is first met and kept, so that
most words end after a few letters.  A term of under 5 letters allows no edit, of under
12 one, of more two.  A word near a term that clean documents use as it is (``known``) is
no misspelling.

A match counts its term's weight, halved an edit, and less where the words around it show a
quotation (quotation marks on both sides, or a word such as "said" or "word" shortly
before), more where they address someone.  A logistic curve over the sum and the largest
of a document's matches gives the score; it is fitted on a fold of the labelled
documents that its lexicon has not seen.

Labels come from rows whose crc32(id) modulo 5 is not 0, and from about ``max_labels`` of them,
chosen by a hash of the id: that bounds the word counts, the lexicon and what the driver
gathers for the fit.  Every document is scored, over its whole text.

Defined cases: a null or empty text has no matches and the score of such; a null id has no label
and is not held out; an id with several labels is toxic if one of them is; documents that share
an id share its label; without labels every score is 0.25.  An empty table gives no rows.
Only id and text are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

#: What stands around a quotation, and whom an insult addresses.
MARKS = "\"“”„«»‟"
REPORTS = frozenset("said says called calls wrote word words term quote quoted quoting dijo palabra dit mot sagte wort".split())
ADDRESS = frozenset("you your you're youre u ur du dich dein ihr tu te toi vous usted eres".split())
FOLDS = 5


def edits_allowed(term: str) -> int:
    return 0 if len(term) < 5 else 1 if len(term) < 12 else 2


class _State(dict):
    """Letter -> next state, worked out when first asked for; None where no term can follow."""

    def __init__(self, automaton: Automaton, at: dict[int, int]):
        self.automaton, self.at = automaton, at

    def __missing__(self, letter: str) -> _State | None:
        self[letter] = after = self.automaton.after(self.at, letter)
        return after


class Automaton:
    """The Levenshtein automata of all terms, met with their trie, as one automaton built on demand."""

    def __init__(self, terms: Iterable[str], max_states: int = 40_000):
        self.children: list[dict[str, int]] = [{}]
        self.term: list[str | None] = [None]
        self.reach = [0]  # most edits that any term below a node allows
        for t in sorted(terms):
            node, most = 0, edits_allowed(t)
            self.reach[0] = max(self.reach[0], most)
            for c in t:
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.term.append(None)
                    self.reach.append(0)
                node = self.children[node][c]
                self.reach[node] = max(self.reach[node], most)
            self.term[node] = t
        self.max_states = max_states
        self._reset()

    def _reset(self) -> None:
        self.states: dict[frozenset, _State] = {}
        self.start = self._state(self._closed({0: 0}))

    def _closed(self, at: dict[int, int]) -> dict[int, int]:
        """With the nodes that are reached by leaving letters of a term out."""
        todo = list(at.items())
        while todo:
            node, edits = todo.pop()
            for child in self.children[node].values():
                if edits + 1 <= self.reach[child] and at.get(child, 99) > edits + 1:
                    at[child] = edits + 1
                    todo.append((child, edits + 1))
        return at

    def _state(self, at: dict[int, int]) -> _State | None:
        if not at:
            return None
        key = frozenset(at.items())
        if key not in self.states:
            self.states[key] = _State(self, at)
        return self.states[key]

    def after(self, at: dict[int, int], letter: str) -> _State | None:
        out: dict[int, int] = {}

        def reach(node: int, edits: int) -> None:
            if edits <= self.reach[node] and out.get(node, 99) > edits:
                out[node] = edits

        for node, edits in at.items():
            reach(node, edits + 1)  # a letter too many
            for own, child in self.children[node].items():
                reach(child, edits if own == letter else edits + 1)
        return self._state(self._closed(out))

    def near(self, word: str) -> list[tuple[str, int]]:
        """(term, edits) of every term within its allowed edits of the word."""
        if len(self.states) > self.max_states:
            self._reset()
        state = self.start
        for c in word:
            state = state[c]
            if state is None:
                return []
        found = ((self.term[node], edits) for node, edits in state.at.items() if self.term[node] is not None)
        return [(t, e) for t, e in found if e <= edits_allowed(t)]


#: Signs that often stand at a word's ends; others are found one by one.
_SIGNS = "".join(map(chr, (*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)))) + "“”„«»‟‘’…–—"


def core(token: str) -> str:
    """The token without what is neither letter nor digit at its ends."""
    token = token.strip(_SIGNS)
    if not token or token[0].isalnum() and token[-1].isalnum():
        return token
    i, j = 0, len(token)
    while i < j and not token[i].isalnum():
        i += 1
    while j > i and not token[j - 1].isalnum():
        j -= 1
    return token[i:j]


def cores(token: str) -> list[str]:
    """A token's core and, where other signs part it, its pieces; none longer than 64."""
    if token.isalnum():
        return [token] if len(token) <= 64 else []
    whole = core(token)
    out = [whole] if whole and len(whole) <= 64 else []
    if whole and not whole.isalnum():
        out += [p for p in "".join(c if c.isalnum() else " " for c in whole).split() if len(p) <= 64]
    return out


@dataclass
class Model:
    """``weights`` of the lexicon's terms, ``known`` words of clean documents near them, and the
    curve's coefficients: constant, of log(1 + sum) and of the largest match."""

    weights: dict[str, float] = field(default_factory=dict)
    known: frozenset[str] = frozenset()
    curve: tuple[float, float, float] = (-math.log(3.0), 0.0, 0.0)


class Scorer:
    """Matches of whole texts; what a distinct token gives is worked out once and kept."""

    def __init__(self, model: Model, window: int = 5, quoted: float = 0.3, direct: float = 1.2, keep: int = 400_000):
        self.model, self.window, self.quoted, self.direct, self.keep = model, window, quoted, direct, keep
        self.automaton = Automaton(model.weights)
        self.hits: dict[str, float] = {}
        self.misses: set[str] = set()

    def of_token(self, token: str) -> float:
        best = 0.0
        for word in cores(token):
            if word in self.model.weights:
                best = max(best, self.model.weights[word])
            elif (near := self.automaton.near(word)) and word not in self.model.known:
                best = max(best, max(self.model.weights[t] * 0.5**e for t, e in near))
        return best

    def matches(self, text: str | None) -> list[float]:
        """The value of each match, in the text's order."""
        tokens = (text or "").lower().split()
        different = set(tokens)
        if len(self.misses) > self.keep:
            self.misses.clear()
        if len(self.hits) > self.keep:
            self.hits.clear()
        for t in different - self.misses:
            if t not in self.hits:
                value = self.of_token(t)
                if value:
                    self.hits[t] = value
                else:
                    self.misses.add(t)
        if not self.model.weights or different.isdisjoint(self.hits):
            return []
        return [self.hits[t] * self.context(tokens, i) for i, t in enumerate(tokens) if t in self.hits]

    def context(self, tokens: list[str], i: int) -> float:
        before, after = tokens[max(0, i - self.window) : i], tokens[i + 1 : i + 1 + self.window]
        opens = any(t[0] in MARKS for t in (*before, tokens[i]))
        closes = any(t.rstrip(".,;:!?")[-1:] in MARKS for t in (tokens[i], *after) if t.rstrip(".,;:!?"))
        if opens and closes or any(core(t) in REPORTS for t in before[-3:]):
            return self.quoted
        return self.direct if any(core(t) in ADDRESS for t in (*before, *after)) else 1.0

    def features(self, text: str | None) -> tuple[float, float]:
        values = self.matches(text)
        return (math.log1p(sum(values)), max(values)) if values else (0.0, 0.0)


def probability(curve: tuple[float, float, float], features: np.ndarray) -> np.ndarray:
    z = np.clip(curve[0] + features @ np.array(curve[1:]), -500, 500)
    return 1 / (1 + np.exp(-z))


def fit_curve(features: np.ndarray, toxic: np.ndarray, ridge: float = 0.05, steps: int = 50) -> tuple[float, float, float]:
    """Logistic regression by Newton steps; the ridge spares the constant.  A feature that would
    lower the score where matches grow is left out."""
    used = [0, 1]
    while True:
        x = np.column_stack([np.ones(len(toxic)), features[:, used]])
        w, keep = np.zeros(len(used) + 1), np.diag([0.0] + [ridge] * len(used))
        w[0] = math.log((toxic.sum() + 0.5) / (len(toxic) - toxic.sum() + 1.5))
        for _ in range(steps):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -500, 500)))
            bend = (x * (p * (1 - p))[:, None]).T @ x + keep + 1e-9 * np.eye(len(w))
            step = np.linalg.solve(bend, x.T @ (toxic - p) - keep @ w)
            w = w + step * min(1.0, 5.0 / max(np.abs(step).max(), 1e-12))
            if np.abs(step).max() < 1e-8:
                break
        if not used or w[1:].min() >= 0:
            break
        del used[int(w[1:].argmin())]
    whole = dict(zip(used, map(float, w[1:])))
    return (float(w[0]), whole.get(0, 0.0), whole.get(1, 0.0))


def lexicon(rows: Iterable[tuple[str, int, int]], n_toxic: int, n_clean: int, n_words: int, max_terms: int) -> dict[str, float]:
    """Weights of the words (word, toxic, clean documents) that are toxic beyond chance.

    The log likelihood ratio against the share of toxic documents must exceed the
    logarithm of the number of words, as among so many some always stand out.
    """
    if not n_toxic or not n_clean:
        return {}
    share, found = n_toxic / (n_toxic + n_clean), []
    for word, k, z in rows:
        own = k / (k + z)
        if k < 3 or own <= share:
            continue
        ratio = k * math.log(own / share) + (z * math.log((1 - own) / (1 - share)) if z else 0.0)
        weight = math.log((k + 0.5) / (n_toxic + 1)) - math.log((z + 0.5) / (n_clean + 1))
        if ratio > math.log(max(n_words, 2)) and weight > 2:
            found.append((-ratio, word, weight))
    return {word: weight for _, word, weight in sorted(found)[:max_terms]}


def fold_of(id_col: str) -> Column:
    return F.crc32(F.col(id_col).cast("string")) % FOLDS


def labelled(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, max_labels: int) -> DataFrame:
    """(text, toxic, fold) of about ``max_labels`` labelled rows that are not held out."""
    own = labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & (fold_of(id_col) != 0)).groupBy(F.col(id_col).alias("_id")).agg(F.max(label_col).cast("int").alias("toxic"))
    n = own.count()
    if n > max_labels:
        own = own.filter(F.pmod(F.xxhash64("_id"), F.lit(1_000_000)) < F.lit(int(1_000_000 * max_labels / n)))
    # Bounded by max_labels, so it may be broadcast; texts are not shuffled.
    return docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text")).join(F.broadcast(own), "_id").select("text", "toxic", fold_of("_id").alias("fold"))


def _word_counts(train: DataFrame) -> DataFrame:
    """(word, k, z, k_fit, z_fit): in how many toxic and clean documents, in all folds and in all but the last."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n: dict[str, list[int]] = {}
            for text, toxic, fold in zip(*(b.column(c).to_pylist() for c in ("text", "toxic", "fold"))):
                for word in {w for t in set((text or "").lower().split()) for w in cores(t)}:
                    c = n.setdefault(word, [0, 0, 0, 0])
                    c[1 - toxic] += 1
                    if fold != FOLDS - 1:
                        c[3 - toxic] += 1
            yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.string()), *(pa.array([c[i] for c in n.values()], pa.int64()) for i in range(4))], names=["word", "k", "z", "k_fit", "z_fit"])

    parts = train.select("text", "toxic", "fold").mapInArrow(count, "word string, k long, z long, k_fit long, z_fit long")
    return parts.groupBy("word").agg(*(F.sum(c).alias(c) for c in ("k", "z", "k_fit", "z_fit")))


def _known(counts: DataFrame, clean: str, weights: dict[str, float]) -> frozenset[str]:
    """Words of clean documents within the allowed edits of a term, no terms themselves."""
    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = Automaton(weights)
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([w for w in b.column("word").to_pylist() if w not in weights and automaton.near(w)], pa.string())], names=["word"])

    if not weights:
        return frozenset()
    return frozenset(r.word for r in counts.filter(F.col(clean) > 0).select("word").mapInArrow(near, "word string").collect())


def _features(train: DataFrame, model: Model) -> tuple[np.ndarray, np.ndarray]:
    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for b in batches:
            f = [scorer.features(t) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in f], pa.float64()), pa.array([x[1] for x in f], pa.float64()), b.column("toxic")], names=["total", "most", "toxic"])

    rows = train.select("text", "toxic").mapInArrow(measure, "total double, most double, toxic int").collect()
    return np.array([(r.total, r.most) for r in rows]).reshape(-1, 2), np.array([r.toxic for r in rows], float)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_labels: int = 60_000, max_terms: int = 2_000) -> Model:
    """A lexicon from all training folds; its curve from the last, with the lexicon of the others."""
    train = written(labelled(docs, labels, id_col, text_col, label_col, max_labels))  # read four times, bounded by max_labels
    n = {(r.toxic, r.fold): r["count"] for r in train.groupBy("toxic", "fold").count().collect()}
    total = [sum(v for (t, _), v in n.items() if t == side) for side in (1, 0)]
    seen = [sum(v for (t, f), v in n.items() if t == side and f != FOLDS - 1) for side in (1, 0)]
    if not sum(total):
        return Model()
    counts = written(_word_counts(train))
    n_words = counts.count()

    def terms(k: str, z: str, sizes: list[int]) -> dict[str, float]:
        likely = counts.filter((F.col(k) >= 3) & (F.col(k) * sizes[1] > F.col(z) * sizes[0]))
        # The rows of largest excess suffice: they are bounded, and the ratio decides among them.
        rows = likely.orderBy(F.desc(F.col(k) / (F.col(k) + F.col(z)) * F.log(F.col(k) + 1.0)), "word").limit(10 * max_terms).collect()
        return lexicon(((r.word, r[k], r[z]) for r in rows), *sizes, n_words, max_terms)

    first = terms("k_fit", "z_fit", seen)
    features, toxic = _features(train.filter(F.col("fold") == FOLDS - 1), Model(first, _known(counts, "z_fit", first)))
    curve = fit_curve(features, toxic) if len(toxic) else Model.curve
    weights = terms("k", "z", total)
    return Model(weights, _known(counts, "z", weights), curve)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score, predicted, matches): of every document, with the number of its matches."""
    kind = dict(docs.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for b in batches:
            found = [scorer.matches(t) for t in b.column("text").to_pylist()]
            features = np.array([(math.log1p(sum(v)), max(v, default=0.0)) for v in found]).reshape(-1, 2)
            p = probability(model.curve, features)
            yield pa.RecordBatch.from_arrays(
                [b.column("id"), pa.array(p), pa.array((p >= 0.5).astype(np.int32)), pa.array([len(v) for v in found], pa.int64())], names=["id", "score", "predicted", "matches"]
            )

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {kind}, score double, predicted int, matches long")
