"""Toxicity: automata against edit distances, context, learned lexicon, held-out accuracy."""

import math
import random
import zlib

import pytest

from roomloom.llm import queries, toxicity

TERMS = ["worm", "idiot", "moron", "worthless", "disgustingness", "straße"]


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


@pytest.mark.parametrize("max_states", [100_000, 5])
def test_automaton_finds_what_edit_distance_finds(max_states):
    rng = random.Random(4)
    automaton = toxicity.Automaton(TERMS, max_states)
    words = list(TERMS)
    for _ in range(3000):
        w = list(rng.choice(TERMS))
        for _ in range(rng.randrange(4)):
            i = rng.randrange(len(w) + 1)
            w[i : i + rng.randrange(2)] = rng.choice(["", rng.choice("aeiorstß1")])
        words.append("".join(w))
    for w in words:
        want = {(t, distance(w, t)) for t in TERMS if distance(w, t) <= toxicity.edits_allowed(t)}
        assert set(automaton.near(w)) == want, w


def test_no_terms():
    assert toxicity.Automaton([]).near("word") == []
    assert toxicity.Scorer(toxicity.Model()).features("any text") == (0.0, 0.0)


def test_context_tells_quotation_from_abuse():
    scorer = toxicity.Scorer(toxicity.Model({"idiot": 6.0, "worthless": 5.0}, frozenset({"idiom"})))
    assert scorer.matches(None) == scorer.matches("") == scorer.matches("a clean text") == []
    assert scorer.matches("What an IDIOT, really") == [6.0]
    assert scorer.matches("what an idi0t indeed") == [3.0]
    assert scorer.matches("an idiom of the land") == []  # known from clean texts
    assert scorer.matches("you are an idiot") == [pytest.approx(7.2)]
    assert scorer.matches('the "idiot" of the novel') == [pytest.approx(1.8)]
    assert scorer.matches("they used the word idiot there") == [pytest.approx(1.8)]
    assert scorer.matches("wurthless, and idiot/idiot!") == [2.5, 6.0]
    assert scorer.matches("idiot" * 50_000) == []


def texts(n, seed):
    rng = random.Random(seed)
    clean = ["".join(rng.choices("abcdefghij", k=rng.randrange(3, 8))) for _ in range(400)]
    out = []
    for i in range(n):
        words, bad = rng.choices(clean, k=60), i % 4 == 0
        if bad:
            for _ in range(3):
                words[rng.randrange(60)] = rng.choice(("zloser", "zmoronic", "zscumbag"))
        out.append((i, " ".join(words), int(bad)))
    return out


def test_learns_a_lexicon_and_catches_misspellings(spark):
    rows = texts(600, 1)
    docs = spark.createDataFrame([(i, t, "kept", 1.0) for i, t, _ in rows], "doc_id long, text string, score string, matches double").repartition(3)
    labels = spark.createDataFrame([(i, y, 1) for i, _, y in rows] + [(4, 0, 1), (None, 1, 1), (3, None, 1)], "doc_id long, toxic int, fold int")
    model = toxicity.fit(docs, labels)
    assert {"zloser", "zmoronic", "zscumbag"} == set(model.weights)
    out = {r.id: r for r in toxicity.score(docs, model).collect()}
    assert len(out) == 600 and all(out[i].predicted == y for i, _, y in rows)
    more = [(1, "zlosar and zmoronoc with zscunbag"), (2, 'the word "zloser" in a book'), (3, None), (4, ""), (None, "zloser zloser zscumbag"), (1, "abc")]
    got = [(r.id, r.predicted) for r in toxicity.score(spark.createDataFrame(more, "doc_id long, text string"), model).collect()]
    assert sorted(got, key=repr) == sorted([(1, 1), (2, 0), (3, 0), (4, 0), (None, 1), (1, 0)], key=repr)


def test_bounded_labels_and_none(spark):
    rows = texts(900, 2)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    used = toxicity.labelled(docs, labels, "doc_id", "text", "toxic", 300).collect()
    assert 200 < len(used) < 400 and all(0 < r.fold < 5 for r in used)
    everything = toxicity.labelled(docs, labels, "doc_id", "text", "toxic", 10_000)
    assert everything.count() == sum(zlib.crc32(str(i).encode()) % 5 != 0 for i, _, _ in rows)
    none = toxicity.fit(docs, labels.limit(0))
    assert none == toxicity.Model()
    assert {(round(r.score, 9), r.predicted) for r in toxicity.score(docs, none).collect()} == {(0.25, 0)}
    only_clean = toxicity.fit(docs, labels.filter("toxic = 0"))
    assert not only_clean.weights and {r.predicted for r in toxicity.score(docs, only_clean).collect()} == {0}
    assert toxicity.score(docs.limit(0), none).collect() == []


def test_held_out_labels_do_not_matter(spark):
    rows = texts(300, 3)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    turned = [(i, 1 - y if zlib.crc32(str(i).encode()) % 5 == 0 else y) for i, _, y in rows]
    one = toxicity.fit(docs, spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int"))
    two = toxicity.fit(docs, spark.createDataFrame(turned, "doc_id long, toxic int"))
    assert one.weights == two.weights and one.known == two.known and all(math.isclose(a, b, abs_tol=1e-6) for a, b in zip(one.curve, two.curve))


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    out = {r.doc_id: r for r in queries.QUERIES["op12_toxicity"](spark, sf).collect()}
    assert len(out) == queries.table(spark, sf, "documents").count()
    held = [(out[r.doc_id], r.toxic) for r in queries.table(spark, sf, "labels").collect() if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert all(r.held_out for r, _ in held) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in out.values())
    assert sum(r.predicted == y for r, y in held) >= 0.95 * len(held)
