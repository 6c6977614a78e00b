"""Suffix-array dedup against brute force over all byte strings."""

import random

import numpy as np

from roomloom.llm import repeats

DOCS = "doc_id long, text string, key long, hash string, kept string"


def brute(rows, size=50):
    first = {}
    data = [(-1 if d is None else d, (t or "").encode()) for d, t in rows]
    for d, b in data:
        for i in range(len(b) - size + 1):
            w = b[i : i + size]
            first[w] = min(d, first.get(w, d))
    out = []
    for d, b in data:
        gone = bytearray(len(b))
        for i in range(len(b) - size + 1):
            if first[b[i : i + size]] < d:
                gone[i : i + size] = b"\1" * size
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((d, len(b), sum(gone), spans, bytes(x for x, g in zip(b, gone) if not g)))
    return sorted(out)


def run(spark, rows, **more):
    df = spark.createDataFrame([(d, t, 1, "h", "k") for d, t in rows], DOCS).repartition(3)
    got = repeats.remove_repeats(df, **more).collect()
    return sorted((-1 if r.doc_id is None else r.doc_id, r.n_bytes, sum(x.end - x.start for x in r.removed), len(r.removed), bytes(r.kept)) for r in got)


def test_removed_bytes_equal_brute_force(spark):
    rng = random.Random(8)
    word = lambda: rng.choice(["é", "the ", "of ", "ab", "x", "tion ", "\n", "\x00", "ÿ"])
    text = lambda n: "".join(word() for _ in range(n))
    passages = [text(rng.randrange(20, 60)) for _ in range(8)]
    rows = [(None, passages[0]), (0, None), (1, ""), (2, "short"), (3, "short"), (4, "a" * 70_000), (5, "a" * 66_000), (6, "b" + "a" * 49), (7, "a" * 49)]
    for d in range(10, 150):
        parts = [text(rng.randrange(30)) for _ in range(rng.randrange(1, 5))]
        for _ in range(rng.randrange(3)):
            parts.insert(rng.randrange(len(parts) + 1), rng.choice(passages)[rng.randrange(5) :])
        rows.append((d, "".join(parts)))
    rows += [(200 + i, rows[40][1]) for i in range(30)] + [(200, rows[40][1]), (201, passages[1] * 3)]
    rng.shuffle(rows)
    assert run(spark, rows) == brute(rows)
    assert run(spark, rows, slice_bytes=2000) == brute(rows)
    assert run(spark, []) == []


def test_rows_of_one_id_are_judged_by_their_own_texts(spark):
    a, b = "first passage " * 9, "other words of some length " * 5
    rows = [(5, a), (5, b), (5, a + b), (3, b), (None, b[:60]), (7, a[:50]), (7, a[:50])]
    assert run(spark, rows) == brute(rows)


def test_span_hashes_depend_on_the_bytes_alone():
    data = np.frombuffer(b"abcabcdabcd" * 40, np.uint8)
    starts, lengths = np.arange(len(data) - 8), np.tile([3, 5, 8], len(data))[: len(data) - 8]
    for step in (1, 7, 1 << 20):
        names = repeats.span_hashes(data, starts, lengths, step)
        own = [data[s : s + n].tobytes() for s, n in zip(starts, lengths)]
        assert len(set(names.tolist())) == len(set(own)) == len(set(zip(names.tolist(), own)))


def test_suffix_array_equals_sorting():
    rng = np.random.default_rng(4)
    for k in range(60):
        text = rng.integers(1, [3, 5, 256][k % 3], rng.integers(1, 200)).astype(np.uint8)
        got = repeats.suffix_array(text, 300)
        assert got.tolist() == sorted(range(len(text)), key=lambda i: text[i:].tobytes())


def test_runs_hold_every_string_once():
    rng = np.random.default_rng(5)
    data = rng.integers(97, 100, 700).astype(np.uint8)
    bounds = np.array([0, 0, 49, 99, 300, 300, 700])
    doc, start, count, key = repeats.runs_of(data, bounds, 50, 20)
    got = sorted((d, s + i) for d, s, c in zip(doc, start, count) for i in range(c))
    assert got == [(d, s) for d in range(6) for s in range(bounds[d], bounds[d + 1] - 49)]
    for d, s, c, k in zip(doc, start, count, key):
        for i in range(s, s + c):
            assert repeats.mixed(np.array([min(repeats.gram_hashes(data[i : i + 50], 20))]))[0] == k
