"""Near-dedup against brute force: chains, large groups, equal sets, odd rows."""

import random
import re

import numpy as np
from pyspark.sql import functions as F

from roomloom.llm import neardup
from roomloom.llm.components import components

DOCS = "doc_id long, text string, id long, digest string, n long"


def shingle_set(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({i: i + 32 for i in range(65, 91)}))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(texts):
    sets = [shingle_set(t) for t in texts]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [(i, len(s), find(i), find(i) == i) for i, s in enumerate(sets)]


def run(spark, texts, **more):
    df = spark.createDataFrame([(i, t, 1, "d", 2) for i, t in enumerate(texts)], DOCS).repartition(3)
    return sorted(tuple(r) for r in neardup.near_duplicates(df, **more).collect())


def test_components_equal_brute_force(spark):
    rng = random.Random(6)
    word = lambda: f"w{rng.randrange(400)}"
    texts = [None, "", " \n", "one", "One", "one two three four", "ONE two\nthree  four", "É a b c d e", "é a b c d e"]
    for _ in range(12):
        base = [word() for _ in range(rng.randrange(8, 120))]
        for _ in range(rng.randrange(1, 9)):  # a chain of edits: links need not close
            texts.append(" ".join(base))
            for _ in range(rng.randrange(4)):
                base[rng.randrange(len(base))] = word()
    shared = [word() for _ in range(60)]
    texts += [" ".join(shared + [f"x{i}y{k}" for k in range(rng.choice([5, 20, 60]))]) for i in range(60)]
    texts += ["same copy of a longer text with more words"] * 20
    rng.shuffle(texts)
    assert run(spark, texts) == brute(texts)
    assert run(spark, texts, block=4, max_broadcast_bytes=0, star_above=0) == brute(texts)


def test_rows_without_ids_and_repeated_ids(spark):
    df = spark.createDataFrame([(None, "a b c d e f", 1, "d", 1), (None, "q q", 1, "d", 1), (3, "a b c d e f", 1, "d", 1), (3, "a b c d e f", 1, "d", 1), (3, "z z z", 1, "d", 1)], DOCS)
    rows = sorted((str(r.doc_id), r.n_shingles, r.component_id, r.kept) for r in neardup.near_duplicates(df).collect())
    assert rows == [("3", 1, 3, True), ("3", 2, 3, True), ("3", 2, 3, True), ("None", 1, None, True), ("None", 2, 3, False)]
    assert neardup.near_duplicates(df.limit(0)).count() == 0


def brute_rows(rows):
    """Components of (id, text) rows whose ids may be null or repeated."""
    sets = [shingle_set(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, (d, _) in enumerate(rows):
        for j in range(i):
            both = len(sets[i] & sets[j])
            linked = both and 100 * both >= 75 * len(sets[i] | sets[j])
            if linked or sets[i] and sets[j] and d is not None and d == rows[j][0]:
                root[find(i)] = find(j)
    out = []
    for i, (d, _) in enumerate(rows):
        ids = [e for j, (e, _) in enumerate(rows) if find(j) == find(i) and e is not None]
        c = min(ids, default=None) if sets[i] else d
        out.append((d, len(sets[i]), c, c == d))
    return sorted(out, key=str)


def test_null_and_repeated_ids_equal_brute_force(spark):
    rng = random.Random(11)
    rows = [(2, "t u v w x"), (3, "t u v w x"), (3, "k l m n o"), (5, "k l m n o"), (3, ""), (None, None)]
    for case in range(3):
        for _ in range(10):
            base = [f"w{rng.randrange(300)}" for _ in range(rng.randrange(6, 60))]
            for _ in range(rng.randrange(1, 6)):
                rows.append((rng.choice([None, None, rng.randrange(60)]), " ".join(base)))
                base[rng.randrange(len(base))] = f"w{rng.randrange(300)}"
        df = spark.createDataFrame([(d, t, 1, "d", 2) for d, t in rows], DOCS).repartition(3)
        assert sorted(map(tuple, neardup.near_duplicates(df, block=8).collect()), key=str) == brute_rows(rows)


def test_a_large_group_does_not_meet_itself_for_a_few_strays(spark):
    """Strays share buckets with the group and links with none; the plan's joins stay far from its square."""
    base = [f"w{k}" for k in range(60)]
    group = [" ".join([*base, f"x{i}", f"y{i}"]) for i in range(3000)]
    strays = [" ".join([*base, *(f"s{i}z{k}" for k in range(24))]) for i in range(5)]
    got = run(spark, [*group, *strays])
    assert {r[2] for r in got[:3000]} == {0}
    for i, r in enumerate(got[3000:]):
        mine = shingle_set(strays[i])
        both = len(mine & shingle_set(group[0]))
        assert r[2] == (0 if 100 * both >= 75 * len(mine | shingle_set(group[0])) else 3000 + i)


def test_components_of_a_long_path(spark):
    ids = list(range(200))
    random.Random(1).shuffle(ids)
    edges = spark.createDataFrame(list(zip(ids, ids[1:])) + [(500, 500), (501, 500)], "a long, b long")
    got = {r.node: r.label for r in components(edges).collect()}
    assert got == {**{i: 0 for i in range(1, 200)}, 501: 500}


def test_odd_sketches_estimate_high_similarities():
    rng = np.random.default_rng(3)
    for j in (0.75, 0.9):
        bits = []
        for _ in range(60):
            n = 400
            both = int(2 * n * j / (1 + j))
            x = rng.integers(0, 2**63, 2 * n - both, dtype=np.uint64)
            s = neardup.odd_sketches(np.stack([neardup.minhashes(x[:n]), neardup.minhashes(x[n - both :])]))
            bits.append(sum(int(v).bit_count() for v in (s[0] ^ s[1]).view(np.uint64)))
        assert abs(np.mean(bits) - neardup.most_bits(j)) < 4 and max(bits) < neardup.most_bits(0.5)
