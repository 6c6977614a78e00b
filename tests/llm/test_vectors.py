"""Whitening and k-means over vectors, against plain versions."""

import hashlib
import math
import random
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from roomloom.llm import centroids, whitening

SCHEMA = "vec_id long, embedding array<float>, label int, cluster int, x string, id int"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 0, 9, "clash", 7) for i, v in rows], SCHEMA).repartition(3)


def vectors(n, dims, seed, spread=1.0):
    rng = random.Random(seed)
    return [[float(np.float32(rng.gauss(j % 3, spread * (1 + j % 5)))) for j in range(dims)] for _ in range(n)]


def odd(dims):
    """Rows that are left out: null, null and non-finite entries."""
    some = [0.5] * (dims - 1)
    return [None, [None, *some], [math.nan, *some], [math.inf, *some], [-math.inf, *some], []]


# ---------------------------------------------------------------- whitening
def plain_whitening(rows, components):
    x = np.array([[math.floor(64 * c) + 1_000_000 for c in v] for v in rows])
    n, s = len(x), x.sum(axis=0)
    centred = np.array([[float(Fraction(n * int(a) - int(b), n)) for a, b in zip(r, s)] for r in x])
    v = centred.T @ centred / n
    e, u = np.linalg.eigh(v)
    e, u = e[::-1], u[:, ::-1]
    kept = min(components, int((e > 1e-13 * e.sum()).sum()))
    deviation = [sum((n * int(a) - int(b)) ** 2 for a, b in zip(r, s)) for r in x]
    return e[:kept], e[:kept] / np.trace(v), centred @ u[:, :kept] / np.sqrt(e[:kept]), deviation


@pytest.mark.parametrize("dims, count, kept", [(6, 200, 32), (6, 200, 3), (5, 4, 32)])
def test_whitening_equals_eigenvectors(spark, dims, count, kept):
    rows = vectors(count, dims, dims + kept)
    rows += rows[:2] if count > 10 else []
    df = frame(spark, [(i if i != 1 else None, v) for i, v in enumerate(rows)] + [(900 + i, v) for i, v in enumerate(odd(dims))])
    out = whitening.whiten(df, components=kept).collect()
    e, share, want, deviation = plain_whitening(rows, kept)
    assert len(out) == len(rows) * len(e)
    got = np.zeros_like(want)
    for r in out:
        i = 1 if r.id is None else r.id
        got[i, r.component - 1] = r.whitened
        assert r.n == len(rows) and int(r.deviation) == deviation[i]
        assert abs(r.explained / share[r.component - 1] - 1) < 1e-9
        assert r.identity_error < 1e-4
    assert np.abs(got * np.sign((got * want).sum(axis=0)) - want).max() < 1e-6


def test_whitening_keeps_small_spread_beside_large(spark):
    rng = np.random.default_rng(3)
    rows = [[float(np.float32(v)) for v in (a * 30000, a * 30000 + b, c)] for a, b, c in rng.normal(size=(300, 3))]
    out = whitening.whiten(frame(spark, enumerate(rows)), components=3).collect()
    e, share, _, _ = plain_whitening(rows, 3)
    assert {r.component for r in out} == {1, 2, 3} and out[0].identity_error < 1e-4
    assert all(abs(r.explained / share[r.component - 1] - 1) < 1e-4 for r in out if r.component < 3)


def test_whitening_of_little(spark):
    assert whitening.whiten(frame(spark, [])).collect() == []
    assert whitening.whiten(frame(spark, [(i, v) for i, v in enumerate(odd(4))])).collect() == []
    assert whitening.whiten(frame(spark, [(1, [0.5, 1.5])] * 3)).collect() == []  # equal rows have no spread
    two = whitening.whiten(frame(spark, [(1, [0.5, 1.5]), (2, [1.0, 1.5]), (3, [2.0]), (4, [2.0, 2.5, 1.0])])).collect()
    assert {(r.id, r.component, round(abs(r.whitened), 9), r.explained) for r in two} == {(1, 1, 1.0, 1.0), (2, 1, 1.0, 1.0)}
    with pytest.raises(Exception, match="too large"):
        whitening.whiten(frame(spark, [(1, [1e30, 1.0]), (2, [1.0, 1.0])])).collect()


def test_large_entries_stay_exact(spark):
    rows = [[float(np.float32(v)) for v in r] for r in np.random.default_rng(1).uniform(-2e6, 2e6, (50, 3))]
    out = whitening.whiten(frame(spark, enumerate(rows)), components=1).collect()
    deviation = plain_whitening(rows, 1)[3]
    assert all(int(r.deviation) == deviation[r.id] for r in out)


def test_jacobi_on_a_pivoted_factor():
    rng = np.random.default_rng(2)
    a = rng.normal(size=(8, 5))
    v = a @ np.diag([1e8, 1e4, 1.0, 1e-2, 1e-4]) @ a.T
    f = whitening.pivoted_cholesky(v)
    assert f.shape[1] >= 4 and np.abs(f @ f.T - v).max() < 1e-6 * np.trace(v) * 1e-6
    e, u = whitening.one_sided_jacobi(f)
    assert np.allclose(u.T @ u, np.eye(len(e)), atol=1e-10) and list(e) == sorted(e, reverse=True)
    assert np.allclose(e[:3], np.linalg.eigvalsh(v)[::-1][:3], rtol=1e-9)


# ---------------------------------------------------------------- k-means
def plain_kmeans(rows, k, rounds, seed, scale=1024):
    x = [(i, [math.floor(scale * c) for c in v]) for i, v in rows]
    far = lambda a, b: sum((p - q) ** 2 for p, q in zip(a, b))
    order = sorted((hashlib.sha256(f"{seed}:{i}".encode()).hexdigest(), v) for i, v in x if i is not None)
    centres = [v for _, v in order[:k]]
    for turn in range(rounds + 1):
        own = [min(range(len(centres)), key=lambda j: (far(v, centres[j]), j)) for _, v in x]
        if turn < rounds:
            for j in range(len(centres)):
                members = [v for (_, v), c in zip(x, own) if c == j]
                if members:
                    centres[j] = [sum(col) // len(members) for col in zip(*members)]
    return sorted(((i, c, far(v, centres[c]), tuple(centres[c])) for (i, v), c in zip(x, own)), key=repr)


@pytest.mark.parametrize("dims, count, k, rounds", [(4, 300, 8, 10), (3, 40, 5, 4), (2, 3, 8, 2), (4, 60, 1, 3), (4, 50, 4, 0)])
def test_clusters_equal_plain_rounds(spark, dims, count, k, rounds):
    rows = list(enumerate(vectors(count, dims, count)))
    rows += [(None, rows[0][1]), (0, rows[1][1])] + [(1000 + i, rows[2][1]) for i in range(count // 2)]  # null and repeated ids, a hot vector
    df = frame(spark, rows + [(900 + i, v) for i, v in enumerate(odd(dims))] + [(950, [1.0] * (dims + 1))])
    out = centroids.cluster(df, k, rounds, seed=3, dims=dims).collect()
    want = plain_kmeans(rows, k, rounds, 3)
    assert sorted(((r.id, r.cluster, r.distance, tuple(r.centroid)) for r in out), key=repr) == want
    assert {r.inertia for r in out} == {sum(w[2] for w in want)}
    for r in out:
        assert r.cluster_inertia == sum(w[2] for w in want if w[1] == r.cluster)


def test_ties_and_empty_clusters(spark):
    rows = [(i, [float(i % 2), 0.0]) for i in range(20)]  # two places, more centroids than places
    out = centroids.cluster(frame(spark, rows), 5, 3, dims=2).collect()
    assert sorted(((r.id, r.cluster, r.distance, tuple(r.centroid)) for r in out), key=repr) == plain_kmeans(rows, 5, 3, 3)


def test_only_expired_vectors_are_scanned_again(spark):
    """Far groups settle after a round: later folders hold few records, and none is read twice."""
    rows = [(i, [100.0 * (i % 4) + (i % 7) * 0.01, 50.0 * (i % 4)]) for i in range(400)]
    scanned = []
    push = centroids._Heaps.push

    def counted(self, records):
        out = push(self, records)
        scanned.append(out.count())
        return out

    centroids._Heaps.push = counted
    try:
        out = centroids.cluster(frame(spark, rows), 4, 8, dims=2).collect()
    finally:
        centroids._Heaps.push = push
    assert len(out) == 400 and scanned[0] == 400 and sum(scanned[3:]) < 400
    assert sorted(((r.id, r.cluster, r.distance, tuple(r.centroid)) for r in out), key=repr) == plain_kmeans(rows, 4, 8, 3)


def test_no_vectors_and_too_large_ones(spark):
    assert centroids.cluster(frame(spark, []), 8, 10).collect() == []
    assert centroids.cluster(frame(spark, [(i, v) for i, v in enumerate(odd(64))]), 8, 2).collect() == []
    with pytest.raises(Exception, match="too large"):
        centroids.cluster(frame(spark, [(1, [1e30, 1.0])]), 1, 1, dims=2).collect()


def test_digest(spark):
    row = spark.range(1).select(centroids.centroid_digest(F.array(F.lit(1).cast("long"), F.lit(-2).cast("long"))).alias("d")).first()
    assert row.d == hashlib.sha256(b"1,-2").hexdigest()
