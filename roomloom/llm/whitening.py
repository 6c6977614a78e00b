"""Whitening of embeddings: pivoted Cholesky of the scatter, then one-sided Jacobi on its factor.

Components become integers x = floor(scale * c) + shift.  One pass counts and sums them;
a second adds up products of y = x - m, with m the rounded mean, so that sums stay exact:
y is cut into a high and a low part whose products numpy adds without rounding.  The
centred scatter follows in whole numbers, n * sum(y y') - t t' with t = sum(y).  The
driver holds matrices of dims x dims only.  There the scatter is factored with pivoting,
P'VP = LL', and Jacobi rotations of the columns of PL make them orthogonal: their
squared norms are the eigenvalues of V, largest first, and the columns over their norms
the components.  A third pass takes the covariance of the whitened vectors themselves,
and the last whitens.

Defined cases: vectors that are null or hold null or non-finite entries are dropped, as are
empty ones; where lengths differ, those of the most frequent length (of several the
smaller) are kept.  An empty table gives no rows.  Null and repeated ids are rows like any other; other
columns are not read.  Directions without spread (a pivot below rounding) are no components,
so that equal rows alone give none and no rows.  Entries beyond 2^27 / scale would not
stay exact: they raise.  ``deviation`` is exact as a decimal of 38 digits.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .centroids import LIMIT, finite_vectors

#: Bits of the low part of y, and of t.
_LOW, _CUT = 14, 20


def _integers(df: DataFrame, vector: str, id_col: str, scale: int, dims: int) -> DataFrame:
    """(id, x) without the shift."""
    def whole(e):
        v = e.cast("double") * scale
        return F.when(F.abs(v) < LIMIT, F.floor(v)).otherwise(F.raise_error(F.lit("an entry is too large for exact sums")).cast("long"))

    return df.filter(finite_vectors(vector, dims)).select(F.col(id_col).alias("id"), F.transform(vector, whole).alias("x"))


def usual_length(df: DataFrame, vector: str) -> int:
    """The most frequent length of the usable vectors, of several the smaller; 0 without any."""
    sizes = df.filter(finite_vectors(vector, None) & (F.size(vector) > 0)).groupBy(F.size(vector).alias("d")).agg(F.count("*").alias("n"))
    best = sizes.orderBy(F.desc("n"), "d").first()
    return best.d if best else 0


def _matrix(batch: pa.RecordBatch, dims: int) -> np.ndarray:
    return batch.column("x").flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dims)


def _products(x: DataFrame, middle: np.ndarray) -> list[int]:
    """The sums of y_i y_j, exact, row by row."""
    dims = len(middle)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((3, dims * dims), np.int64)
        for b in batches:
            whole = _matrix(b, dims) - middle
            for i in range(0, len(whole), 1 << 16):  # 2^16 products of 2^28 and more stay exact
                y = whole[i : i + (1 << 16)]
                high = y >> _LOW
                h, low = high.astype(float), (y - (high << _LOW)).astype(float)
                total[0] += (low.T @ low).astype(np.int64).ravel()
                if high.any():
                    mixed = h.T @ low
                    total[1] += (mixed + mixed.T).astype(np.int64).ravel()
                    total[2] += (h.T @ h).astype(np.int64).ravel()
        at = pa.array(np.arange(dims * dims, dtype=np.int32))
        yield pa.RecordBatch.from_arrays([at, *(pa.array(t) for t in total)], names=["at", "ll", "hl", "hh"])

    parts = x.select("x").mapInArrow(add, "at int, ll long, hl long, hh long")
    sums = {r["at"]: r for r in parts.groupBy("at").agg(*(F.sum(c).alias(c) for c in ("ll", "hl", "hh"))).collect()}
    return [sums[i]["ll"] + (sums[i]["hl"] << _LOW) + (sums[i]["hh"] << 2 * _LOW) for i in range(dims * dims)]


def pivoted_cholesky(v: np.ndarray) -> np.ndarray:
    """F with F F' = V: rows in V's order, one column a pivot, the largest remaining diagonal first."""
    rest, columns = v.astype(float).copy(), []
    floor = len(v) * np.finfo(float).eps * max(np.trace(v), 0.0)
    for _ in range(len(v)):
        p = int(np.argmax(np.diag(rest)))
        if rest[p, p] <= floor:
            break
        column = rest[:, p] / np.sqrt(rest[p, p])
        for done, _ in columns:
            column[done] = 0.0
        columns.append((p, column))
        rest -= np.outer(column, column)
        rest[p, :] = rest[:, p] = 0.0
    return np.stack([c for _, c in columns], axis=1) if columns else np.zeros((len(v), 0))


def one_sided_jacobi(factor: np.ndarray, sweeps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues of F F', falling, and their unit vectors as columns: columns are rotated in
    pairs until all are orthogonal to rounding."""
    a = factor.copy()
    r = a.shape[1]
    small = 4 * np.finfo(float).eps
    for _ in range(sweeps):
        turned = False
        for i in range(r - 1):
            for j in range(i + 1, r):
                x, y = a[:, i], a[:, j]
                p, q, s = x @ x, y @ y, x @ y
                if abs(s) <= small * np.sqrt(p * q):
                    continue
                turned = True
                z = (q - p) / (2 * s)
                t = np.copysign(1.0, z) / (abs(z) + np.hypot(1.0, z))
                c = 1 / np.hypot(1.0, t)
                a[:, i], a[:, j] = c * (x - t * y), c * (t * x + y)
        if not turned:
            break
    else:
        raise ArithmeticError("rotations did not settle")
    squares = (a * a).sum(axis=0)
    order = np.argsort(-squares, kind="stable")
    return squares[order], a[:, order] / np.sqrt(squares[order])


def _whitened(x: DataFrame, kind: str, middle: np.ndarray, shift: np.ndarray, turn: np.ndarray, t: list[int]) -> DataFrame:
    """(id, squares, high, low, w): sum(y^2), sum(y t) of t's two parts, and the whitened vector of each row."""
    dims, kept = turn.shape
    parts = [np.array([a >> _CUT for a in t], np.int64), np.array([a & ((1 << _CUT) - 1) for a in t], np.int64)]

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            y = _matrix(b, dims) - middle
            w = (y - shift) @ turn
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, w.size + 1, kept, dtype=np.int32)), pa.array(w.ravel()))
            sums = [pa.array(v) for v in ((y * y).sum(axis=1), y @ parts[0], y @ parts[1])]
            yield pa.RecordBatch.from_arrays([b.column("id"), *sums, lists], names=["id", "squares", "high", "low", "w"])

    return x.mapInArrow(one, f"id {kind}, squares long, high long, low long, w array<double>")


def _identity_error(x: DataFrame, n: int, middle: np.ndarray, shift: np.ndarray, turn: np.ndarray) -> float:
    """The largest entry of the whitened vectors' covariance minus the identity; their mean is zero
    up to rounding, which the sums show and take out."""
    dims, kept = turn.shape

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        products, sums = np.zeros((kept, kept)), np.zeros(kept)
        for b in batches:
            w = (_matrix(b, dims) - middle - shift) @ turn
            products += w.T @ w
            sums += w.sum(axis=0)
        at = pa.array(np.arange(kept * kept + kept, dtype=np.int32))
        yield pa.RecordBatch.from_arrays([at, pa.array(np.concatenate([products.ravel(), sums]))], names=["at", "v"])

    found = x.select("x").mapInArrow(add, "at int, v double").groupBy("at").agg(F.sum("v").alias("v")).collect()
    v = np.zeros(kept * kept + kept)
    for r in found:
        v[r["at"]] = r["v"] / n
    mean = v[kept * kept :]
    return float(np.abs(v[: kept * kept].reshape(kept, kept) - np.outer(mean, mean) - np.eye(kept)).max())


def whiten(vectors: DataFrame, components: int = 32, id_col: str = "vec_id", vector: str = "embedding", scale: int = 64, dims: int | None = None) -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error): a row for every usable
    vector and component.

    ``deviation`` is the sum over dimensions of (n * x - S)^2; a shift of all x changes nothing.
    """
    spark, kind = vectors.sparkSession, dict(vectors.dtypes)[id_col]
    out = f"id {kind}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    dims = dims or usual_length(vectors, vector)
    if not dims:
        return spark.createDataFrame([], out)
    x = _integers(vectors, vector, id_col, scale, dims)
    first = x.agg(F.count("*").alias("n"), *(F.sum(F.col("x")[i]).alias(f"s{i}") for i in range(dims))).first()
    n, s = first["n"], [first[f"s{i}"] for i in range(dims)]
    if not n:
        return spark.createDataFrame([], out)
    middle = [(2 * v + n) // (2 * n) for v in s]
    t = [v - n * m for v, m in zip(s, middle)]
    sums = _products(x, np.array(middle, np.int64))
    v = np.array([[float(Fraction(n * sums[i * dims + j] - t[i] * t[j], n * n)) for j in range(dims)] for i in range(dims)])
    values, vectors_of = one_sided_jacobi(pivoted_cholesky(v))
    kept = min(components, len(values))
    if not kept:
        return spark.createDataFrame([], out)
    turn = vectors_of[:, :kept] / np.sqrt(values[:kept])
    at, shift = np.array(middle, np.int64), np.array([float(Fraction(a, n)) for a in t])
    error = _identity_error(x, n, at, shift, turn)
    trace = float(np.trace(v))
    white = _whitened(x, kind, at, shift, turn, t)
    whole = lambda c: F.col(c).cast("decimal(38,0)")
    number = lambda i: F.lit(str(i)).cast("decimal(38,0)")
    cross = whole("high") * number(1 << _CUT) + whole("low")
    deviation = number(n * n) * whole("squares") - number(2 * n) * cross + number(sum(a * a for a in t))
    shares = F.array(*(F.lit(float(e / trace)) for e in values[:kept]))
    return white.select("id", deviation.cast("decimal(38,0)").alias("deviation"), F.posexplode("w").alias("at", "whitened")).select(
        "id", (F.col("at") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened",
        F.get(shares, F.col("at")).alias("explained"), F.lit(error).alias("identity_error"),
    )
