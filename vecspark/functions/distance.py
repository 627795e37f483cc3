"""The four metrics as column expressions, and the same over matrices for Arrow batches.

Sums run from left to right in double. Scores: higher is nearer. Cosine of a zero vector is 0.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(a: Column, b: Column, term) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: term(x.cast("double"), y.cast("double"))), F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return _sum(a, b, lambda x, y: x * y)


def squared_l2(a: Column, b: Column) -> Column:
    return _sum(a, b, lambda x, y: (x - y) * (x - y))


def l1(a: Column, b: Column) -> Column:
    return _sum(a, b, lambda x, y: F.abs(x - y))


def cosine(a: Column, b: Column) -> Column:
    norm = F.sqrt(dot(a, a) * dot(b, b))
    return F.when(norm == 0, 0.0).otherwise(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b) / norm)))


def distance(metric: str, a: Column, b: Column) -> Column:
    """Smaller is nearer."""
    return {"Cosine": lambda: 1 - cosine(a, b), "Dot": lambda: -dot(a, b), "Euclid": lambda: squared_l2(a, b), "Manhattan": lambda: l1(a, b)}[metric]()


def score(metric: str, a: Column, b: Column) -> Column:
    if metric == "Cosine":
        return cosine(a, b)
    return dot(a, b) if metric == "Dot" else 1 / (1 + F.sqrt(distance(metric, a, b)))


def normalised(v: Column) -> Column:
    """v over its length; a zero vector stays."""
    norm = F.sqrt(dot(v, v))
    return F.when(norm == 0, v.cast("array<double>")).otherwise(F.transform(v, lambda x: x.cast("double") / norm))


def vector(values) -> Column:
    return F.lit([float(x) for x in values]).cast("array<double>")


def matrix(vectors: pa.Array) -> np.ndarray:
    """A row for each of an Arrow column's vectors, which are of one length and not null."""
    return vectors.flatten().to_numpy(zero_copy_only=False).reshape(len(vectors), -1)


def scores(metric: str, queries: np.ndarray, points: np.ndarray) -> np.ndarray:
    """A row for each query, a column for each point."""
    q, x = queries.astype(np.float64), points.astype(np.float64)
    if metric == "Dot":
        return q @ x.T
    if metric == "Cosine":
        s, norm = q @ x.T, np.outer((q * q).sum(1), (x * x).sum(1))
        np.sqrt(norm, out=norm)
        zero = norm == 0
        norm[zero] = 1
        with np.errstate(invalid="ignore"):
            s /= norm
        np.clip(s, -1, 1, out=s)
        s[zero] = 0
        return s
    if metric == "Euclid":
        far = np.stack([((x - row) ** 2).sum(1) for row in q]) if len(q) else np.zeros((0, len(x)))
    else:
        far = np.stack([np.abs(x - row).sum(1) for row in q]) if len(q) else np.zeros((0, len(x)))
    return 1 / (1 + np.sqrt(far))


def pair_scores(metric: str, queries: np.ndarray, points: np.ndarray, row: np.ndarray, col: np.ndarray) -> np.ndarray:
    """The scores of queries[row] and points[col], summed from left to right as the column expressions and SQL do."""

    def total(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray, term) -> np.ndarray:
        s = np.zeros(len(i))
        for d in range(a.shape[1]):
            s += term(a[i, d], b[j, d])
        return s

    times = lambda x, y: x * y
    if metric in ("Dot", "Cosine"):
        dots = total(queries, points, row, col, times)
        if metric == "Dot":
            return dots
        (asked, row), (met, col) = (np.unique(n, return_inverse=True) for n in (row, col))
        aa, bb = (total(m, m, n, n, times) for m, n in ((queries, asked), (points, met)))
        norm = np.sqrt(aa[row] * bb[col])
        return np.where(norm == 0, 0.0, np.clip(dots / np.where(norm == 0, 1, norm), -1, 1))
    far = total(queries, points, row, col, (lambda x, y: (x - y) * (x - y)) if metric == "Euclid" else lambda x, y: np.abs(x - y))
    return 1 / (1 + np.sqrt(far))


def register_sql(spark) -> None:
    """The scores as temporary SQL functions over two array<double>: vs_dot, vs_cosine, vs_euclid, vs_manhattan."""
    fold = "aggregate(zip_with(a, b, (x, y) -> {term}), 0D, (s, x) -> s + x)"
    d, aa, bb = (f"aggregate(zip_with({x}, {y}, (p, q) -> p * q), 0D, (s, p) -> s + p)" for x, y in (("a", "b"), ("a", "a"), ("b", "b")))
    bodies = {
        "vs_dot": d,
        "vs_cosine": f"CASE WHEN sqrt({aa} * {bb}) = 0 THEN 0D ELSE greatest(-1D, least(1D, {d} / sqrt({aa} * {bb}))) END",
        "vs_euclid": f"1 / (1 + sqrt({fold.format(term='(x - y) * (x - y)')}))",
        "vs_manhattan": f"1 / (1 + sqrt({fold.format(term='abs(x - y)')}))",
    }
    for name, body in bodies.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>) RETURNS DOUBLE RETURN {body}")
