"""Linear algebra over row arrays: Gram matrices by aggregation, small solves on few numbers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def gram_of(rows: DataFrame, name: str, k: int) -> np.ndarray:
    """k x k products of the columns of an array column, in one aggregation."""
    sums = [F.sum(F.get(name, i) * F.get(name, j)).alias(f"g{i}_{j}") for i in range(k) for j in range(i, k)]
    out, row = np.zeros((k, k)), rows.agg(*sums).first()
    for i in range(k):
        for j in range(i, k):
            out[i, j] = out[j, i] = row[f"g{i}_{j}"] or 0.0
    return out


def grams_by(rows: DataFrame, key: str, name: str, k: int) -> dict[int, np.ndarray]:
    """gram_of the rows of each key, in one aggregation; a k x k matrix per key returns."""
    places = [(i, j) for i in range(k) for j in range(i, k)]
    out = {}
    for row in rows.groupBy(key).agg(*(F.sum(F.get(name, i) * F.get(name, j)) for i, j in places)).collect():
        g = out[row[0]] = np.zeros((k, k))
        for (i, j), v in zip(places, row[1:], strict=True):
            g[i, j] = g[j, i] = v or 0.0
    return out


def times(h: Column, m: np.ndarray) -> list[Column]:
    """The entries of the row h times the matrix m."""
    return [sum((F.get(h, j) * float(m[j, i]) for j in range(m.shape[0])), F.lit(0e0)) for i in range(m.shape[1])]


def sum_vector(name: str | Column, k: int, weight: Column | None = None) -> list[Column]:
    """Aggregates x0..: sums of an array column's entries, weighted."""
    return [F.sum(F.get(name, i) * weight if weight is not None else F.get(name, i)).alias(f"x{i}") for i in range(k)]


def nnls(gram: np.ndarray, targets: np.ndarray, tol: float = 1e-13, most: int = 50_000) -> np.ndarray:
    """Of each row b of targets the x >= 0 that minimises x'Gx - 2 b'x, for G = A'A and b = A'y.

    All rows at once by cyclic coordinate descent: each entry in turn goes to its best value with the others held, but
    not below 0. A column of A without length has entry 0. Stops when a sweep changes no entry by more than tol of the
    largest.
    """
    targets = np.atleast_2d(np.asarray(targets, float))
    x, length = np.zeros_like(targets), np.diag(gram)
    for _ in range(most):
        before = x.copy()
        for i in np.flatnonzero(length > 0):
            x[:, i] = np.maximum(0.0, x[:, i] + (targets[:, i] - x @ gram[:, i]) / length[i])
        if not x.size or np.abs(x - before).max() <= tol * np.abs(x).max():
            break
    return x


def nnls_rows(targets: DataFrame, key: str, gram: np.ndarray) -> DataFrame:
    """key, w: of each row's array b the nonnegative solution; only k numbers a row reach Python."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            if len(p):
                yield pd.DataFrame({key: p[key], "w": list(nnls(gram, np.stack(p["b"].to_list())))})

    return targets.select(key, "b").mapInPandas(run, f"{key} long, w array<double>")


def pca(points: DataFrame, components: int) -> tuple[DataFrame, np.ndarray]:
    """Scores (id, h) of centred points (id, h: array<double>) on the leading directions, whose largest entry by size is
    positive, and the directions. The covariance is summed on the executors."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector

    n = points.count()
    d = len(points.first()["h"]) if n else 0
    c = min(components, n, d)
    if not c:
        return points.select("id", F.array().cast("array<double>").alias("h")), np.zeros((d, 0))
    v = PCA(k=c, inputCol="v", outputCol="p").fit(points.withColumn("v", array_to_vector("h"))).pc.toArray()
    v = v * np.where(v[np.abs(v).argmax(axis=0), np.arange(c)] < 0, -1.0, 1.0)
    mean = np.array(points.agg(*(F.avg(F.get("h", i)) for i in range(d))).first(), float)
    dirs = F.lit(v.T.tolist())
    centred = F.zip_with("h", F.lit(mean.tolist()), lambda x, m: x - m)
    score = F.transform(dirs, lambda u: F.aggregate(F.zip_with(centred, u, lambda x, y: x * y), F.lit(0e0), lambda s, x: s + x))
    return points.select("id", score.alias("h")), v
