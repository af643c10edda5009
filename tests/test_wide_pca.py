"""Wide components against numpy's decomposition."""

import numpy as np
import pytest

from sparkfactors.operators import linalg
from sparkfactors.operators.wide_pca import wide_pca


def exact(m, k):
    c = m - m.mean(axis=0)
    u, s, v = np.linalg.svd(c, full_matrices=False)
    sign = np.array([-1.0 if r[np.abs(r).argmax()] < 0 else 1.0 for r in v[:k]])
    return u[:, :k] * s[:k] * sign, v[:k] * sign[:, None], s[:k]


def sparse(spark, m):
    i, j = np.nonzero(m)
    rows = list(zip(i.tolist(), j.tolist(), m[i, j].tolist(), strict=True))
    return spark.createDataFrame(rows, "spot_id long, gene_id long, value double").repartition(4), spark.range(len(m)).withColumnRenamed("id", "spot_id")


def planted(n, g, rank, seed=0):
    r = np.random.default_rng(seed)
    z, w = r.exponential(size=(n, rank)) * np.linspace(3, 1, rank), r.exponential(size=(rank, g))
    return np.where(r.random((n, g)) < 0.3, z @ w + r.normal(0, 0.3, (n, g)), 0.0) if rank else np.zeros((n, g))


def test_scores_are_those_of_the_exact_decomposition(spark):
    m = planted(120, 90, 4)
    m[7] = 0.0
    expr, spots = sparse(spark, m)
    got = wide_pca(expr, spots, 3, oversample=12, most=60)
    scores, directions, s = exact(m, 3)
    assert got.moved <= 1e-13 and np.allclose(got.singular, s, rtol=1e-9)
    h = np.array([r["h"] for r in got.scores.orderBy("id").collect()])
    assert h.shape == (120, 3) and np.abs(h - scores).max() < 1e-6 * np.abs(scores).max()
    w = {r["gene_id"]: r["w"] for r in got.directions.collect()}
    assert all(np.allclose(w.get(g, np.zeros(3)), directions[:, g], atol=1e-6) for g in range(90))


def test_few_genes_are_exact_and_agree_with_the_other_form(spark):
    m = planted(60, 8, 3)
    expr, spots = sparse(spark, m)
    got = wide_pca(expr, spots, 4)
    assert got.rounds == 1 and np.allclose(got.singular, exact(m, 4)[2], rtol=1e-9)
    points = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(m)], "id long, h array<double>")
    other, _ = linalg.pca(points, 4)
    a, b = (np.array([r["h"] for r in df.orderBy("id").collect()]) for df in (got.scores, other))
    assert np.allclose(a, b, atol=1e-7)


def test_joined_instead_of_broadcast(spark):
    m = planted(50, 40, 3, 2)
    expr, spots = sparse(spark, m)
    a, b = wide_pca(expr, spots, 2, most=4), wide_pca(expr, spots, 2, most=4, broadcast_below=0)
    assert np.allclose(a.singular, b.singular, rtol=1e-10) and a.rounds == b.rounds == 4


def test_odd_matrices(spark):
    expr, spots = sparse(spark, np.ones((5, 3)))
    assert np.allclose(wide_pca(expr, spots, 2).singular, 0, atol=1e-7)
    assert wide_pca(expr.limit(0), spots, 2).scores.count() == 5
    with pytest.raises(ValueError):
        wide_pca(expr, spots, 0)
