"""Models on planted data."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkfactors.functions import concordance
from sparkfactors.operators import graph, linalg, models, prep
from sparkfactors.operators.kmeans import kmeans, kmeans_over_components


@pytest.fixture(scope="module")
def stripes(spark):
    """A 10 x 10 lattice in three stripes, each with its genes."""
    r = np.random.default_rng(0)
    spots, expr = [], []
    for i in range(100):
        s = (i % 10) // 4
        spots.append((i, 0, float(i % 10), float(i // 10), str(s)))
        expr += [(i, g, float(r.uniform(0, 0.05) + (g // 6 == s))) for g in range(18)]
    return spark.createDataFrame(spots, "spot_id long, section_id long, x double, y double, gt string").cache(), spark.createDataFrame(expr, "spot_id long, gene_id long, value double").cache()


def agreement(labels, spots):
    return concordance.ari(labels.join(spots, "spot_id").select(F.col("domain_id").alias("t"), F.col("gt").alias("p"))).first()[0]


def test_gnmf_descends_and_finds_stripes(stripes):
    spots, expr = stripes
    edges = graph.knn_undirected(spots, 6)
    out = models.gnmf_domains(expr, edges, spots, 18, shared=3, private=0, n_domains=3, n_iter=12, tol=0, lam=0.5)
    t = out.fit.trace
    assert all(b <= a * (1 + 1e-9) for a, b in zip(t, t[1:])) and t[-1] < t[0]
    assert agreement(out.domains, spots) > 0.9
    length = out.loadings.groupBy("k").agg(F.sum(F.col("w") * F.col("w")).alias("s")).collect()
    assert [x["s"] for x in length] == pytest.approx([1.0] * 3)


def test_nmf_bad_arguments(stripes):
    spots, expr = stripes
    for bad in ({"k": 0}, {"k": 2, "lam": -1}, {"k": 2, "n_iter": 0}):
        with pytest.raises(ValueError):
            models.fit_nmf(expr, None, spots, 18, **bad)
    empty = models.fit_nmf(expr.limit(0), None, spots.limit(0), 0, 2)
    assert empty.iterations == 0 and empty.h.count() == 0


def test_projection_and_smoothing(stripes):
    spots, expr = stripes
    edges = graph.knn_directed(spots, 6)
    out = models.projection_model(expr, spots, edges, 18, shared=2, private=1, n_domains=3)
    assert out.domains.count() == 100 and out.loadings.where("w < 0").count() == 0
    labels, _ = models.spatial_smooth_domains(expr, edges, spots, 18, n_domains=3, components=3)
    assert agreement(labels, spots) > 0.8
    with pytest.raises(ValueError):
        models.projection_model(expr, spots, edges, 18, d=2)


def test_encode_matches_dense(stripes, spark):
    spots, expr = stripes
    edges = graph.knn_directed(spots, 4)
    x = np.zeros((100, 18))
    for r in expr.collect():
        x[r["spot_id"], r["gene_id"]] = r["value"]
    near = np.zeros_like(x)
    deg = np.zeros(100)
    for r in edges.collect():
        near[r["src"]] += x[r["dst"]]
        deg[r["src"]] += 1
    near /= np.maximum(deg, 1)[:, None]
    xy = np.array([(r["x"], r["y"]) for r in spots.orderBy("spot_id").collect()])
    f = np.c_[x - x.mean(0), near - x.mean(0), xy - xy.mean(0), np.zeros(100)]
    want = f @ np.random.default_rng(0).normal(0, f.shape[1] ** -0.5, (f.shape[1], 5))
    got = np.array([r["h"] for r in models.encode(expr, spots, edges, 18, 5, 0).orderBy("spot_id").collect()])
    assert np.allclose(got, want)


def test_nnls_and_pca(spark):
    r = np.random.default_rng(4)
    for _ in range(20):
        a, b = r.random((30, 4)), r.normal(size=30)
        x = linalg.nnls(a.T @ a, a.T @ b)[0]
        g = a.T @ (a @ x - b)
        assert (x >= 0).all() and (g > -1e-6).all() and abs(g @ x) < 1e-6
    h = r.random((50, 4))
    scores, v = linalg.pca(spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(h)], "id long, h array<double>"), 2)
    got = np.array([x["h"] for x in scores.orderBy("id").collect()])
    c = h - h.mean(0)
    s = np.linalg.svd(c)[1]
    assert np.allclose((got**2).sum(0), s[:2] ** 2) and (v[np.abs(v).argmax(0), range(2)] > 0).all()


def test_kmeans(spark):
    r = np.random.default_rng(5)
    h = np.concatenate([r.normal(c, 0.1, (20, 2)) for c in (0, 5, 10)])
    p = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(h)], "id long, h array<double>")
    got = {x["id"]: x["label"] for x in kmeans(p, 3).labels.collect()}
    assert [len({got[i] for i in range(20 * b, 20 * b + 20)}) for b in range(3)] == [1, 1, 1] and len(set(got.values())) == 3
    parts = p.select("id", F.floor(F.col("id") / 30).alias("component"))
    labels = {x["id"]: x["label"] for x in kmeans_over_components(p, parts, 4).collect()}
    assert not {labels[i] for i in range(30)} & {labels[i] for i in range(30, 60)}


def test_preprocessing(spark):
    e = spark.createDataFrame([(0, 0, 2.0), (0, 1, 6.0), (1, 0, 4.0)], "spot_id long, gene_id long, value double")
    n = {(r[0], r[1]): r[2] for r in prep.normalize_total(e, 8).collect()}
    assert n == {(0, 0): 2.0, (0, 1): 6.0, (1, 0): 8.0}
    assert prep.looks_raw(e).first()[0] and not prep.looks_raw(e.withColumn("value", F.col("value") / 3)).first()[0]
    v = {r[0]: r[2] for r in prep.gene_moments(e, spark.range(3).agg(F.count("*"))).collect()}
    assert v == pytest.approx({0: np.var([2, 4, 0]), 1: np.var([6, 0, 0])})
