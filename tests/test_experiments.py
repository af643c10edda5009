"""Planted data and the experiments over many fits, on small tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkfactors.checkpoints import cut
from sparkfactors.operators import contraction, graph, linalg, models
from sparkfactors.plans import experiments, gates, ledger, measure, runner
from sparkfactors.sources import readers, synthetic

SMALL = experiments.Config(n_spots_per_section=30, n_genes=16, n_iter=2)


@pytest.fixture(scope="module")
def data(spark):
    return experiments.planted(spark, SMALL, 0)


def test_planted_shapes(spark, data):
    assert data.spots.count() == 60 and data.loadings.count() == 16 * 4 and data.scores.count() == 60 * 4
    private = data.scores.where("k = 3").join(data.spots, "spot_id").groupBy("section_id").agg(F.sum("v").alias("s"))
    assert {r["section_id"]: r["s"] > 0 for r in private.collect()} == {0: True, 1: False}
    assert data.expr.where("value <= 0").count() == 0
    sizes = data.domains.join(data.spots, "spot_id").groupBy("section_id", "domain_id").count().collect()
    assert len(sizes) == 8 and {r["count"] for r in sizes} == {7, 8}
    again = synthetic.generate(spark, 2, 30, 16, 3, 1, 0.5, 4, 6, 0)
    assert again.expr.exceptAll(data.expr).count() == 0 and synthetic.generate(spark, 1, 0, 0).expr.count() == 0
    assert data.edges.groupBy("src").count().where("count <> 6").count() == 0


def test_runs_together_are_runs_alone(data):
    both = models.fit_nmf_runs(data.expr, data.edges, data.spots, 16, 4, [(3, 0.2, 1), (5, 1.0, 2)], n_iter=2, tol=0)
    for r, lam, seed in ((3, 0.2, 1), (5, 1.0, 2)):
        one = models.fit_nmf(data.expr, data.edges, data.spots, 16, 4, lam=lam, seed=seed, n_iter=2, tol=0)
        assert one.trace == pytest.approx(both[r].trace) and one.iterations == both[r].iterations == 2
        h = [np.array([x["h"] for x in f.h.orderBy("spot_id").collect()]) for f in (one, both[r])]
        assert np.allclose(*h)
    early = models.fit_nmf_runs(data.expr, data.edges, data.spots, 16, 4, [(0, 0.2, 1), (1, 0.2, 1)], n_iter=4, tol=0.9)
    assert early[0].iterations < 4 and len(early[0].trace) == early[0].iterations + 1


def test_fit_matches_numpy(data):
    x = np.zeros((60, 16))
    for r in data.expr.collect():
        x[r["spot_id"], r["gene_id"]] = r["value"]
    a = np.zeros((60, 60))
    for r in data.edges.collect():
        a[r["src"], r["dst"]] += 1
        a[r["dst"], r["src"]] += 1
    d = a.sum(1)[:, None]
    start = models.fit_nmf_runs(data.expr, data.edges, data.spots, 16, 4, [(0, 0.3, 7)], n_iter=1, tol=0)[0]
    table = data.spots.sparkSession.createDataFrame([(0, 7, float(max(x.sum() / x.size, 1e-12) ** 0.5 / 2))], "run long, seed long, scale double")
    rows = lambda df, key, tag: np.array([r["h"] for r in models.start_rows(df.crossJoin(table), key, 4, tag).orderBy(key).collect()])
    h, w = rows(data.spots.select("spot_id"), "spot_id", "H"), rows(data.loadings.select("gene_id").distinct(), "gene_id", "W")
    lam = 0.3 * np.sqrt((x**2).mean())
    h = h * (x @ w + lam * (a @ h)) / (h @ (w.T @ w) + lam * d * h + 1e-12)
    w = w * (x.T @ h) / (w @ (h.T @ h) + 1e-12)
    assert np.allclose(h, [r["h"] for r in start.h.orderBy("spot_id").collect()])
    assert np.allclose(w, [r["w"] for r in start.w.orderBy("gene_id").collect()])
    want = ((x - h @ w.T) ** 2).sum() + lam * (d[:, 0] @ (h * h).sum(1) - (h * (a @ h)).sum())
    assert start.trace[-1] == pytest.approx(want)


def test_stability_and_k(spark):
    got = experiments.seed_stability(spark, SMALL, (0, 1)).collect()
    assert len(got) == 1 and 0 <= got[0]["factor_corr"] <= 1 and -1 <= got[0]["domain_ari"] <= 1
    ks = experiments.robustness_to_k(spark, SMALL, (2,), (0, 1)).collect()
    assert [r["k"] for r in ks] == [2] and sum(r["best"] for r in ks) == 1
    for bad in (lambda: experiments.seed_stability(spark, SMALL, (0,)), lambda: experiments.robustness_to_k(spark, SMALL, (2,), (0,))):
        with pytest.raises(ValueError):
            bad()


def test_recovery_falls_with_noise(spark):
    got = experiments.recovery_vs_batch(spark, experiments.Config(n_spots_per_section=30, n_genes=16, n_iter=5), (0.1, 200.0)).orderBy("pos")
    rows = got.collect()
    assert rows[0]["factor_corr"] > rows[1]["factor_corr"]
    assert experiments.finite_drop(got, "factor_corr", "pos").first()[0] == pytest.approx(rows[0]["factor_corr"] - rows[1]["factor_corr"])
    assert experiments.finite_drop(got.limit(1), "factor_corr", "pos").first()[0] is None


def test_transfer_and_consensus(data):
    truth = data.domains.withColumnRenamed("domain_id", "label")
    got = experiments.loso_transfer(data.expr, data.edges, data.spots, truth, 16, n_domains=3, n_iter=1).collect()
    assert sorted(r["section_id"] for r in got) == [0, 1] and all(0 <= r["nmi"] <= 1 for r in got)
    with pytest.raises(ValueError):
        experiments.loso_transfer(data.expr, data.edges, data.spots.where("section_id = 0"), truth, 16)
    reference, survival = experiments.perturbation_consensus(data.expr, data.edges, data.spots, 16, 3, n_perturb=1, n_iter=1)
    assert reference.count() == 60 and all(r["survival"] is None or 0 <= r["survival"] <= 1 for r in survival.collect())
    with pytest.raises(ValueError):
        experiments.perturbation_consensus(data.expr, data.edges, data.spots, 16, 3, n_perturb=0)


def test_sweeps(spark, data):
    got = experiments.oversmoothing(data.expr, data.edges, data.spots, 16, [0.0, 20.0], n_iter=3).orderBy("pos").collect()
    assert got[0]["coherence"] < got[1]["coherence"] and got[0]["signal"] > got[1]["signal"]
    truth = data.domains.withColumnRenamed("domain_id", "label")
    lams = experiments.lam_sweep(data.expr, data.edges, data.spots, truth, 16, [0.1], [0], k=3, n_domains=3, n_iter=1, tol=0).first()
    assert lams["iterations"] == 1 and 0 <= lams["smooth_fraction"] <= 1 and lams["edge_purity"] <= 1
    grid = experiments.grid_sweep(spark, SMALL, [0.1, 1.0], [1], [1e-9], [0])
    assert experiments.grid_summary(grid).count() == 2 and all(r["last"] < r["first"] and not r["converged"] for r in grid.collect())


def test_ambiguity_planes_and_contrast(data, spark):
    truth = data.domains.select("spot_id", F.when(F.col("spot_id") == 0, "NA").otherwise(F.col("domain_id").cast("string")).alias("gt"))
    assert -1 <= experiments.reference_ambiguity(data.expr, truth, 16, 5).first()[0] <= 1
    assert experiments.reference_ambiguity(data.expr, truth.limit(0), 16).first()[0] is None
    flat = spark.createDataFrame([(i, [float(i)]) for i in range(4)], "id long, h array<double>")
    assert all(r["h"][1] == 0 for r in experiments.pca_plane(flat).collect())
    both = experiments.integration_embedding(flat, flat, data.spots)
    assert both.groupBy("stage").count().collect() == [("after", 4), ("before", 4)] or both.count() == 8
    c = experiments.nmf_contrast(data.expr, data.spots, data.scores.where("k < 2"), 16, n_iter=2, genes=8).first()
    assert c["gap"] == pytest.approx(1 - c["correlation"])


def test_ambiguity_of_all_pairs_with_rows_gathered_once(spark):
    """More spots than one block of the silhouette holds, against plain numpy; the values are shuffled once."""
    r = np.random.default_rng(4)
    n, genes, components = 1100, 150, 3
    x, label = r.random((n, genes)) * np.r_[5.0, 4.0, 3.0, np.ones(genes - 3)], r.integers(0, 3, n)
    expr = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "spot_id long, h array<double>")
    expr = cut(expr.select("spot_id", F.posexplode("h").alias("g", "value")).select("spot_id", F.col("g").cast("long").alias("gene_id"), "value"))
    truth = spark.createDataFrame([(i, str(k)) for i, k in enumerate(label)], "spot_id long, gt string")
    with measure.measured(spark) as once:
        models.dense_rows(expr.withColumnRenamed("value", "v"), truth, genes).write.format("noop").mode("overwrite").save()
    with measure.measured(spark) as u:
        got = experiments.reference_ambiguity(expr, truth, genes, components).first()[0]
    c = x - x.mean(0)
    h = c @ np.linalg.svd(c.T @ c)[0][:, :components]
    d, same = np.sqrt(((h[:, None] - h[None]) ** 2).sum(-1)), np.eye(3)[label]
    mean = d @ same / (same.sum(0) - same)
    a, b = mean[same > 0], np.where(same > 0, np.inf, mean).min(1)
    assert got == pytest.approx(-np.mean((b - a) / np.maximum(a, b)))
    assert u.shuffle_write_mb + u.spill_mb < 2 * once.shuffle_write_mb


def test_components_of_a_long_path(spark):
    """A path needs few rounds, whatever its length."""
    edges = spark.range(3000).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    got = contraction.components(edges.unionByName(spark.createDataFrame([(9001, 9000), (9001, 9001)], "a long, b long")))
    assert sorted(map(tuple, got.groupBy("root").count().collect())) == [(0, 3001), (9000, 2)]
    lone = graph.components(edges.toDF("src", "dst").where("src < 2"), spark.range(5).withColumnRenamed("id", "spot_id"))
    assert [r["component"] for r in lone.orderBy("spot_id").collect()] == [0, 0, 0, 3, 4]
    assert contraction.components(edges.limit(0)).count() == 0


def test_truth_keys(spark):
    for keys in (readers.RUNNER_KEYS, readers.LOADER_KEYS):
        for i, k in enumerate(keys):
            df = spark.createDataFrame([("a",)], f"`{k}` string")
            assert readers.truth_column(df, keys) == k
            assert readers.truth_column(df.withColumn(keys[0], F.lit("b")), keys) == keys[0]
    assert readers.truth_column(spark.range(1).withColumnRenamed("id", "Cluster"), readers.RUNNER_KEYS) is None


def test_rank_and_preprocess(spark, data):
    h = cut(data.spots.select("spot_id", F.array(F.col("x"), F.col("y"), F.col("x") + F.col("y")).alias("h")))
    assert runner.factor_rank(h, 3) == 2
    out, done = runner.preprocess(data.expr, data.spots, 16, n_hvg=5)
    assert done.first()["hvg_applied"] and not done.first()["applied"] and out.select("gene_id").distinct().count() == 5


def test_nnls_without_length():
    g = np.array([[2.0, 0.0], [0.0, 0.0]])
    assert linalg.nnls(g, np.array([[4.0, 1.0], [-4.0, 0.0]])).tolist() == [[2.0, 0.0], [0.0, 0.0]]


def test_ledger_cells_are_trimmed(spark):
    lines = spark.createDataFrame([(1, "| Claim | a | b | c | Status |"), (2, "|--|--|--|--|--|"), (3, "|  Factors hold | x | PR #1 | None |  Planned |")], "line_no int, value string")
    row = ledger.parse_ledger(lines).first()
    assert row["claim"] == "Factors hold" and row["status"] == "Planned"


def test_holdout_is_whole(spark):
    train, test, n = gates.holdout(spark.range(10).withColumnRenamed("id", "spot_id"), 0.3, 1)
    assert n == 3 == test.count() and train.count() == 7 and train.join(test, "spot_id").count() == 0
