"""Reports over many labelings and factors, lookups and stacked sections."""

import itertools
import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkfactors.functions import concordance
from sparkfactors.plans import factor_reports
from sparkfactors.sources import stacking


def test_one_pass_gives_what_the_single_metrics_give(spark):
    r = random.Random(6)
    rows = [(f"d{d}", v, r.randint(0, 3), r.randint(0, v)) for d in range(3) for v in (1, 4) for _ in range(r.randint(30, 60))]
    rows += [("d9", 0, 1, 2), ("one", 1, 5, 5), ("one", 1, 5, 5), ("same", 1, 1, 7), ("same", 1, 2, 8), ("same", 1, 1, 7)]
    pairs = spark.createDataFrame(rows, "dataset string, variant int, t int, p int")
    by = ("dataset", "variant")
    one = {tuple(r)[:2]: tuple(r)[3:] for r in concordance.accuracy_sets(pairs, by).collect()}
    want = {tuple(r)[:2]: tuple(r)[2:] for r in concordance.accuracy(pairs, by).collect()}
    assert one.keys() == want.keys()
    for k in want:
        assert [x is None for x in one[k]] == [x is None for x in want[k]], k
        assert np.allclose([x or 0 for x in one[k]], [x or 0 for x in want[k]], atol=1e-10), k


def test_domain_accuracy_leaves_out_missing_truth_and_keeps_every_variant(spark):
    rows = [("b", "x", "1", 1), ("b", "x", "1", 1), ("b", "x", "2", 2), ("b", "x", "NA", 1), ("a", "y", None, 1), ("a", "y", "unknown", 2)]
    got = [tuple(r) for r in factor_reports.domain_accuracy(spark.createDataFrame(rows, "dataset string, variant string, t string, p int")).collect()]
    assert got == [("a", "y", None, None, None), ("b", "x", 1.0, 1.0, 1.0)]


def test_records_baselines_metrics_and_summaries(spark, tmp_path):
    data = {"z": {"coords": {"ari": 0.2, "nmi": True}, "gnmf": {"ari": 0.9}}, "m": {"spatial_smooth": {"ari": 0.5}, "coords": {"ari": None}, "other": {"ari": 1}}}
    (tmp_path / "a.json").write_text(json.dumps(data))
    (tmp_path / "none.json").write_text("{}")
    records = factor_reports.accuracy_records(spark, f"{tmp_path}/a.json")
    assert [tuple(r) for r in records.collect()] == [("m", "coords", None, None, None), ("m", "other", 1.0, None, None), ("m", "spatial_smooth", 0.5, None, None), ("z", "coords", 0.2, None, None), ("z", "gnmf", 0.9, None, None)]
    assert factor_reports.accuracy_records(spark, f"{tmp_path}/none.json").count() == 0
    look = lambda d: [tuple(r) for r in factor_reports.baseline_scores(records, d).collect()]
    assert look("z") == [("coords", 0.2)] and look("m") == look("absent") == [("spatial_smooth", 0.5)]
    metrics = spark.createDataFrame([("g", 1, "ari_domain", "0.5"), ("g", 1, "nmi_domain", "true"), ("g", 1, "else", "3"), ("h", 2, "ari_domain", "NaN")], "method string, seed int, name string, value string")
    got = {r["method"]: (r["ari_domain"], r["nmi_domain"], r["silhouette_domain"]) for r in factor_reports.domain_metrics(metrics).collect()}
    assert got == {"g": (0.5, None, None), "h": (None, None, None)}
    summary = spark.createDataFrame([("a", "v", 0.1, None, 0.3, 0.9), ("a", "u", float("inf"), 0.2, 0.3, None)], "dataset string, variant string, ari double, nmi double, ami double, stability double")
    points, nested = factor_reports.summaries_to_scores(summary)
    assert [tuple(r) for r in points.collect()] == [("a", "v", 0.1, 0.9)]
    deep = nested.where("dataset = 'a'").first()["accuracy"]
    assert list(deep) == ["u", "v"] and tuple(deep["u"]) == (None, 0.2, 0.3)


def interpretability(h, w, edges, top_n):
    n, k = h.shape
    c = h - h.mean(axis=0)
    corr = np.abs(np.corrcoef(h.T)) if k > 1 else np.zeros((1, 1))
    np.fill_diagonal(corr, -1)
    for j in range(k):
        i = n / len(edges) * sum(c[a, j] * c[b, j] for a, b in edges) / (c[:, j] ** 2).sum()
        top = np.lexsort((np.arange(len(w)), -np.abs(w[:, j])))[:top_n]
        yield i, np.abs(w[top, j]).sum() / np.abs(w[:, j]).sum(), corr[j].max(), top.tolist()


def test_interpretability_and_its_null(spark):
    r = np.random.default_rng(2)
    h, w = r.normal(size=(6, 3)) ** 2, r.exponential(size=(9, 3))
    edges = [(0, 1), (1, 0), (1, 2), (2, 3), (3, 4), (4, 5), (5, 0), (2, 5), (2, 5)]
    scores = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(h)], "spot_id long, h array<double>")
    loads = spark.createDataFrame([(g, k, float(w[g, k])) for g in range(9) for k in range(3)], "gene_id long, k long, w double")
    ed = spark.createDataFrame(edges, "src long, dst long")
    got = {x["factor"]: x for x in factor_reports.factor_interpretability(scores, loads, ed, 3, 4).collect()}
    for k, want in enumerate(interpretability(h, w, edges, 4)):
        g = got[k]
        assert np.allclose([g["coherence"], g["enrichment"], g["max_redundancy"]], want[:3]) and g["top_genes"] == want[3]
        c = h[:, k] - h[:, k].mean()
        null = [6 / len(edges) * sum(c[p[a]] * c[p[b]] for a, b in edges) / (c**2).sum() for p in itertools.permutations(range(6))]
        assert np.allclose([g["null_mean"], g["null_std"]], [np.mean(null), np.std(null)])
        assert np.isclose(g["z"], (g["coherence"] - np.mean(null)) / np.std(null))
    table = factor_reports.factor_coherence(scores, loads, ed, 3, 4).collect()
    assert [x["factor"] for x in table] == [0, 1, 2] and table[1]["spatial_coherence"] == got[1]["coherence"]


def test_factors_that_say_nothing(spark):
    scores = spark.createDataFrame([(i, [1.0]) for i in range(5)], "spot_id long, h array<double>")
    loads = spark.createDataFrame([(0, 0, 0.0), (1, 0, 0.0)], "gene_id long, k long, w double")
    edges = spark.createDataFrame([(0, 1), (1, 2)], "src long, dst long")
    one = factor_reports.factor_interpretability(scores, loads, edges, 1).first()
    assert (one["coherence"], one["z"], one["enrichment"], one["max_redundancy"]) == (0.0, None, None, None)
    assert factor_reports.factor_coherence(scores, loads, edges.limit(0), 1).first()["spatial_coherence"] is None
    with pytest.raises(ValueError):
        factor_reports.factor_interpretability(scores, loads, edges, 0)


def test_stacked_sections(spark):
    spots = spark.createDataFrame([(s, i * 3, float(i), 0.0, "t") for s in ("b", "a") for i in range(4 if s == "a" else 3)], "section string, local_id long, x double, y double, tissue string")
    expr = spark.createDataFrame([(s, 3, g, 1.0) for s in "ab" for g in (0, 1)], "section string, local_id long, gene_id long, value double")
    raw = spark.createDataFrame([("b", 0, 5, 7.0)], "section string, local_id long, gene_id long, value double")
    out = stacking.stack_tables(spots, expr, raw, n_neighs=4, pitch=1.0)
    assert sorted(tuple(r)[:4] for r in out.spots.collect()) == [(0, 0, "a", 0), (1, 0, "a", 3), (2, 0, "a", 6), (3, 0, "a", 9), (4, 1, "b", 0), (5, 1, "b", 3), (6, 1, "b", 6)]
    assert out.spots.columns[-1] == "tissue"
    assert sorted(map(tuple, out.expr.collect())) == [(1, 0, 1.0), (1, 1, 1.0), (4, 5, 7.0)]
    assert {tuple(r) for r in out.edges.collect()} == {(a, b) for a in range(7) for b in range(7) if abs(a - b) == 1 and {a, b} != {3, 4}}
    assert sorted(map(tuple, out.sections.collect())) == [(0, "a", 4, False), (1, "b", 3, True)]
    assert stacking.stack_tables(spots, expr, raw, n_neighs=4, pitch=1.0, use_raw=False).expr.count() == 4
    with pytest.raises(ValueError, match="aren't there"):
        stacking.stack_tables(spots, expr.withColumn("local_id", F.lit(99)), n_neighs=4, pitch=1.0)
    with pytest.raises(ValueError, match="repeat"):
        stacking.stack_tables(spots.union(spots), expr, n_neighs=4, pitch=1.0)
