"""Metrics and graphs against plain definitions, and their degenerate cases."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkfactors.functions import concordance, factors, spatial
from sparkfactors.operators import graph
from sparkfactors.plans import gates, ledger, reports
from sparkfactors.plans.measure import measured
from sparkfactors.sources import readers, sinks


def pairs(spark, t, p):
    return spark.createDataFrame(list(zip(t, p, strict=True)), "t long, p long")


def value(df):
    return df.first()[0]


@pytest.mark.parametrize("seed", range(3))
def test_ari_counts_pairs(spark, seed):
    r = random.Random(seed)
    t, p = [r.randrange(4) for _ in range(40)], [r.randrange(5) for _ in range(40)]
    a = b = c2 = n = 0
    for i in range(40):
        for j in range(i):
            same_t, same_p = t[i] == t[j], p[i] == p[j]
            a, b, c2, n = a + same_t, b + same_p, c2 + (same_t and same_p), n + 1
    want = (c2 - a * b / n) / ((a + b) / 2 - a * b / n)
    assert value(concordance.ari(pairs(spark, t, p))) == pytest.approx(want, abs=1e-9)


def test_degenerate_agreement(spark):
    one = pairs(spark, [1], [2])
    assert value(concordance.ari(one)) is None and value(concordance.nmi(one)) is None and value(concordance.ami(one)) is None
    flat = pairs(spark, [1, 1, 1], [2, 2, 2])
    assert value(concordance.ari(flat)) is None and value(concordance.nmi(flat)) == value(concordance.ami(flat)) == 1.0
    same = pairs(spark, [1, 1, 2, 2], [5, 5, 3, 3])
    assert value(concordance.ari(same)) == value(concordance.nmi(same)) == pytest.approx(1.0)
    assert value(concordance.weighted_dice(same)) == 1.0
    assert value(concordance.weighted_dice(pairs(spark, [], []))) is None


def test_lgamma(spark):
    xs = [0.5, 1.0, 2.0, 7.0, 50.0, 1e5]
    got = spark.createDataFrame([(x,) for x in xs], "x double").select(concordance.lgamma(F.col("x"))).collect()
    assert [g[0] for g in got] == pytest.approx([math.lgamma(x) for x in xs], rel=1e-11, abs=1e-11)


def test_missing_labels(spark):
    df = spark.createDataFrame([(x,) for x in ("L1", " NA ", "nan", None, "", "Unlabelled", "0")], "gt string")
    assert [r[0] for r in df.where(concordance.has_label(F.col("gt"))).collect()] == ["L1", "0"]


def spots_of(spark, xy, section=None):
    rows = [(i, int(section[i]) if section is not None else 0, float(x), float(y)) for i, (x, y) in enumerate(xy)]
    return spark.createDataFrame(rows, "spot_id long, section_id long, x double, y double")


@pytest.mark.parametrize("kind", ["even", "clustered", "repeated", "line"])
def test_knn_is_exact(spark, kind):
    r = np.random.default_rng(1)
    xy = {"even": r.random((120, 2)), "clustered": np.concatenate([r.normal(0, 0.01, (90, 2)), r.normal(50, 9, (30, 2))]), "repeated": r.integers(0, 3, (60, 2)), "line": np.c_[np.arange(50), np.zeros(50)]}[kind]
    got = graph.knn(spots_of(spark, xy), 4).collect()
    for i in range(len(xy)):
        d = [(float(((xy[i] - xy[j]) ** 2).sum()), j) for j in range(len(xy)) if j != i]
        mine = sorted((x["rank"], x["dst"]) for x in got if x["src"] == i)
        assert [j for _, j in mine] == [j for _, j in sorted(d)[:4]]


def test_knn_over_many_cells(spark):
    """Clusters of very different density, lattice ties, repeated points and one far spot, in cells of few spots."""
    r = np.random.default_rng(9)
    xy = np.concatenate([r.normal(0, 1e-4, (150, 2)), r.normal(5, 1, (60, 2)), np.stack(np.meshgrid(range(8), range(8)), -1).reshape(-1, 2) * 1.0, np.full((12, 2), 3.0), [[1e6, -1e6]]])
    got = {}
    for x in graph.knn(spots_of(spark, xy), 3, per_cell=12).collect():
        got.setdefault(x["src"], []).append((x["rank"], x["dst"]))
    d = ((xy[:, None] - xy[None]) ** 2).sum(-1)
    for i in range(len(xy)):
        want = sorted((d[i, j], j) for j in range(len(xy)) if j != i)[:3]
        assert [j for _, j in sorted(got[i])] == [j for _, j in want], i


def test_knn_small(spark):
    two = spots_of(spark, [(0, 0), (1, 1), (5, 5)], [0, 0, 1])
    assert sorted(map(tuple, graph.knn_directed(two, 6).collect())) == [(0, 1), (1, 0)]
    assert graph.knn_directed(two, 0).count() == 0 and graph.knn(two.limit(0), 3).count() == 0
    with pytest.raises(ValueError):
        graph.knn(two, -1)


def test_components_and_smoothing(spark):
    s = spots_of(spark, [(i, 0) for i in range(40)])
    chain = spark.createDataFrame([(i, i + 1) for i in range(29)] + [(35, 34)], "src long, dst long")
    c = {x["spot_id"]: x["component"] for x in graph.components(chain, s).collect()}
    assert all(c[i] == 0 for i in range(30)) and c[35] == 34 and c[39] == 39
    v = spark.createDataFrame([(i, 0, 1.0) for i in range(40)], "spot_id long, k int, v double")
    out = {x["spot_id"]: x["v"] for x in graph.smooth(chain, v, "k", 0.5, 2).collect()}
    assert out[5] == pytest.approx(1.0) and out[39] == pytest.approx(0.25)


def test_morans_closed_forms(spark):
    r = np.random.default_rng(2)
    n, labels = 30, r.integers(0, 3, 30)
    edges = [(int(a), int(b)) for a, b in r.integers(0, n, (80, 2))]
    e = spark.createDataFrame(edges, "src long, dst long")

    def moran(v):
        c = v - v.mean()
        return n / len(edges) * sum(c[a] * c[b] for a, b in edges) / (c**2).sum()

    lab = spark.createDataFrame([(i, int(x)) for i, x in enumerate(labels)], "spot_id long, label long")
    assert value(spatial.coherence(lab, e)) == pytest.approx(np.mean([moran((labels == k) * 1.0) for k in range(3)]))
    x = np.where(r.random(n) < 0.5, 0, r.random(n))
    expr = spark.createDataFrame([(i, 0, float(a)) for i, a in enumerate(x) if a], "spot_id long, gene_id long, value double")
    got = spatial.sparse_morans(expr, e, lab.agg(F.count("*"))).first()["i"]
    assert got == pytest.approx(moran(x))


def test_silhouette_and_ch(spark):
    r = np.random.default_rng(3)
    h, lab = r.random((40, 3)), r.integers(0, 3, 40)
    p = spark.createDataFrame([(i, str(a), x.tolist()) for i, (a, x) in enumerate(zip(lab, h, strict=True))], "id long, label string, h array<double>")
    d = np.sqrt(((h[:, None] - h[None]) ** 2).sum(-1))
    s = []
    for i in range(40):
        a = d[i][(lab == lab[i]) & (np.arange(40) != i)].mean()
        b = min(d[i][lab == k].mean() for k in set(lab) - {lab[i]})
        s.append((b - a) / max(a, b))
    assert value(spatial.silhouette(p, block=7)) == pytest.approx(np.mean(s))
    m = h.mean(0)
    between = sum((lab == k).sum() * ((h[lab == k].mean(0) - m) ** 2).sum() for k in range(3))
    within = sum(((h[lab == k] - h[lab == k].mean(0)) ** 2).sum() for k in range(3))
    assert value(spatial.calinski_harabasz(p)) == pytest.approx(between / 2 * 37 / within)
    assert value(spatial.silhouette(p.where("label = '0'"))) is None and value(spatial.calinski_harabasz(p.where("label = '0'"))) is None


def test_silhouette_shuffles_as_the_points_grow(spark):
    r = np.random.default_rng(6)

    def cost(n):
        p = spark.createDataFrame([(i, str(i % 3), x.tolist()) for i, x in enumerate(r.random((n, 8)))], "id long, label string, h array<double>")
        with measured(spark) as u:
            spatial.silhouette(p, block=50).collect()
        return u.shuffle_write_mb + u.spill_mb

    assert cost(4800) < 6 * cost(1200)


def test_silhouette_shuffles_in_proportion_from_ten_blocks_on(spark):
    r = np.random.default_rng(9)

    def cost(n):
        p = spark.createDataFrame([(i, str(i % 8), x.tolist()) for i, x in enumerate(r.random((n, 8)))], "id long, label string, h array<double>")
        with measured(spark) as u:
            spatial.silhouette(p, block=100).collect()
        return u.shuffle_write_mb + u.spill_mb

    assert cost(4000) < 4.2 * cost(1000)


def test_silhouette_is_the_same_over_any_blocks_and_partitions(spark):
    r = np.random.default_rng(8)
    p = spark.createDataFrame([(i, str(i % 3), x.tolist()) for i, x in enumerate(r.random((1300, 3)))], "id long, label string, h array<double>")
    whole = value(spatial.silhouette(p, block=5000))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert value(spatial.silhouette(p, block=100)) == pytest.approx(whole) and value(spatial.silhouette(p)) == pytest.approx(whole)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_silhouettes_of_several_labelings(spark):
    r = np.random.default_rng(7)
    n = 60
    h, one, two = r.random((n, 4)), [str(x) for x in r.integers(0, 4, n)], [str(x) for x in r.integers(0, 3, n)]
    h[10:14] = h[9]
    one[0], two[1], two[2] = "alone", None, None
    rows = [(i, a, b, "all", str(i), x.tolist()) for i, (a, b, x) in enumerate(zip(one, two, h, strict=True))]
    p = spark.createDataFrame(rows, "id long, one string, two string, same string, each string, h array<double>")
    d = np.sqrt(((h[:, None] - h[None]) ** 2).sum(-1))

    def plain(labels):
        labels = np.array(labels, dtype=object)
        has, s = np.array([x is not None for x in labels]), []
        for i in np.flatnonzero(has):
            mine = d[i][(labels == labels[i]) & (np.arange(n) != i)]
            a, b = mine.mean() if len(mine) else 0.0, min(d[i][labels == k].mean() for k in set(labels[has]) - {labels[i]})
            s.append((b - a) / max(a, b))
        return np.mean(s)

    for block in (7, 1024):
        got = spatial.silhouettes(p, ("one", "two", "same", "each"), block).first()
        assert got["one"] == pytest.approx(plain(one)) and got["two"] == pytest.approx(plain(two)) and got["same"] is None and got["each"] is None


def test_coassociation_shuffles_no_pairs(spark):
    r = np.random.default_rng(5)
    n, n_runs = 600, 3
    labels = r.integers(0, 3, (n, n_runs))
    rows = [(s, i, int(labels[i, s])) for i in range(n) for s in range(n_runs)] + [(0, None, 1), (1, n, None), (None, n, 0)]
    runs = spark.createDataFrame(rows, "run long, spot_id long, label long")
    with measured(spark) as u:
        got = {(x["i"], x["j"]): x["share"] for x in reports.coassociation(runs, n_runs, block=50).collect()}
    share = (labels[:, None] == labels[None]).mean(-1)
    want = {(i, j): share[i, j] for i in range(n) for j in range(i + 1, n) if share[i, j]}
    assert got.keys() == want.keys() and all(abs(got[k] - v) < 1e-12 for k, v in want.items())
    # 16 bytes of ids for each of over 100,000 pairs would be more, copies of spots' packs are not.
    assert u.shuffle_write_mb < 1
    # A spot that a run tells twice counts twice, as in a join of the rows.
    twice = spark.createDataFrame([(0, 1, 7), (0, 1, 7), (0, 2, 7), (0, 3, 8)], "run long, spot_id long, label long")
    assert [tuple(x) for x in reports.coassociation(twice, 3, digits=6).collect()] == [(1, 2, 0.666667)]


def test_matching():
    m = [(0, 0, 0.9), (0, 1, 0.8), (1, 0, 0.85), (1, 1, 0.1)]
    assert factors.matched_correlation(m) == pytest.approx((0.8 + 0.85) / 2)
    assert factors.matched_correlation([]) is None


def test_gates(spark):
    s = spark.createDataFrame([(i, "A" if i < 20 else "B") for i in range(40)], "spot_id long, label string")
    e = spark.createDataFrame([(i, i + 1) for i in range(39) if i != 19], "src long, dst long")
    cal = gates.permutation_null(s, e, shuffles=40)
    c = cal.first()
    assert c["z"] > 3 and c["p"] == pytest.approx(1 / 41)
    assert gates.claim_gate(cal, 0.2).first()["passed"] and not gates.claim_gate(cal, 0.9).first()["passed"]
    assert not gates.claim_gate(cal, None, checked=False).first()["passed"]
    with pytest.raises(ValueError):
        gates.permutation_null(s, e, "other")
    truth = gates.ground_truth(spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "spot_id long, gt string"))
    assert gates.eval_policy(truth).first()["emitted"] and not gates.eval_policy(truth, "B").first()["emitted"]
    errors = lambda *v: spark.createDataFrame([(i, i + 2, float(x)) for i, x in enumerate(v)], "pos int, k int, error double")
    assert [value(gates.knee(errors(*v))) for v in ((1, 0.5, 0.49, 0.1), (1, 1.1), (1, 0.5, 0.2), (0, 0))] == [3, 2, 4, 2]


def test_ledger(spark):
    text = ["intro", "| Claim | Required | Current | Missing | Status |", "|---|---|---|---|---|", "| Factors recover tissue domains | x | PR #12 | none | done |", "| Spatial factors outperform baselines | x | soon | all | planned |", "| Other | x | words | lots | done |"]
    lines = spark.createDataFrame(list(enumerate(text, 1)), "line_no int, value string")
    rows = ledger.parse_ledger(lines)
    assert rows.count() == 3
    assert sorted((r["line_no"], r["violation"]) for r in ledger.check_ledger(rows).collect()) == [(6, "evidence missing"), (6, "no evidence")]
    texts = spark.createDataFrame([("m", "# Title\nSpatial factors outperform all baselines. Spatial factors may outperform baselines. Do spatial factors outperform baselines?")], "name string, text string")
    assert ledger.check_texts(rows, texts).count() == 1
    assert not ledger.gate(rows, texts).first()["passed"]


def test_regression_and_ranks(spark):
    p = spark.createDataFrame([(1.0, 2.0), (2.0, 4.0), (3.0, 6.5), (float("nan"), 1.0)], "x double, y double")
    assert tuple(reports.regression(p).first()) == pytest.approx((np.corrcoef([1, 2, 3], [2, 4, 6.5])[0, 1], *np.polyfit([1, 2, 3], [2, 4, 6.5], 1)))
    assert tuple(reports.regression(p.limit(1)).first()) == (None, None, None)


def test_readers_and_sinks(spark, tmp_path):
    s = spots_of(spark, [(0, 0), (1, 1)])
    x = spark.createDataFrame([(0, 0, 1.0)], "spot_id long, gene_id long, value double")
    e = spark.createDataFrame([(0, 1), (0, 1), (1, 1)], "src long, dst long")
    readers.validate_inputs(s, x, e)
    with pytest.raises(readers.SchemaError, match="repeated_edges: 1"):
        readers.validate_inputs(s, x, e, strict=True)
    m = spark.createDataFrame([("a", 1.5), ("b", float("nan"))], "name string, value double")
    for seed in (0, 1):
        sinks.write_results(str(tmp_path), f"gnmf_seed{seed}", "card", m, {"spots": s}, {"seed": seed})
    got = readers.read_runs(spark, str(tmp_path))
    assert sorted(map(tuple, got.where("name = 'a'").collect())) == [("gnmf", 0, "a", 1.5), ("gnmf", 1, "a", 1.5)]
    assert got.where("name = 'b' AND value IS NULL").count() == 2
    sinks.write_table(m, str(tmp_path), "t", "note")
    assert "| b | n/a |" in (tmp_path / "t.md").read_text() and "a,1.500000" in (tmp_path / "t.csv").read_text()
    with pytest.raises(TypeError):
        sinks.coerce(True)
    with pytest.raises(KeyError):
        readers.truth_column(s, explicit="absent")
