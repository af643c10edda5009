"""Experiments that fit the factor model more than once. Fits that share a table advance in the same jobs; what comes
back to the driver is a row per fit or pair of fits."""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..checkpoints import cut
from ..functions import concordance, factors, spatial
from ..operators import graph, linalg, models, prep
from ..operators.kmeans import kmeans
from ..sources import synthetic
from . import reports


@dataclass(frozen=True)
class Config:
    """A planted instance and a fit of it; defaults are fixed values of the surveyed harness."""

    n_sections: int = 2
    n_spots_per_section: int = 80
    n_genes: int = 50
    k_shared: int = 3
    k_private: int = 1
    n_domains: int = 4
    neighbours: int = 6
    noise: float = 0.5
    lam: float = 0.186
    n_iter: int = 80
    tol: float = 1e-4

    @property
    def k(self) -> int:
        return self.k_shared + self.k_private


def planted(spark: SparkSession, config: Config, seed: int, noise: float | None = None) -> synthetic.Instance:
    """The config's instance, written once."""
    one = synthetic.generate(
        spark, config.n_sections, config.n_spots_per_section, config.n_genes, config.k_shared, config.k_private,
        config.noise if noise is None else noise, config.n_domains, config.neighbours, seed,
    )
    return synthetic.Instance(*map(cut, one))


def domains_of(h: DataFrame, n_domains: int, seed: int, **settings) -> DataFrame:
    """spot_id, label: clusters of the standardised scores (spot_id, h)."""
    found = kmeans(models.standard_points(h), n_domains, seed=seed, **settings).labels
    return found.select(F.col("id").alias("spot_id"), F.col("label").cast("long").alias("label"))


def labels_of_runs(fits: dict[int, models.Factorisation], n_domains: int, seeds: dict[int, int]) -> DataFrame:
    """run, spot_id, label of every fit."""
    out = None
    for r, fit in fits.items():
        one = domains_of(fit.h, n_domains, seeds[r]).select(F.lit(r).cast("long").alias("run"), "spot_id", "label")
        out = one if out is None else out.unionByName(one)
    return cut(out)


def pair_ari(labels: DataFrame) -> DataFrame:
    """i < j, ari of each pair of runs (run, spot_id, label)."""
    a, b = labels.select(F.col("run").alias("i"), "spot_id", F.col("label").alias("t")), labels.select(F.col("run").alias("j"), "spot_id", F.col("label").alias("p"))
    return concordance.ari(a.join(b, "spot_id").where("i < j"), ("i", "j"))


def finite_drop(rows: DataFrame, value: str, order: str) -> DataFrame:
    """drop: the first finite value less the last, by order; null for less than two."""
    ok = rows.where(F.col(value).isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf")))
    ends = ok.agg(F.min_by(value, order).alias("a"), F.max_by(value, order).alias("b"), F.count("*").alias("n"))
    return ends.select(F.when(F.col("n") >= 2, F.col("a") - F.col("b")).alias("drop"))


def seed_stability(spark: SparkSession, config: Config = Config(), seeds: tuple[int, ...] = (0, 1, 2, 3), data_seed: int = 0) -> DataFrame:
    """i, j, factor_corr, domain_ari of each pair of seeds, fitted to one instance; nothing but the start differs."""
    if len(seeds) < 2:
        raise ValueError("at least two seeds")
    data = planted(spark, config, data_seed)
    fits = models.fit_nmf_runs(data.expr, data.edges, data.spots, config.n_genes, config.k, [(s, config.lam, s) for s in seeds], n_iter=config.n_iter, tol=config.tol)
    scores = {s: cut(models.long_scores(f.h)) for s, f in fits.items()}
    corr = [(i, j, factors.matched_factor_correlation(scores[i], scores[j])) for i, j in combinations(seeds, 2)]
    table = spark.createDataFrame(corr, "i long, j long, factor_corr double")
    return table.join(pair_ari(labels_of_runs(fits, config.n_domains, {s: s for s in seeds})).withColumnRenamed("ari", "domain_ari"), ["i", "j"])


def robustness_to_k(spark: SparkSession, config: Config = Config(), ks: tuple[int, ...] | None = None, seeds: tuple[int, ...] = (0, 1, 2), dropout: float = 0.0) -> DataFrame:
    """k, self_stability (mean ARI of pairs of seeds), ari_vs_gt (of the first seed), best (the first k of the largest
    self_stability). The fits don't depend on k, so each seed is fitted once."""
    if len(seeds) < 2:
        raise ValueError("at least two seeds")
    n = config.n_domains
    ks = ks or (max(2, n - 2), max(2, n - 1), n, n + 1, n + 2)
    data = planted(spark, config, seeds[0])
    edges = cut(graph.edge_dropout(data.edges, dropout, seeds[0]))
    fits = models.fit_nmf_runs(data.expr, edges, data.spots, config.n_genes, config.k, [(s, config.lam, s) for s in seeds], n_iter=config.n_iter, tol=config.tol)
    rows, truth = [], data.domains.select("spot_id", F.col("domain_id").alias("t"))
    for at, k in enumerate(ks):
        labels = labels_of_runs(fits, k, {s: s for s in seeds})
        first = labels.where(F.col("run") == seeds[0]).select("spot_id", F.col("label").alias("p"))
        gt = concordance.ari(truth.join(first, "spot_id")).first()[0]
        rows.append((at, k, pair_ari(labels).agg(F.avg("ari")).first()[0], gt))
    top = max((r for r in rows if r[2] is not None), key=lambda r: r[2], default=(None,))[0]
    return spark.createDataFrame([(*r[1:], r[0] == top) for r in rows], "k long, self_stability double, ari_vs_gt double, best boolean")


def recovery_vs_batch(spark: SparkSession, config: Config = Config(), noises: tuple[float, ...] = (0.5, 5.0, 15.0, 30.0), seed: int = 0) -> DataFrame:
    """pos, noise, factor_corr with the planted scores, domain_ari with the planted domains, as noise grows."""
    data = [planted(spark, config, seed, x) for x in noises]
    expr = None
    for r, d in enumerate(data):
        one = d.expr.withColumn("run", F.lit(r).cast("long"))
        expr = one if expr is None else expr.unionByName(one)
    # Only values depend on the noise; spots, edges, scores and domains are the same in all instances.
    first = data[0]
    fits = models.fit_nmf_runs(expr, first.edges, first.spots, config.n_genes, config.k, [(r, config.lam, seed) for r in range(len(noises))], n_iter=config.n_iter, tol=config.tol)
    truth, rows = first.domains.select("spot_id", F.col("domain_id").alias("t")), []
    for r, noise in enumerate(noises):
        corr = factors.matched_factor_correlation(models.long_scores(fits[r].h), first.scores)
        found = domains_of(fits[r].h, config.n_domains, seed).select("spot_id", F.col("label").alias("p"))
        rows.append((r, float(noise), corr, concordance.ari(truth.join(found, "spot_id")).first()[0]))
    return spark.createDataFrame(rows, "pos long, noise double, factor_corr double, domain_ari double")


def project_scores(expr: DataFrame, spots: DataFrame, loadings: DataFrame, k: int) -> DataFrame:
    """spot_id, h: least-squares scores of spots for loadings (gene_id, w), cut at 0."""
    g = np_pinv(linalg.gram_of(loadings, "w", k))
    rows = expr.join(loadings, "gene_id").groupBy("spot_id").agg(*linalg.sum_vector("w", k, F.col("value").cast("double")))
    rows = spots.select("spot_id").join(rows, "spot_id", "left").select("spot_id", F.array(*(F.coalesce(f"x{i}", F.lit(0e0)) for i in range(k))).alias("b"))
    return rows.select("spot_id", F.array(*(F.greatest(c, F.lit(0e0)) for c in linalg.times(F.col("b"), g))).alias("h"))


def np_pinv(g):
    import numpy as np

    return np.linalg.pinv(g)


def loso_transfer(
    expr: DataFrame, edges: DataFrame, spots: DataFrame, truth: DataFrame, n_genes: int, *, k: int = 4, n_domains: int = 5, n_iter: int = 120,
    tol: float = 1e-4, lam: float = 1.0, seed: int = 0,
) -> DataFrame:
    """section_id, ari, nmi: of each section against truth (spot_id, label), after a fit to all others whose loadings
    score it. All fits run together."""
    sections = [r[0] for r in spots.select("section_id").distinct().orderBy("section_id").collect()]
    if len(sections) < 2:
        raise ValueError("at least two sections")
    every = F.array(*(F.struct(F.lit(i).cast("long").alias("run"), F.lit(s).alias("out")) for i, s in enumerate(sections)))
    train = cut(spots.select("spot_id", F.explode(F.filter(every, lambda x: x["out"] != F.col("section_id"))).alias("x")).select("x.run", "spot_id"))
    e = edges.join(train.withColumnRenamed("spot_id", "src"), "src").join(train.withColumnRenamed("spot_id", "dst"), ["run", "dst"])
    fits = models.fit_nmf_runs(expr.join(train, "spot_id"), e, train, n_genes, k, [(i, lam, seed) for i in range(len(sections))], n_iter=n_iter, tol=tol)
    found = None
    for i, s in enumerate(sections):
        test = spots.where(F.col("section_id") == s)
        h = project_scores(expr.join(test.select("spot_id"), "spot_id", "left_semi"), test, fits[i].w, k)
        one = kmeans(h.select(F.col("spot_id").alias("id"), "h"), n_domains, max_iter=50, seed=seed, empty="keep").labels
        one = one.select(F.lit(s).alias("section_id"), F.col("id").alias("spot_id"), F.col("label").alias("p"))
        found = one if found is None else found.unionByName(one)
    pairs = cut(found.join(truth.select("spot_id", F.col("label").alias("t")), "spot_id"))
    return concordance.ari(pairs, ("section_id",)).join(concordance.nmi(pairs, ("section_id",)), "section_id")


def perturbation_consensus(
    expr: DataFrame, edges: DataFrame, spots: DataFrame, n_genes: int, n_domains: int, *, n_perturb: int = 8, drop: float = 0.1, k: int = 4,
    n_iter: int = 60, lam: float = 1.0, tol: float = 1e-4, seed: int = 0,
) -> tuple[DataFrame, DataFrame]:
    """The reference domains (spot_id, label), and each one's survival: how often its pairs of spots stay together when
    the fit is repeated on thinned graphs. Domains are clusters of standardised scores and coordinates."""
    if n_perturb < 1:
        raise ValueError("n_perturb must be positive")
    thinned = None
    for r in range(n_perturb + 1):
        one = edges.select("src", "dst") if r == 0 else graph.edge_dropout(edges, drop, seed + r, keep_one=True).select("src", "dst")
        one = one.withColumn("run", F.lit(r).cast("long"))
        thinned = one if thinned is None else thinned.unionByName(one)
    seeds = {r: seed + r for r in range(n_perturb + 1)}
    fits = models.fit_nmf_runs(expr, thinned, spots, n_genes, k, [(r, lam, s) for r, s in seeds.items()], n_iter=n_iter, tol=tol)
    both = {r: f._replace(h=f.h.join(spots.select("spot_id", "x", "y"), "spot_id").select("spot_id", F.concat("h", F.array("x", "y")).alias("h"))) for r, f in fits.items()}
    labels = labels_of_runs(both, n_domains, seeds)
    reference = labels.where("run = 0").select("spot_id", "label")
    return reference, reports.survival(reference, labels.where("run > 0"), n_perturb)


def oversmoothing(expr: DataFrame, edges: DataFrame, spots: DataFrame, n_genes: int, lams: list[float], *, k: int = 4, n_iter: int = 100, tol: float = 1e-4, seed: int = 0) -> DataFrame:
    """pos, lam, coherence (mean Moran's I of the scores), signal (1 less the reconstruction error, at least 0)."""
    if not lams:
        raise ValueError("no lam")
    fits = models.fit_nmf_runs(expr, edges, spots, n_genes, k, [(i, x, seed) for i, x in enumerate(lams)], n_iter=n_iter, tol=tol)
    rows = []
    for i, lam in enumerate(lams):
        h, w = models.long_scores(fits[i].h), models.long_loadings(fits[i].w)
        smooth = spatial.morans_i(h, edges, "k").agg(F.avg("i")).first()[0]
        rows.append((i, float(lam), smooth, max(0.0, 1.0 - factors.reconstruction_error(expr, h, w).first()[0])))
    return spots.sparkSession.createDataFrame(rows, "pos long, lam double, coherence double, signal double")


def lam_sweep(expr: DataFrame, edges: DataFrame, spots: DataFrame, truth: DataFrame, n_genes: int, lams: list[float], seeds: list[int], *, k: int = 6, n_domains: int = 5, n_iter: int = 200, tol: float = 1e-4) -> DataFrame:
    """lam, seed, ari, nmi, ami (against truth: spot_id, label), edge_purity, recon, lam_smooth, smooth_fraction,
    iterations of every fit; for reports.sweep_summary and recommend_lam."""
    grid = [(i, lam, seed) for i, (lam, seed) in enumerate((x, s) for x in lams for s in seeds)]
    fits, rows = models.fit_nmf_runs(expr, edges, spots, n_genes, k, grid, n_iter=n_iter, tol=tol), []
    for i, lam, seed in grid:
        f = fits[i]
        labels = cut(domains_of(f.h, n_domains, seed))
        acc = concordance.accuracy(truth.select("spot_id", F.col("label").alias("t")).join(labels.withColumnRenamed("label", "p"), "spot_id")).first()
        recon = factors.squared_residual(expr, models.long_scores(f.h), models.long_loadings(f.w)).first()["rr"]
        smooth = f.lam_effective * (graph.laplacian_form(edges, models.long_scores(f.h), "k").first()[0] or 0.0)
        total = recon + smooth
        rows.append((float(lam), seed, acc["ari"], acc["nmi"], acc["ami"], graph.edge_purity(edges, labels).first()[0], recon, smooth, smooth / total if total > 0 else 0.0, f.iterations))
    return spots.sparkSession.createDataFrame(rows, "lam double, seed long, ari double, nmi double, ami double, edge_purity double, recon double, lam_smooth double, smooth_fraction double, iterations long")


def grid_sweep(spark: SparkSession, config: Config, lams: list[float], n_iters: list[int], tols: list[float], seeds: list[int]) -> DataFrame:
    """A row per lam, n_iter, tol and seed of fits to the seed's planted instance: how well factors and domains are
    recovered, the objective at both ends, iterations and whether they ended before n_iter. lams fit together."""
    rows = []
    for seed in seeds:
        data = planted(spark, config, seed)
        truth = data.domains.select("spot_id", F.col("domain_id").alias("t"))
        for n_iter in n_iters:
            for tol in tols:
                fits = models.fit_nmf_runs(data.expr, data.edges, data.spots, config.n_genes, config.k, [(i, x, seed) for i, x in enumerate(lams)], n_iter=n_iter, tol=tol)
                for i, lam in enumerate(lams):
                    f = fits[i]
                    corr = factors.matched_factor_correlation(models.long_scores(f.h), data.scores)
                    found = domains_of(f.h, config.n_domains, seed).select("spot_id", F.col("label").alias("p"))
                    ari = concordance.ari(truth.join(found, "spot_id")).first()[0]
                    rows.append((float(lam), n_iter, float(tol), seed, corr, ari, f.trace[0], f.trace[-1], f.iterations, f.iterations < n_iter))
    return spark.createDataFrame(rows, "lam double, n_iter long, tol double, seed long, factor_corr double, domain_ari double, first double, last double, iterations long, converged boolean")


def grid_summary(rows: DataFrame) -> DataFrame:
    """lam, n_iter, tol and the means over seeds, best first: by factor_corr, then domain_ari, those without one last."""
    out = rows.groupBy("lam", "n_iter", "tol").agg(F.avg("factor_corr").alias("corr_mean"), F.avg("domain_ari").alias("ari_mean"), F.avg("iterations").alias("iterations_mean"))
    return out.orderBy(F.col("corr_mean").desc_nulls_last(), F.col("ari_mean").desc_nulls_last(), "lam", "n_iter", "tol")


def reference_ambiguity(expr: DataFrame, truth: DataFrame, n_genes: int, components: int = 50) -> DataFrame:
    """ambiguity: how badly labels (spot_id, gt) part the labelled spots in the space of leading components: silhouette
    times -1; null where that is undefined. No prediction enters."""
    named = cut(truth.where(concordance.has_label(F.col("gt"))).select("spot_id", F.trim(F.col("gt").cast("string")).alias("label")))
    none = truth.sparkSession.range(1).select(F.lit(None).cast("double").alias("ambiguity"))
    if named.count() < 2:
        return none
    values = expr.join(named.select("spot_id"), "spot_id", "left_semi").select("spot_id", "gene_id", F.col("value").cast("double").alias("v"))
    # The components need several passes over the rows, which are gathered by a shuffle once.
    embedding, _ = linalg.pca(cut(models.dense_rows(values, named, n_genes)), components)
    points = embedding.join(named.withColumnRenamed("spot_id", "id"), "id")
    return spatial.silhouette(points).select((-F.col("silhouette")).alias("ambiguity"))


def pca_plane(points: DataFrame) -> DataFrame:
    """id, h: two leading components; what a narrower table lacks is 0."""
    scores, _ = linalg.pca(points, 2)
    return scores.select("id", F.array(*(F.coalesce(F.get("h", i), F.lit(0e0)) for i in range(2))).alias("h"))


def integration_embedding(before: DataFrame, after: DataFrame, spots: DataFrame) -> DataFrame:
    """stage, spot_id, section_id, x, y: the planes of leading components before and after integration (id, h)."""
    out = None
    for stage, points in (("before", before), ("after", after)):
        one = pca_plane(points).select(F.lit(stage).alias("stage"), F.col("id").alias("spot_id"), F.get("h", 0).alias("x"), F.get("h", 1).alias("y"))
        out = one if out is None else out.unionByName(one)
    return out.join(spots.select("spot_id", "section_id"), "spot_id")


def nmf_contrast(expr: DataFrame, spots: DataFrame, scores: DataFrame, n_genes: int, n_iter: int = 400, genes: int = 2000, seed: int = 0) -> DataFrame:
    """correlation, gap: how close scores (spot_id, k, v) come to those of a plain NMF of the genes of largest variance.

    The NMF starts from hashed numbers, not from singular vectors as other libraries do.
    """
    top = prep.top_variance_genes(expr, spots.agg(F.count("*")), min(genes, n_genes)).select("gene_id")
    k = scores.select("k").distinct().count()
    fit = models.plain_nmf(expr.join(top, "gene_id", "left_semi"), spots, n_genes, k, n_iter=n_iter, seed=seed)
    r = factors.matched_factor_correlation(models.long_scores(fit.h), scores)
    return spots.sparkSession.createDataFrame([(r, None if r is None else 1 - r)], "correlation double, gap double")
