"""Factor models: graph-regularised NMF, plain NMF, the projection model, and two baselines for domains."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..checkpoints import cut
from . import graph, linalg, prep
from .kmeans import kmeans, kmeans_over_components

EPS = 1e-12
#: Loadings of at most so many numbers are broadcast; larger ones are joined by a shuffle.
BROADCAST_NUMBERS = 2_000_000


#: So many numbers at most are observed by one job.
MOST_OBSERVED = 1000


class Factorisation(NamedTuple):
    h: DataFrame  # spot_id, h
    w: DataFrame  # gene_id, w
    trace: list[float]  # objective, the start included
    iterations: int
    lam_effective: float


class Outputs(NamedTuple):
    scores: DataFrame  # spot_id, h as fitted
    loadings: DataFrame  # gene_id, k, w of length 1
    shared: DataFrame  # spot_id, k, v that go with the loadings
    private: DataFrame
    domains: DataFrame  # spot_id, domain_id
    fit: Factorisation | None


def _small(df: DataFrame, numbers: int) -> DataFrame:
    return F.broadcast(df) if numbers <= BROADCAST_NUMBERS else df


def start_rows(ids: DataFrame, key: str, k: int, tag: str, low: float = 0.0) -> DataFrame:
    """run, key and an array h of k hashed numbers in (low, 1), times scale; ids: run, key, seed, scale."""
    u = [(F.lit(low) + (1 - low) * graph.hash_unit(F.col("seed"), tag, F.col(key), i) + EPS) * F.col("scale") for i in range(k)]
    return ids.select("run", key, F.array(*u).alias("h"))


def fit_nmf(
    expr: DataFrame, edges: DataFrame | None, spots: DataFrame, n_genes: int, k: int, *, lam: float = 1.0, n_iter: int = 200, tol: float = 1e-4,
    seed: int = 0, eps: float = EPS, scale_lam: bool = True, low: float | None = None,
) -> Factorisation:
    """fit_nmf_runs of one run."""
    return fit_nmf_runs(expr, edges, spots, n_genes, k, [(0, lam, seed)], n_iter=n_iter, tol=tol, eps=eps, scale_lam=scale_lam, low=low)[0]


def fit_nmf_runs(
    expr: DataFrame, edges: DataFrame | None, spots: DataFrame, n_genes: int, k: int, runs: list[tuple[int, float, int]], *, n_iter: int = 200,
    tol: float = 1e-4, eps: float = EPS, scale_lam: bool = True, low: float | None = None,
) -> dict[int, Factorisation]:
    """Fits of runs (number, lam, seed), which all advance in the same jobs; where expr, edges or spots have a column
    run, a run uses its own rows of it.

    Multiplicative updates, scores first and then loadings; edges count in both directions as a bag. lam is multiplied
    by the root mean square of all values, zeros included. A run stops when its objective changes by less than tol of
    itself. Matrices k x k go through the driver; everything else stays distributed, and no spots x genes residual is
    made. low: start from numbers in (low, 1) unscaled. An iteration is two jobs, which write scores and loadings; the
    objective and the Gram matrices are observed meanwhile, in the writing stages, whose tasks count once.
    """
    if k <= 0 or n_iter <= 0 or any(lam < 0 for _, lam, _ in runs):
        raise ValueError("k and n_iter must be positive and lam not negative")
    spark, of = spots.sparkSession, lambda df: ["run"] if df is not None and "run" in df.columns else []
    ex, ed, sp = of(expr), of(edges), of(spots)
    every = lambda df: df if "run" in df.columns else df.withColumn("run", F.explode(F.array(*(F.lit(r).cast("long") for r, _, _ in runs))))
    x = cut(expr.select(*ex, "spot_id", "gene_id", F.greatest(F.col("value").cast("double"), F.lit(0e0)).alias("value")).where("value > 0"))
    by = lambda rows, cols: {r[0] if cols else None: r for r in rows}
    sizes = by(spots.groupBy(*sp).agg(F.count("*").alias("n")).collect(), sp)
    sums = by(x.groupBy(*ex).agg(F.coalesce(F.sum("value"), F.lit(0e0)).alias("s"), F.coalesce(F.sum(F.col("value") * F.col("value")), F.lit(0e0)).alias("q")).collect(), ex)
    settings, square, lam_eff = [], {}, {}
    for r, lam, seed in runs:
        n = (sizes.get(r if sp else None) or {"n": 0})["n"]
        t = sums.get(r if ex else None) or {"s": 0.0, "q": 0.0}
        cells = max(1, n * n_genes)
        rms, square[r] = (t["q"] / cells) ** 0.5, t["q"]
        lam_eff[r] = lam * (rms if scale_lam and rms > 1e-12 else 1.0)
        settings.append((r, seed, max(t["s"] / cells, EPS) ** 0.5 / k**0.5 if low is None else 1.0, lam_eff[r]))
    table = F.broadcast(spark.createDataFrame(settings, "run long, seed long, scale double, lam double"))
    h = start_rows(every(spots.select(*sp, "spot_id")).join(table, "run"), "spot_id", k, "H", low or 0.0)
    w = start_rows(every(spark.range(n_genes).select(F.col("id").alias("gene_id"))).join(table, "run"), "gene_id", k, "W", low or 0.0)

    def result(r: int, trace: list[float], done: int) -> Factorisation:
        mine = F.col("run") == r
        return Factorisation(h.where(mine).select("spot_id", "h"), w.where(mine).select("gene_id", F.col("h").alias("w")), trace, done, lam_eff[r])

    if not n_genes or not any(r["n"] for r in sizes.values()):
        return {r: result(r, [], 0) for r, _, _ in runs}
    both = None
    if edges is not None and any(lam_eff.values()):
        both = cut(edges.select(*ed, "src", "dst").union(edges.select(*ed, "dst", "src")))
    numbers = n_genes * k * len(runs)

    def summed(key: str, names: str, *parts: tuple[DataFrame, str, Column | None]) -> DataFrame:
        """run, key and an array for each letter of names: sums by run and key of the parts (rows, letter, weight), each
        of which gives its array h, times weight, to its letter; d counts the rows of the second of three parts. All parts meet in one shuffle. Keys that the last part does not name are left out."""
        rows = None
        for at, (df, letter, weight) in enumerate(parts):
            value = lambda i: F.get("h", i) if weight is None else F.get("h", i) * weight  # noqa: E731, B023
            cols = [(value(i) if x == letter else F.lit(0e0)).alias(f"{x}{i}") for x in names for i in range(k)]
            flags = F.lit(int(at == 1 and len(parts) == 3)).alias("d"), F.lit(int(at == len(parts) - 1)).alias("own")
            one = df.select("run", key, *cols, *flags)
            rows = one if rows is None else rows.unionByName(one)
        sums = rows.groupBy("run", key).agg(*(F.sum(f"{x}{i}").alias(f"{x}{i}") for x in names for i in range(k)), F.sum("d").alias("d"), F.max("own").alias("own"))
        return sums.where("own = 1").select("run", key, *(F.array(*(F.col(f"{x}{i}") for i in range(k))).alias(x) for x in names), "d")

    def state(h: DataFrame, w: DataFrame) -> DataFrame:
        """run, spot_id, h, x (values times loadings), a (sum over neighbours) and d (degree)."""
        xw = x.join(_small(w, numbers), ["gene_id", *ex])
        ah = both.join(h.withColumnRenamed("spot_id", "dst"), ["dst", *ed]).withColumnRenamed("src", "spot_id") if both is not None else h.limit(0)
        return summed("spot_id", "hxa", (xw, "x", F.col("value")), (ah, "a", None), (h, "h", None))

    def dot(a: str, b: str) -> Column:
        return sum((F.get(a, i) * F.get(b, i) for i in range(k)), F.lit(0e0))

    def times_gram(rows: DataFrame, grams: dict[int, np.ndarray]) -> tuple[DataFrame, list[Column]]:
        """rows with their run's lam and Gram matrix, and the entries of h times it."""
        flat = spark.createDataFrame([(r, lam_eff[r], g.ravel().tolist()) for r, g in grams.items()], "run long, lam double, g array<double>")
        return rows.join(F.broadcast(flat), "run"), [sum((F.get("h", j) * F.get("g", j * k + i) for j in range(k)), F.lit(0e0)) for i in range(k)]

    def written(rows: DataFrame, of: list[int]) -> tuple[DataFrame, dict[int, np.ndarray]]:
        """rows (run, key, h) written, and the Gram matrix of each run of them, observed by the same job; with very many
        runs the matrices are grouped by a job of their own."""
        places = [(i, j) for i in range(k) for j in range(i, k)]
        if len(of) * len(places) > MOST_OBSERVED:
            out = cut(rows)
            return out, linalg.grams_by(out, "run", "h", k)
        seen = Observation()
        out = cut(rows.observe(seen, *(F.sum(F.when(F.col("run") == r, F.get("h", i) * F.get("h", j))).alias(f"g{r}_{i}_{j}") for r in of for i, j in places)))
        found, grams = seen.get, {r: np.zeros((k, k)) for r in of}
        for r in of:
            for i, j in places:
                grams[r][i, j] = grams[r][j, i] = found[f"g{r}_{i}_{j}"] or 0.0
        return out, grams

    h, w = cut(h), cut(w)
    hh, ww = linalg.grams_by(h, "run", "h", k), linalg.grams_by(w, "run", "h", k)
    going, traces, out = [r for r, _, _ in runs if r in hh], {r: [] for r, _, _ in runs}, {}
    out |= {r: result(r, [], 0) for r, _, _ in runs if r not in hh}
    for it in range(n_iter + 1):
        q = state(h, w)
        sums = [F.sum(F.when(F.col("run") == r, v)).alias(f"{name}{r}") for r in going for name, v in (("c", dot("x", "h")), ("s", F.col("d") * dot("h", "h") - dot("h", "a")))]
        if it < n_iter:
            seen = Observation()
            rows, down = times_gram(q.observe(seen, *sums), {r: ww[r] for r in going})
            new = [F.get("h", i) * (F.get("x", i) + F.col("lam") * F.get("a", i)) / (down[i] + F.col("lam") * F.col("d") * F.get("h", i) + eps) for i in range(k)]
            (ahead, grams), found = written(rows.select("run", "spot_id", F.array(*new).alias("h")), going), seen.get
        else:
            found = q.agg(*sums).first().asDict()
        for r in list(going):
            trace = traces[r]
            trace.append(max(0.0, square[r] - 2 * found[f"c{r}"] + float((hh[r] * ww[r]).sum())) + lam_eff[r] * found[f"s{r}"])
            if it == n_iter or (tol and it and trace[-2] > EPS and abs(trace[-2] - trace[-1]) / trace[-2] < tol):
                out[r] = result(r, trace, it)
                going.remove(r)
        if not going:
            break
        left = F.col("run").isin(going)
        h, w, hh = ahead.where(left), w.where(left), {r: grams[r] for r in going}
        rows, down = times_gram(summed("gene_id", "hx", (x.join(h, ["spot_id", *ex]), "x", F.col("value")), (w, "h", None)), hh)
        w, ww = written(rows.select("run", "gene_id", F.array(*(F.get("h", i) * F.get("x", i) / (down[i] + eps) for i in range(k))).alias("h")), going)
    return out


def plain_nmf(expr: DataFrame, spots: DataFrame, n_genes: int, k: int, n_iter: int = 300, seed: int = 0) -> Factorisation:
    """Without a graph, from numbers in (0.1, 1), a fixed number of updates; k is held to the matrix's sides."""
    k = max(1, min(k, spots.count(), n_genes))
    return fit_nmf(expr, None, spots, n_genes, k, lam=0.0, n_iter=n_iter, tol=0.0, seed=seed, eps=1e-9, low=0.1)


def long_scores(h: DataFrame) -> DataFrame:
    return h.select("spot_id", F.posexplode("h").alias("k", "v"))


def long_loadings(w: DataFrame) -> DataFrame:
    return w.select("gene_id", F.posexplode("w").alias("k", "w"))


def standard_points(h: DataFrame) -> DataFrame:
    """id, h with each entry's mean taken off and divided by its deviation, of at least 1e-6."""
    z = prep.zscore(long_scores(h), "k", "floor")
    return z.groupBy(F.col("spot_id").alias("id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "v"))), lambda x: x["v"]).alias("h"))


def _domains(labels: DataFrame) -> DataFrame:
    return labels.select(F.col("id").alias("spot_id"), F.col("label").cast("long").alias("domain_id"))


def gnmf_domains(expr: DataFrame, edges: DataFrame, spots: DataFrame, n_genes: int, *, shared: int = 4, private: int = 2, n_domains: int = 5, **settings) -> Outputs:
    """Graph-regularised NMF; domains are clusters of the standardised scores. Scores stay as fitted; shared and private
    ones are on the scale that goes with loadings of length 1."""
    fit = fit_nmf(expr, edges, spots, n_genes, shared + private, **settings)
    z, w = prep.canonical_gauge(long_scores(fit.h), long_loadings(fit.w))
    labels = kmeans(standard_points(fit.h), n_domains, seed=settings.get("seed", 0)).labels
    return Outputs(fit.h, w, z.where(F.col("k") < shared), z.where(F.col("k") >= shared), _domains(labels), fit)


def spatial_smooth_domains(expr: DataFrame, edges: DataFrame, spots: DataFrame, n_genes: int, *, n_domains: int = 5, components: int = 16, alpha: float = 0.5, hops: int = 2, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """Smooth over the graph, leading components, k-means: (spot_id, domain_id) and the embedding (id, h)."""
    if components <= 0:
        raise ValueError("components must be positive")
    v = graph.smooth(edges, expr.select("spot_id", "gene_id", F.col("value").cast("double").alias("v")), "gene_id", alpha, hops)
    # The components need several passes over the rows, which are smoothed and gathered once.
    embedding, _ = linalg.pca(cut(dense_rows(v, spots, n_genes)), components)
    return _domains(kmeans(embedding, n_domains, seed=seed).labels), embedding


def dense_rows(values: DataFrame, spots: DataFrame, n_genes: int) -> DataFrame:
    """id, h: a spot's values by gene, zeros filled in, from (spot_id, gene_id, v)."""
    m = values.groupBy("spot_id").agg(F.map_from_entries(F.collect_list(F.struct("gene_id", "v"))).alias("m"))
    rows = spots.select("spot_id").join(m, "spot_id", "left")
    filled = F.transform(F.sequence(F.lit(0), F.lit(n_genes - 1)), lambda g: F.coalesce(F.try_element_at("m", g.cast("long")), F.lit(0e0)))
    return rows.select(F.col("spot_id").alias("id"), filled.alias("h"))


def coordinate_domains(spots: DataFrame, n_domains: int = 5, seed: int = 0) -> DataFrame:
    """spot_id, domain_id: k-means of standardised coordinates, the control that knows no genes."""
    m = spots.agg(F.avg("x"), F.avg("y"), F.stddev_pop("x"), F.stddev_pop("y")).first()
    if m[0] is None:
        return spots.select("spot_id", F.lit(0).cast("long").alias("domain_id"))
    h = F.array((F.col("x") - m[0]) / (m[2] or 1.0), (F.col("y") - m[1]) / (m[3] or 1.0))
    return _domains(kmeans(spots.select(F.col("spot_id").alias("id"), h.alias("h")), n_domains, seed=seed).labels)


def encode(expr: DataFrame, spots: DataFrame, edges: DataFrame, n_genes: int, d: int = 16, seed: int = 0) -> DataFrame:
    """spot_id, h: centred values, centred means over dst, centred coordinates and scaled section, projected at random.

    The projection (2 n_genes + 3 rows of d numbers with deviation 1 / sqrt(rows)) is linear, so sparse values are
    projected as they are and the means' projection taken off at the end.
    """
    f = 2 * n_genes + 3
    p = np.random.default_rng(seed).normal(0, f**-0.5, (f, d))
    table = spots.sparkSession.createDataFrame([(g, p[g].tolist(), p[n_genes + g].tolist()) for g in range(n_genes)], "gene_id long, h array<double>, hn array<double>")
    x = expr.select("spot_id", "gene_id", F.col("value").cast("double").alias("value")).join(_small(table, 2 * n_genes * d), "gene_id")
    own = x.groupBy("spot_id").agg(*linalg.sum_vector("h", d, F.col("value")), *(F.sum(F.get("hn", i) * F.col("value")).alias(f"y{i}") for i in range(d)))
    own = cut(spots.select("spot_id", "section_id", "x", "y").join(own, "spot_id", "left").fillna(0.0))
    e = edges.select("src", F.col("dst").alias("spot_id")).join(own.select("spot_id", *(f"y{i}" for i in range(d))), "spot_id")
    mean = e.groupBy(F.col("src").alias("spot_id")).agg(*(F.avg(f"y{i}").alias(f"m{i}") for i in range(d)))
    means = own.agg(F.avg("x"), F.avg("y"), F.max("section_id"), *(F.avg(f"x{i}") for i in range(d)), *(F.avg(f"y{i}") for i in range(d))).first()
    cols = [
        F.col(f"x{i}") - means[3 + i] + F.coalesce(f"m{i}", F.lit(0e0)) - means[3 + d + i]
        + (F.col("x") - means[0]) * float(p[-3, i]) + (F.col("y") - means[1]) * float(p[-2, i])
        + F.col("section_id") / max(1, means[2] or 0) * float(p[-1, i])
        for i in range(d)
    ]
    return own.join(mean, "spot_id", "left").select("spot_id", F.array(*cols).alias("h"))


def projection_model(expr: DataFrame, spots: DataFrame, edges: DataFrame, n_genes: int, *, shared: int = 4, private: int = 2, n_domains: int = 5, d: int = 16, seed: int = 0) -> Outputs:
    """Random projection of features, positive basis, private factors gated by section, nonnegative loadings; domains
    from embedding and coordinates without mixing parts of the graph that are not connected."""
    k = shared + private
    if k <= 0 or d < k:
        raise ValueError("need 0 < factors <= d")
    h = cut(encode(expr, spots, edges, n_genes, d, seed))
    z = cut(prep.section_gate(prep.positive_basis(long_scores(h), k), spots, shared))
    rows = cut(z.groupBy("spot_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "v"))), lambda x: x["v"]).alias("h")))
    g = linalg.gram_of(rows, "h", k)
    x = expr.join(rows, "spot_id").groupBy("gene_id").agg(*linalg.sum_vector("h", k, F.col("value").cast("double"))).select("gene_id", F.array(*(F.col(f"x{i}") for i in range(k))).alias("b"))
    z, w = prep.canonical_gauge(z, long_loadings(linalg.nnls_rows(x, "gene_id", g)))
    both = h.join(spots.select("spot_id", "x", "y"), "spot_id").select("spot_id", F.concat("h", F.array("x", "y")).alias("h"))
    parts = graph.components(edges, spots).withColumnRenamed("spot_id", "id")
    labels = kmeans_over_components(standard_points(both), parts, n_domains, seed)
    return Outputs(h, w, z.where(F.col("k") < shared), z.where(F.col("k") >= shared), _domains(labels), None)


def run_domain_detection(expr: DataFrame, spots: DataFrame, n_genes: int, seed: int = 0, n_domains: int = 5, neighbours: int = 6, **settings) -> tuple[Outputs, dict]:
    """The library's entry point: neighbour graph, graph-regularised NMF and domains, with how they were made."""
    edges = cut(graph.knn_undirected(spots, neighbours))
    out = gnmf_domains(expr, edges, spots, n_genes, n_domains=n_domains, seed=seed, **settings)
    return out, {"model": "gnmf", "seed": seed, "n_domains": n_domains, "neighbours": neighbours, "iterations": out.fit.iterations, "lam_effective": out.fit.lam_effective}
