"""Metrics of factors: scores (spot_id, k, v), loadings (gene_id, k, w), and what they say about covariates."""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ranks import quantiles


def abs_corr(x: DataFrame, y: DataFrame, key: str = "spot_id") -> DataFrame:
    """i, j, r: absolute correlation of each factor of x with each of y (key, k, v; a row for every key and factor).

    From sums of products, in one join; at most 1, and 0 for constant factors.
    """
    a, b = x.select(key, F.col("k").alias("i"), F.col("v").alias("u")), y.select(key, F.col("k").alias("j"), F.col("v").alias("v"))
    s = a.join(b, key).groupBy("i", "j").agg(
        F.count("*").alias("n"), *(F.sum(e).alias(n) for n, e in (("u", F.col("u")), ("v", F.col("v")), ("uu", F.col("u") * F.col("u")), ("vv", F.col("v") * F.col("v")), ("uv", F.col("u") * F.col("v"))))
    )
    n = F.col("n").cast("double")
    cov = F.col("uv") - F.col("u") * F.col("v") / n
    down = F.sqrt(F.greatest(F.col("uu") - F.col("u") * F.col("u") / n, F.lit(0e0)) * F.greatest(F.col("vv") - F.col("v") * F.col("v") / n, F.lit(0e0)))
    return s.select("i", "j", F.least(F.abs(cov) / F.greatest(down, F.lit(1e-12)), F.lit(1e0)).alias("r"))


def redundancy(x: DataFrame, key: str = "spot_id") -> DataFrame:
    """redundancy: mean absolute correlation of different factors; 0 for one."""
    return abs_corr(x, x, key).where("i <> j").agg(F.coalesce(F.avg("r"), F.lit(0e0)).alias("redundancy"))


def matched_correlation(r: list[tuple[int, int, float]]) -> float | None:
    """Mean of the best one-to-one matching of rows and columns (i, j, r), by search up to 8, greedily by row beyond
    (ties to the later column); r has a row per pair of factors, so it is small. None without factors."""
    rows, cols = sorted({i for i, _, _ in r}), sorted({j for _, j, _ in r})
    if not r:
        return None
    m = {(i, j): v for i, j, v in r}
    if len(rows) > len(cols):
        rows, cols, m = cols, rows, {(j, i): v for (i, j), v in m.items()}
    if len(cols) <= 8:
        return max(sum(m[i, j] for i, j in zip(rows, p, strict=True)) for p in permutations(cols, len(rows))) / len(rows)
    free, total = set(cols), 0.0
    for i in rows:
        j = max(free, key=lambda c: (m[i, c], c))
        free.remove(j)
        total += m[i, j]
    return total / len(rows)


def matched_factor_correlation(x: DataFrame, y: DataFrame, key: str = "spot_id") -> float | None:
    return matched_correlation([tuple(z) for z in abs_corr(x, y, key).collect()])


def section_overlap(scores: DataFrame, spots: DataFrame) -> DataFrame:
    """k, section_id, share of the factor's sum in the section."""
    s = scores.join(spots.select("spot_id", "section_id"), "spot_id").groupBy("k", "section_id").agg(F.sum("v").alias("v"))
    return s.select("k", "section_id", (F.col("v") / F.greatest(F.sum("v").over(Window.partitionBy("k")), F.lit(1e-12))).alias("share"))


def shared_private_separation(scores: DataFrame, spots: DataFrame) -> DataFrame:
    """sections: mean number of sections that hold more than min(0.05, half an even share) of a factor."""
    limit = spots.agg(F.least(F.lit(0.05e0), F.lit(0.5e0) / F.count_distinct("section_id")).alias("t"))
    per = section_overlap(scores, spots).groupBy("k").agg(F.count_if(F.col("share") > limit.scalar()).alias("n"))
    return per.agg(F.coalesce(F.avg(F.col("n").cast("double")), F.lit(0e0)).alias("sections"))


def gram(x: DataFrame, key: str) -> DataFrame:
    """i, j, g: products of the factors of x (key, k, v)."""
    rows = x.groupBy(key).agg(F.collect_list(F.struct("k", "v")).alias("f"))
    pairs = rows.select(F.explode("f").alias("a"), "f").select("a", F.explode("f").alias("b"))
    return pairs.groupBy(F.col("a.k").alias("i"), F.col("b.k").alias("j")).agg(F.sum(F.col("a.v") * F.col("b.v")).alias("g"))


def squared_residual(expr: DataFrame, scores: DataFrame, loadings: DataFrame) -> DataFrame:
    """xx, rr: squared norms of the values and of values minus scores times loadings, from Gram matrices: no dense
    residual is made. Cancellation limits rr to about 1e-15 xx."""
    w = loadings.withColumnRenamed("w", "v")
    xw = expr.join(loadings, "gene_id").join(scores, ["spot_id", "k"]).agg(F.sum(F.col("value") * F.col("w") * F.col("v")).alias("xw"))
    ww = gram(scores, "spot_id").join(gram(w, "gene_id").withColumnRenamed("g", "h"), ["i", "j"]).agg(F.sum(F.col("g") * F.col("h")).alias("ww"))
    xx = expr.agg(F.sum(F.col("value") * F.col("value")).alias("xx"))
    rr = F.greatest(F.coalesce("xx", F.lit(0e0)) - 2 * F.coalesce(xw.scalar(), F.lit(0e0)) + F.coalesce(ww.scalar(), F.lit(0e0)), F.lit(0e0))
    return xx.select(F.coalesce("xx", F.lit(0e0)).alias("xx"), rr.alias("rr"))


def reconstruction_error(expr: DataFrame, scores: DataFrame, loadings: DataFrame) -> DataFrame:
    """error: norm of the residual over that of the values; the residual's own if there are none."""
    return squared_residual(expr, scores, loadings).select(F.when(F.col("xx") > 0, F.sqrt(F.try_divide("rr", "xx"))).otherwise(F.sqrt("rr")).alias("error"))


def eta_squared(scores: DataFrame, groups: DataFrame) -> DataFrame:
    """k, covariate, eta2: share of each factor's spread that lies between the groups (spot_id, covariate, g); null for
    constant factors, 0 for one group."""
    per = scores.join(groups, "spot_id").groupBy("k", "covariate", "g").agg(F.count("*").alias("n"), F.sum("v").alias("s"), F.sum(F.col("v") * F.col("v")).alias("ss"))
    t = per.groupBy("k", "covariate").agg(
        F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("ss").alias("ss"), F.sum(F.col("s") * F.col("s") / F.col("n")).alias("b"), F.count("*").alias("c")
    )
    base = F.col("s") * F.col("s") / F.col("n")
    spread = F.col("ss") - base
    return t.select("k", "covariate", F.when(spread <= 1e-12 * F.col("ss"), None).when(F.col("c") < 2, 0e0).otherwise((F.col("b") - base) / spread).alias("eta2"))


def quantile_bins(scores: DataFrame, bins: int) -> DataFrame:
    """spot_id, k, bin: number of inner quantile edges (linear, without repeats) that v reaches; with at most `bins`
    different values each has a bin of its own."""
    if bins < 2:
        raise ValueError("at least two bins")
    e = quantiles(scores, "v", [i / bins for i in range(bins + 1)], ("k",)).withColumn("e", F.array_distinct("e"))
    # The least values that differ, one more than bins at most: each task sends on so many a factor.
    place = F.row_number().over(Window.partitionBy("k").orderBy("v"))
    first = scores.select("k", "v").distinct().withColumn("r", place).where(F.col("r") <= bins + 1)
    e = e.join(first.groupBy("k").agg(F.array_sort(F.collect_list("v")).alias("first")), "k")
    inner = F.slice("e", F.lit(2), F.greatest(F.size("e") - 2, F.lit(0)))
    by_edge = F.size(F.filter(inner, lambda x: x <= F.col("v")))
    own = (F.array_position("first", F.col("v")) - 1).cast("int")
    return scores.join(e, "k").select("spot_id", "k", F.when(F.size("first") <= bins, own).otherwise(by_edge).alias("bin"))


def domain_stats(labels: DataFrame) -> DataFrame:
    """n_domains, entropy (nats) of label sizes."""
    s = labels.groupBy("label").agg(F.count("*").alias("n"))
    p = F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(0)))
    return s.withColumn("p", p).agg(F.count("*").alias("n_domains"), F.coalesce(-F.sum(F.col("p") * F.ln("p")), F.lit(0e0)).alias("entropy"))


def top_genes(loadings: DataFrame, n: int) -> DataFrame:
    """k, rank, gene_id, w: the n largest loadings of each factor; ties to the smaller gene."""
    if n <= 0:
        raise ValueError("n must be positive")
    return loadings.withColumn("rank", F.row_number().over(Window.partitionBy("k").orderBy(F.desc("w"), "gene_id")).cast("long")).where(F.col("rank") <= n).select("k", "rank", "gene_id", "w")


def gene_union(top: DataFrame) -> DataFrame:
    """gene_id, place: distinct top genes in the order in which factors first name them."""
    first = top.groupBy("gene_id").agg(F.min(F.struct("k", "rank")).alias("first"))
    return first.select("gene_id", F.row_number().over(Window.orderBy("first")).cast("long").alias("place"))


def top_gene_mass(loadings: DataFrame, n: int) -> DataFrame:
    """k, mass: share of a factor's absolute loadings in its n largest; null without loadings."""
    r = F.row_number().over(Window.partitionBy("k").orderBy(F.abs("w").desc(), "gene_id"))
    s = loadings.withColumn("r", r).groupBy("k").agg(F.sum(F.when(F.col("r") <= n, F.abs("w"))).alias("top"), F.sum(F.abs("w")).alias("all"))
    return s.select("k", F.try_divide("top", "all").alias("mass"))
