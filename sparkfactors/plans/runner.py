"""What a run on real data does around the model: preprocessing with a record of it, scores against labels, and guards."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..checkpoints import cut
from ..functions import concordance, spatial
from ..functions.concordance import has_label
from ..operators import graph, linalg, prep
from ..operators.ranks import ranked


def preprocess(expr: DataFrame, spots: DataFrame, n_genes: int, *, already_normalized: bool = False, n_hvg: int = 0, target: float = 1e4) -> tuple[DataFrame, DataFrame]:
    """The values and one row that says what was done: applied, method, target_sum, hvg_applied, n_genes_used.

    Counts are scaled to the target and logged, other values stay. With more genes than n_hvg > 0, only the n_hvg of
    largest dispersion stay.
    """
    counts = not already_normalized and bool(prep.looks_raw(expr).first()[0])
    out = prep.log1p(prep.normalize_total(expr, target)) if counts else expr
    some = 0 < n_hvg < n_genes
    if some:
        out = out.join(prep.dispersion_genes(out, spots.agg(F.count("*")), n_hvg).select("gene_id"), "gene_id", "left_semi").select(expr.columns)
    done = (counts, "normalize_total+log1p" if counts else "none", float(target) if counts else None, some, n_hvg if some else n_genes)
    return out, spots.sparkSession.createDataFrame([done], "applied boolean, method string, target_sum double, hvg_applied boolean, n_genes_used long")


def labelled(truth: DataFrame, domains: DataFrame) -> DataFrame:
    """spot_id, t, p of spots (spot_id, gt) with a label, beside their domain (spot_id, label)."""
    named = truth.where(has_label(F.col("gt"))).select("spot_id", F.col("gt").cast("string").alias("t"))
    return named.join(domains.select("spot_id", F.col("label").alias("p")), "spot_id")


def truth_ari(truth: DataFrame, domains: DataFrame) -> DataFrame:
    """ari, n_labeled; ari is null with less than two labelled spots or two labels."""
    pairs = labelled(truth, domains)
    n = pairs.agg(F.count("*").alias("n_labeled"), F.count_distinct("t").alias("c"))
    value = F.when((F.col("n_labeled") >= 2) & (F.col("c") >= 2), concordance.ari(pairs).scalar())
    return n.select(value.alias("ari"), "n_labeled")


def truth_suite(truth: DataFrame, domains: DataFrame, points: DataFrame, edges: DataFrame) -> DataFrame:
    """nmi, dice, precision, recall, f1 of boundaries, silhouette and ch of the domains in the embedding points (id, h),
    all over labelled spots and the edges among them; no row without two labelled spots of two labels."""
    pairs = cut(labelled(truth, domains))
    t, p = pairs.select("spot_id", F.col("t").alias("label")), pairs.select("spot_id", F.col("p").alias("label"))
    inner = cut(graph.edge_subset(edges, pairs))
    ends = concordance.boundary_scores(graph.boundary_mask(inner, t), graph.boundary_mask(inner, p))
    cloud = points.select("id", "h").join(p.withColumnRenamed("spot_id", "id"), "id")
    enough = pairs.agg(F.count("*").alias("n"), F.count_distinct("t").alias("c")).where("n >= 2 AND c >= 2")
    one = enough.select(
        concordance.nmi(pairs).scalar().alias("nmi"), concordance.weighted_dice(pairs).scalar().alias("dice"),
        spatial.silhouette(cloud).scalar().alias("silhouette"), spatial.calinski_harabasz(cloud).scalar().alias("ch"),
    )
    return one.select("*", *(ends.select(x).scalar().alias(x) for x in ("precision", "recall", "f1")))


def boundary_quality(edges: DataFrame, truth: DataFrame, found: DataFrame) -> DataFrame:
    """precision, recall, f1 of found boundaries (labels: spot_id, label), n_true and n_found boundary spots, and
    contiguity: the share of spots that lie in the largest connected part of their found domain."""
    a, b = cut(graph.boundary_mask(edges, truth)), cut(graph.boundary_mask(edges, found))
    parts = graph.domain_components(edges, found).groupBy("label").agg(F.max("size").alias("top"), F.sum("size").alias("n"))
    whole = parts.agg((F.sum("top") / F.sum("n")).alias("contiguity"))
    n = lambda df, name: df.agg(F.count("*")).scalar().alias(name)
    return concordance.boundary_scores(a, b).select("*", n(a, "n_true"), n(b, "n_found"), whole.scalar().alias("contiguity"))


def factor_rank(rows: DataFrame, k: int) -> int:
    """The rank of the scores (spot_id, h) from their Gram matrix, whose singular values are squares of theirs."""
    import numpy as np

    g = linalg.gram_of(rows, "h", k)
    values = np.sqrt(np.maximum(np.linalg.eigvalsh(g), 0.0))
    n = rows.count()
    # A Gram matrix holds half the digits, so what is below its own resolution counts as 0.
    return int((values > values.max(initial=0.0) * max(np.sqrt(np.finfo(float).eps * k), max(n, k) * np.finfo(float).eps)).sum())


def loading_sparsity(loadings: DataFrame) -> DataFrame:
    """zero_share: the share of loadings (gene_id, k, w) that are 0, up to 1e-12."""
    return loadings.agg(F.coalesce(F.avg((F.abs("w") <= 1e-12).cast("double")), F.lit(0e0)).alias("zero_share"))


def donor_safe_join(spots: DataFrame, layers: DataFrame, donor: str, least: float = 0.5) -> DataFrame:
    """status, overlap, coverage, n_joined, n_layers, ari, nmi of domains of spots (barcode, label) against layers
    (barcode, sample_id, layer) of the same donor.

    One list of barcodes serves all slides, so barcodes meet also where tissues don't: without a sample of the donor
    (its name in sample_id) the join is refused, as it is below the least coverage or with less than two joined spots;
    then no score is given.
    """
    mine = layers.where(F.contains("sample_id", F.lit(donor))).groupBy("barcode").agg(F.max_by("layer", "sample_id").alias("t"))
    known = spots.select("barcode").distinct().join(layers.select("barcode").distinct(), "barcode").agg(F.count("*").alias("overlap"))
    pairs = cut(spots.select("barcode", F.col("label").alias("p")).join(mine, "barcode"))
    seen = spots.agg(F.count_distinct("barcode").alias("n"))
    one = seen.select("n", known.scalar().alias("overlap"), pairs.agg(F.count("*")).scalar().alias("joined"), pairs.agg(F.count_distinct("t")).scalar().alias("layers"), mine.agg(F.count("*")).scalar().alias("samples"))
    coverage = F.col("overlap") / F.greatest("n", F.lit(1))
    status = F.when(F.col("samples") == 0, "blocked: other donor").when(coverage < least, "blocked: coverage").when(F.col("joined") < 2, "blocked: fewer than two spots").otherwise("ok")
    ok = status == "ok"
    return one.select(
        status.alias("status"), "overlap", coverage.alias("coverage"), F.when(ok, F.col("joined")).alias("n_joined"), F.when(ok, F.col("layers")).alias("n_layers"),
        F.when(ok, concordance.ari(pairs).scalar()).alias("ari"), F.when(ok, concordance.nmi(pairs).scalar()).alias("nmi"),
    )


def chaos_null(spots: DataFrame, labels: DataFrame, shuffles: int = 10, seed: int = 0) -> DataFrame:
    """chaos, null_mean, delta (null less observed; larger is better); all shuffles in one search of neighbours.

    CHAOS is the mean over labels of the mean distance to the nearest spot of the label, over that to the nearest of
    all; a shuffle's labels are groups of their own.
    """
    near_all = graph.knn(spots, 1, by_section=False).agg(F.avg(F.sqrt("d2")))
    base = F.coalesce(near_all.scalar(), F.lit(1e0))
    base = F.when(base == 0, 1e0).otherwise(base)
    shuffled = spatial.permuted(labels, max(1, shuffles), seed).join(spots.select("spot_id", "x", "y"), "spot_id")
    n = max(1, shuffles)
    rows = cut(shuffled.select((F.col("spot_id") * n + F.col("b")).alias("spot_id"), "b", "label", "x", "y", F.xxhash64("b", F.col("label").cast("string")).alias("section_id")))
    near = graph.knn(rows, 1).join(rows.select(F.col("spot_id").alias("src"), "b", "label"), "src")
    per = near.groupBy("b", "label").agg(F.avg(F.sqrt("d2")).alias("m")).groupBy("b").agg((F.avg("m") / base).alias("v"))
    null = per.agg(F.avg("v")).scalar()
    return spatial.chaos(spots, labels).select("chaos", null.alias("null_mean")).withColumn("delta", F.col("null_mean") - F.col("chaos"))


def order_bins(values: DataFrame, by: tuple[str, ...], value: str, bins: int) -> DataFrame:
    """values with bin: rank * bins div size, of the rank by value, then spot_id, in its group."""
    return ranked(values, (value, "spot_id"), by, name="r", size="m").withColumn("bin", F.expr(f"(r * {int(bins)}L) div m")).drop("r", "m")


def accuracy_ambiguity(accuracy: DataFrame, ambiguity: DataFrame) -> DataFrame:
    """dataset, ari, ambiguity of datasets that have both as finite numbers, by dataset."""
    ok = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    both = accuracy.select("dataset", F.col("ari").cast("double")).join(ambiguity.select("dataset", F.col("ambiguity").cast("double")), "dataset")
    return both.where(ok("ari") & ok("ambiguity")).orderBy("dataset")
