"""Permutation nulls, claim gates, evaluation policy and the choice of the number of factors."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..checkpoints import cut
from ..functions import concordance, spatial
from ..functions.concordance import has_label
from ..operators.graph import hash_unit
from ..operators.models import coordinate_domains, plain_nmf


def null_summary(observed: DataFrame, null: DataFrame, value: str) -> DataFrame:
    """observed, null_mean, null_std (population), z, p from one observed value and one value per shuffle.

    z of a null without spread is 0, or infinite in the sign of the difference; p is (1 + at least as large) / (1 + all).
    """
    o = observed.select(F.col(value).alias("o")).scalar()
    s = null.agg(F.avg(value).alias("null_mean"), F.stddev_pop(value).alias("null_std"), F.count_if(F.col(value) >= o).alias("ge"), F.count("*").alias("n"))
    d = o - F.col("null_mean")
    z = F.when(F.col("null_std") > 0, F.try_divide(d, "null_std")).when(d == 0, 0e0).otherwise(F.signum(d) * float("inf"))
    return s.select(o.alias("observed"), "null_mean", "null_std", z.alias("z"), ((1e0 + F.col("ge")) / (1e0 + F.col("n"))).alias("p"))


def permutation_null(labels: DataFrame, edges: DataFrame, metric: str = "coherence", shuffles: int = 199, seed: int = 0) -> DataFrame:
    """null_summary of 'coherence' (labels: spot_id, label) or 'morans_i' (label is a number); all shuffles in one job."""
    shuffled = spatial.permuted(labels, max(1, shuffles), seed)
    if metric == "coherence":
        return null_summary(spatial.coherence(labels, edges), spatial.coherence(shuffled, edges, ("b",)), "coherence")
    if metric == "morans_i":
        v = lambda df, key: df.select("spot_id", key, F.col("label").cast("double").alias("v"))
        return null_summary(spatial.morans_i(v(labels.withColumn("b", F.lit(0)), "b"), edges, "b"), spatial.morans_i(v(shuffled, "b"), edges, "b"), "i")
    raise ValueError(f"unknown metric {metric!r}")


def pas_null(labels: DataFrame, neighbours: DataFrame, shuffles: int = 10, seed: int = 0) -> DataFrame:
    """pas, null_mean, delta (null less observed; larger is better)."""
    null = spatial.pas(spatial.permuted(labels, shuffles, seed), neighbours, ("b",)).agg(F.avg("pas").alias("null_mean"))
    return spatial.pas(labels, neighbours).withColumn("null_mean", null.scalar()).withColumn("delta", F.col("null_mean") - F.col("pas"))


def coordinate_leakage(labels: DataFrame, spots: DataFrame, seed: int = 0) -> DataFrame:
    """ari of the labels with as many clusters of the coordinates alone."""
    k = labels.select("label").distinct().count()
    found = coordinate_domains(spots, max(1, k), seed)
    return concordance.ari(labels.withColumnRenamed("label", "t").join(found.withColumnRenamed("domain_id", "p"), "spot_id"))


def claim_gate(calibration: DataFrame, leak_ari: float | None, *, checked: bool = True, derived: bool = False, margin: float = 0.1, z: float = 3.0, leak: float = 0.5) -> DataFrame:
    """passed, reason and the calibration: the observed value must exceed its null by margin and z, and labels must not
    follow from coordinates (derived, or leak_ari from leak on); unchecked labels don't pass."""
    where = (
        "labels derive from coordinates" if derived else "coordinate leakage was not checked" if not checked
        else f"coordinates alone give the labels (ARI {leak_ari:.3f})" if leak_ari is not None and leak_ari >= leak else None
    )
    reasons = F.concat_ws(
        "; ",
        F.when(F.col("observed") - F.col("null_mean") < margin, F.lit(f"margin over the null below {margin}")),
        F.when(F.col("z") < z, F.lit(f"z below {z}")),
        F.lit(where),
    )
    return calibration.withColumn("reason", reasons).withColumn("passed", F.col("reason") == "").withColumn("leak_ari", F.lit(leak_ari).cast("double"))


def ground_truth(spots: DataFrame) -> DataFrame:
    """gt_present (two labelled spots at least), n_classes, n_labeled of spots (spot_id, gt)."""
    ok = has_label(F.col("gt"))
    s = spots.agg(F.count_if(ok).alias("n_labeled"), F.count_distinct(F.when(ok, F.trim(F.col("gt").cast("string")))).alias("n_classes"))
    return s.select((F.col("n_labeled") >= 2).alias("gt_present"), "n_classes", "n_labeled")


def eval_policy(truth: DataFrame, dataset_class: str | None = None) -> DataFrame:
    """dataset_class, source, emitted, reason: metrics against ground truth only for class A with two classes at least."""
    if dataset_class not in (None, "A", "B"):
        raise ValueError(f"unknown dataset class {dataset_class!r}")
    usable = F.col("gt_present") & (F.col("n_classes") >= 2)
    cls = F.lit(dataset_class) if dataset_class else F.when(usable, "A").otherwise("B")
    source = F.lit("explicit" if dataset_class else "inferred")
    emitted = (cls == "A") & usable
    reason = F.when(emitted, F.format_string("class %s (%s), %d classes: emitted", cls, source, F.col("n_classes"))).when(
        cls != "A", F.format_string("class %s (%s) is not A: suppressed", cls, source)
    ).otherwise(F.format_string("class %s (%s) without usable ground truth: suppressed", cls, source))
    return truth.select(cls.alias("dataset_class"), source.alias("source"), emitted.alias("emitted"), reason.alias("reason"))


def knee(errors: DataFrame, least: float = 0.05) -> DataFrame:
    """errors (pos, k, error) in order: the k of the last step of an unbroken run of drops of at least `least` of the
    error before. One row per candidate."""
    order = Window.orderBy("pos")
    before = F.lag("error").over(order)
    ok = F.when(F.col("pos") == F.min("pos").over(Window.partitionBy(F.lit(0))), True).otherwise((before > 0) & (F.coalesce(F.try_divide(before - F.col("error"), F.abs(before)), F.lit(-1e0)) >= least))
    run = errors.withColumn("ok", ok).withColumn("all", F.bool_and("ok").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return run.where("all").agg(F.max_by("k", "pos").alias("k"))


def holdout(spots: DataFrame, share: float, seed: int = 0) -> tuple[DataFrame, DataFrame, int]:
    """Training and test spots: the first round(share n) of a hashed order are the test, one at least."""
    ids = cut(spots.select("spot_id"))
    n_test = max(1, round(share * ids.count()))
    test = cut(ids.orderBy(hash_unit(seed, F.col("spot_id")), "spot_id").limit(n_test))
    return ids.join(test, "spot_id", "left_anti"), test, n_test


def refit_holdout_error(expr: DataFrame, h: DataFrame, k: int, spots: DataFrame, share: float = 0.2, seed: int = 0) -> float:
    """Error on test spots of loadings refitted on the others by least squares, cut at 0; 0 if no split is possible.

    h (spot_id, h) was fitted on all spots, so this is no true hold-out.
    """
    import numpy as np

    from ..operators import linalg

    train, test, n_test = holdout(spots, share, seed)
    if spots.count() < 2 or n_test >= spots.count():
        return 0.0
    a = h.join(train, "spot_id")
    g = np.linalg.pinv(linalg.gram_of(a, "h", k))
    b = expr.join(a, "spot_id").groupBy("gene_id").agg(*linalg.sum_vector("h", k, F.col("value").cast("double"))).select("gene_id", F.array(*(F.col(f"x{i}") for i in range(k))).alias("b"))
    w = b.select("gene_id", F.array(*(F.greatest(c, F.lit(0e0)) for c in linalg.times(F.col("b"), g))).alias("w"))
    from ..functions.factors import reconstruction_error
    from ..operators.models import long_loadings, long_scores

    return reconstruction_error(expr.join(test, "spot_id"), long_scores(h.join(test, "spot_id")), long_loadings(w)).first()[0]


def select_n_factors(expr: DataFrame, spots: DataFrame, n_genes: int, ks: list[int], *, share: float = 0.2, least: float = 0.05, seed: int = 0, fit: Callable | None = None, n_iter: int = 50) -> tuple[int, list[float]]:
    """The knee of refit_holdout_error over ks in the order given, and the errors. fit(expr, spots, n_genes, k, seed)
    returns (spot_id, h); plain NMF by default."""
    if not ks:
        raise ValueError("no candidates")
    fit = fit or (lambda e, s, g, k, r: plain_nmf(e, s, g, k, n_iter=n_iter, seed=r).h)
    errors = [refit_holdout_error(expr, fit(expr, spots, n_genes, k, seed), k, spots, share, seed) for k in ks]
    table = spots.sparkSession.createDataFrame([(i, k, float(e)) for i, (k, e) in enumerate(zip(ks, errors, strict=True))], "pos int, k int, error double")
    return knee(table, least).first()[0], errors


def finite(v: Column) -> Column:
    """v, null if it is not a finite number."""
    v = v.cast("double")
    return F.when(F.isnan(v) | (F.abs(v) == float("inf")), None).otherwise(v)
