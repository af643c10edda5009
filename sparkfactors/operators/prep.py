"""Preprocessing of sparse counts (spot_id, gene_id, value; zeros left out) and of long columns (spot_id, key, v)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def looks_raw(expr: DataFrame, rows: int = 100) -> DataFrame:
    """raw: whether a value is over 50, or the first `rows` spots by id hold whole numbers alone."""
    first = expr.select("spot_id").distinct().orderBy("spot_id").limit(rows)
    near = F.abs(F.col("value") - F.round("value")) <= 1e-8 + 1e-5 * F.abs(F.round("value"))
    whole = expr.join(F.broadcast(first), "spot_id").agg(F.bool_and(near))
    return expr.agg((F.coalesce(F.max("value") > 50, F.lit(False)) | F.coalesce(whole.scalar(), F.lit(True))).alias("raw"))


def normalize_total(expr: DataFrame, target: float = 1e4) -> DataFrame:
    """Values scaled so that each spot's sum is target; spots that sum to 0 stay."""
    total = expr.groupBy("spot_id").agg(F.sum("value").alias("total"))
    return expr.join(total, "spot_id").select("spot_id", "gene_id", F.when(F.col("total") == 0, F.col("value")).otherwise(F.col("value") / F.col("total") * target).alias("value"))


def log1p(expr: DataFrame) -> DataFrame:
    return expr.withColumn("value", F.log1p("value"))


def total_log1p(expr: DataFrame) -> DataFrame:
    """As normalize_total with the median of positive sums as target, then log1p."""
    total = expr.groupBy("spot_id").agg(F.sum("value").alias("total"))
    target = total.where("total > 0").agg(F.expr("median(total)").alias("m"))
    scaled = F.col("value") / F.greatest("total", F.lit(1e-12)) * F.coalesce(target.scalar(), F.lit(1e0))
    return expr.join(total, "spot_id").select("spot_id", "gene_id", F.log1p(scaled).alias("value"))


SCHEMES = {"none": lambda e: e, "log1p": log1p, "cp_target": lambda e: log1p(normalize_total(e)), "total_log1p": total_log1p}


def gene_moments(expr: DataFrame, n_spots: DataFrame) -> DataFrame:
    """gene_id, mean, var (population), zeros counted. n_spots: one row, one column."""
    n = n_spots.scalar().cast("double")
    s = expr.groupBy("gene_id").agg(F.sum("value").alias("s"), F.sum(F.col("value") * F.col("value")).alias("ss"))
    return s.select("gene_id", (F.col("s") / n).alias("mean"), F.greatest(F.col("ss") / n - F.col("s") / n * (F.col("s") / n), F.lit(0e0)).alias("var"))


def top_variance_genes(expr: DataFrame, n_spots: DataFrame, n: int) -> DataFrame:
    """gene_id, var, rank of the n genes of largest variance; ties to the smaller gene."""
    top = gene_moments(expr, n_spots).withColumn("var", F.round("var", 9)).orderBy(F.desc("var"), "gene_id").limit(n)
    return top.select("gene_id", "var", F.row_number().over(Window.orderBy(F.desc("var"), "gene_id")).cast("long").alias("rank"))


def dispersion_genes(expr: DataFrame, n_spots: DataFrame, n: int, bins: int = 20) -> DataFrame:
    """gene_id, score of the n genes whose log dispersion stands out most among genes of similar mean (the published
    recipe of equal-width bins of the log mean and z-scores in a bin; bins of one gene score 1)."""
    m = gene_moments(expr, n_spots).where("mean > 0").select("gene_id", F.log1p("mean").alias("m"), F.log(F.greatest(F.col("var"), F.lit(1e-12)) / F.col("mean")).alias("d"))
    ends = m.agg(F.min("m").alias("lo"), F.max("m").alias("hi"))
    lo, hi = ends.select("lo").scalar(), ends.select("hi").scalar()
    b = m.withColumn("bin", F.least(F.floor((F.col("m") - lo) / F.greatest(hi - lo, F.lit(1e-12)) * bins), F.lit(bins - 1)))
    s = b.groupBy("bin").agg(F.avg("d").alias("md"), F.stddev("d").alias("sd"))
    z = F.when(F.col("sd").isNull(), 1e0).otherwise(F.coalesce(F.try_divide(F.col("d") - F.col("md"), "sd"), F.lit(0e0)))
    return b.join(s, "bin").select("gene_id", z.alias("score")).orderBy(F.desc("score"), "gene_id").limit(n)


def zscore(values: DataFrame, key: str, flat: str = "one", floor: float = 1e-6) -> DataFrame:
    """(v - mean) / population deviation per key. Constant keys: flat 'floor' divides by at least floor, 'one' by 1,
    'zero' makes them 0."""
    m = values.groupBy(key).agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("sd"))
    x = F.col("v") - F.col("m")
    z = {
        "floor": x / F.greatest("sd", F.lit(floor)),
        "one": x / F.when(F.col("sd") == 0, 1e0).otherwise(F.col("sd")),
        "zero": F.when(F.col("sd") == 0, 0e0).otherwise(F.try_divide(x, "sd")),
    }[flat]
    return values.join(m, key).select("spot_id", key, z.alias("v"))


def positive_basis(scores: DataFrame, k: int) -> DataFrame:
    """The first k factors (k is the factor's number), shifted to minimum 0 and divided by their deviation; 0 if flat."""
    s = scores.where(F.col("k") < k)
    m = s.groupBy("k").agg(F.min("v").alias("lo"), F.stddev_pop("v").alias("sd"))
    return s.join(m, "k").select("spot_id", "k", F.when(F.col("sd") < 1e-12, 0e0).otherwise(F.try_divide(F.col("v") - F.col("lo"), "sd")).alias("v"))


def canonical_gauge(scores: DataFrame, loadings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Scores (spot_id, k, v) and loadings (gene_id, k, w) with each factor's loadings of length 1 and the length moved
    to the scores; factors without loadings stay."""
    length = loadings.groupBy("k").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("s")).withColumn("s", F.when(F.col("s") == 0, 1e0).otherwise(F.col("s")))
    return scores.join(length, "k").select("spot_id", "k", (F.col("v") * F.col("s")).alias("v")), loadings.join(length, "k").select("gene_id", "k", (F.col("w") / F.col("s")).alias("w"))


def variance_explained(scores: DataFrame) -> DataFrame:
    """k, share of the factors' summed population variance; 0 if there is none."""
    v = scores.groupBy("k").agg(F.var_pop("v").alias("var"))
    total = v.agg(F.sum("var").alias("t"))
    return v.select("k", F.coalesce(F.try_divide("var", total.scalar()), F.lit(0e0)).alias("share"))


def section_gate(scores: DataFrame, spots: DataFrame, first_private: int) -> DataFrame:
    """Private factors (from first_private on) are 0 outside their section: number k of them belongs to the section of
    rank k modulo the number of sections."""
    rank = spots.select("section_id").distinct().select("section_id", (F.row_number().over(Window.orderBy("section_id")) - 1).alias("s"), F.count("*").over(Window.partitionBy(F.lit(0))).alias("n"))
    where = spots.select("spot_id", "section_id").join(rank, "section_id").select("spot_id", "s", "n")
    own = F.pmod(F.col("k") - first_private, F.col("n")) == F.col("s")
    return scores.join(where, "spot_id").select("spot_id", "k", F.when((F.col("k") < first_private) | own, F.col("v")).otherwise(0e0).alias("v"))
