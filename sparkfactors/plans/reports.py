"""Rankings, summaries and tables over runs: rows (dataset, variant, seed, metrics...) or (method, seed, ...)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def leaderboard(scores: DataFrame, primary: str) -> DataFrame:
    """scores (variant, metrics...) ranked by primary, largest first; unrankable last, then by name."""
    v = F.when(F.isnan(primary), None).otherwise(F.col(primary))
    return scores.withColumn("rank", F.row_number().over(Window.orderBy(v.desc_nulls_last(), "variant")).cast("long"))


def cell_means(records: DataFrame, metrics: tuple[str, ...]) -> DataFrame:
    """dataset, variant, metric, mean over seeds."""
    long = records.unpivot(["dataset", "variant"], list(metrics), "metric", "value")
    return long.groupBy("dataset", "variant", "metric").agg(F.avg("value").alias("mean")).where("mean IS NOT NULL")


def average_ranks(cells: DataFrame) -> DataFrame:
    """cells with the variant's rank in its dataset and metric, largest first, ties sharing their mean rank."""
    r = F.rank().over(Window.partitionBy("dataset", "metric").orderBy(F.desc("mean")))
    ties = F.count("*").over(Window.partitionBy("dataset", "metric", "mean"))
    return cells.withColumn("rank", r + (ties - 1) / 2e0)


def mean_ranks(cells: DataFrame) -> DataFrame:
    return average_ranks(cells).groupBy("variant").agg(F.avg("rank").alias("mean_rank"), F.count("*").alias("cells"))


def mean_std(records: DataFrame, by: tuple[str, ...], metrics: tuple[str, ...]) -> DataFrame:
    """by, metric, mean, std (population), n."""
    long = records.unpivot(list(by), list(metrics), "metric", "value").where("value IS NOT NULL")
    return long.groupBy(*by, "metric").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.count("*").alias("n"))


def box_series(records: DataFrame, by: tuple[str, ...], metric: str) -> DataFrame:
    """by and the five numbers of a boxplot."""
    return records.groupBy(*by).agg(F.expr(f"percentile({metric}, array(0, 0.25, 0.5, 0.75, 1))").alias("box"))


def sweep_summary(sweep: DataFrame) -> DataFrame:
    """lam, mean_ari, std_ari (population), smooth_fraction (of the lowest seed) of rows (lam, seed, ari, smooth_fraction)."""
    return sweep.groupBy("lam").agg(F.avg("ari").alias("mean_ari"), F.stddev_pop("ari").alias("std_ari"), F.min_by("smooth_fraction", "seed").alias("smooth_fraction"))


def recommend_lam(summary: DataFrame, stable: float = 0.05) -> DataFrame:
    """The lam of largest mean_ari among those with std_ari up to stable; without one, of all, flagged."""
    ok = F.coalesce(F.col("std_ari") <= stable, F.lit(False))
    return summary.withColumn("stable", ok).orderBy(F.desc("stable"), F.col("mean_ari").desc_nulls_last(), "lam").limit(1)


def regression(points: DataFrame) -> DataFrame:
    """r, slope, intercept of pairs (x, y) of finite numbers; null for less than two or without spread in x (r: or y)."""
    p = points.where("x IS NOT NULL AND y IS NOT NULL AND NOT isnan(x) AND NOT isnan(y) AND abs(x) < double('inf') AND abs(y) < double('inf')")
    s = p.agg(F.count("*").cast("double").alias("n"), *(F.sum(e).alias(a) for a, e in (("sx", F.col("x")), ("sy", F.col("y")), ("xx", F.col("x") * F.col("x")), ("yy", F.col("y") * F.col("y")), ("xy", F.col("x") * F.col("y")))))
    cxy, cxx, cyy = (F.col(a) - F.try_divide(F.col(b) * F.col(c), "n") for a, b, c in (("xy", "sx", "sy"), ("xx", "sx", "sx"), ("yy", "sy", "sy")))
    flat = lambda v, raw: v <= 1e-12 * F.col(raw)
    slope = F.when((F.col("n") >= 2) & ~flat(cxx, "xx"), F.try_divide(cxy, cxx))
    r = F.when((F.col("n") >= 2) & ~flat(cxx, "xx") & ~flat(cyy, "yy"), F.try_divide(cxy, F.sqrt(cxx * cyy)))
    return s.select(r.alias("r"), slope.alias("slope"), F.try_divide(F.col("sy") - slope * F.col("sx"), "n").alias("intercept"))


def coassociation(runs: DataFrame, n_runs: int, digits: int | None = None, block: int = 8192) -> DataFrame:
    """i < j, share of runs (run, spot_id, label) that put both spots under one label; pairs that never meet are left
    out. The result is the square of a label's size, as the matrix is; no pair of spots is shuffled.

    Spots with the same labels in all runs have the same shares, so they travel in packs, of which each has spots of one
    of the blocks of about `block`. Two packs meet at every label they share and are unfolded at the first of them.
    digits: shares are rounded to so many, once for two packs.
    """
    told = runs.where("run IS NOT NULL AND label IS NOT NULL AND spot_id IS NOT NULL").groupBy("spot_id", "run", "label").agg(F.count("*").alias("m"))
    spots = told.groupBy("spot_id").agg(F.sort_array(F.collect_list(F.struct("run", "label", "m"))).alias("p"))
    n = spots.count()
    blocks = n // block + 1
    salts, tasks = min(blocks, 16), min(1024, 8 + n // 512)
    own = F.pmod(F.xxhash64("spot_id"), F.lit(blocks)).alias("block")
    packs = spots.groupBy("p", own).agg(F.min("spot_id").alias("first"), F.collect_list("spot_id").alias("ids"))
    left = packs.select(F.explode("p").alias("at"), F.pmod("block", F.lit(salts)).cast("int").alias("salt"), "first", "p", "ids").select("at.run", "at.label", "salt", "first", "p", "ids")
    right = packs.select(F.explode("p").alias("at"), F.col("first").alias("first2"), F.col("p").alias("p2"), F.col("ids").alias("ids2"))
    right = right.select("at.run", "at.label", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"), "first2", "p2", "ids2")
    keys = ["run", "label", "salt"]
    # A number of partitions that is given stays: by their bytes, the packs would be coalesced into few tasks.
    met = left.repartition(tasks, *keys).join(right.repartition(tasks, *keys), keys).where("first <= first2")
    alike = lambda x, y: (x["run"] == y["run"]) & (x["label"] == y["label"])
    shared = F.filter("p", lambda x: F.exists("p2", lambda y: alike(x, y)))
    met = met.where((shared[0]["run"] == F.col("run")) & (shared[0]["label"] == F.col("label")))
    both = F.aggregate("p", F.lit(0).cast("long"), lambda s, x: s + F.aggregate("p2", F.lit(0).cast("long"), lambda t, y: t + F.when(alike(x, y), x["m"] * y["m"]).otherwise(0)))
    share = both / F.lit(float(n_runs))
    share = share if digits is None else F.round(share, digits)
    met = met.select(share.alias("share"), (F.col("first") == F.col("first2")).alias("one"), F.explode("ids").alias("i"), "ids2")
    met = met.select("share", "one", "i", F.explode("ids2").alias("j")).where("NOT one OR i < j")
    return met.select(F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"), "share")


def survival(reference: DataFrame, runs: DataFrame, n_runs: int) -> DataFrame:
    """label, survival: mean co-association of pairs of spots that the reference (spot_id, label) puts together.

    Without listing pairs: in a run, a reference label whose spots fall into groups of sizes m has sum of m (m - 1) / 2
    agreeing pairs. Null for labels of one spot.
    """
    size = reference.groupBy("label").agg(F.count("*").cast("double").alias("n"))
    parts = reference.join(runs.select("run", "spot_id", F.col("label").alias("g")), "spot_id").groupBy("label", "run", "g").agg(F.count("*").cast("double").alias("m"))
    agree = parts.groupBy("label").agg(F.sum(F.col("m") * (F.col("m") - 1)).alias("pairs"))
    return size.join(agree, "label").select("label", F.try_divide(F.col("pairs"), F.col("n") * (F.col("n") - 1) * n_runs).alias("survival"))


def method_summary(metrics: DataFrame, stability: DataFrame) -> DataFrame:
    """method, means over seeds of coherence_delta, ari, nmi, ami, the number of seeds, stability."""
    m = metrics.groupBy("method").agg(*(F.avg(x).alias(x) for x in ("coherence_delta", "ari", "nmi", "ami")), F.count("*").alias("n_seeds"))
    return m.join(stability, "method", "left")


def scorecard_points(summary: DataFrame) -> DataFrame:
    """method, x (mean of coherence and stability), y (ari) of methods with a stability."""
    return summary.where("stability IS NOT NULL").select("method", ((F.col("coherence_delta") + F.col("stability")) / 2).alias("x"), F.col("ari").alias("y"))


def integration_scorecard(section_before, section_after, domain_before, domain_after) -> DataFrame:
    """From four one-row silhouettes: mixing, mixing_gain, conservation, conservation_gain, overall (mean of the means of
    the two groups that can be computed)."""
    unit = lambda df: (df.scalar() + 1e0) / 2e0
    clamp = lambda v: F.greatest(F.least(v, F.lit(1e0)), F.lit(0e0))
    one = section_before.sparkSession.range(1)
    sb, sa, db, da = (unit(x) for x in (section_before, section_after, domain_before, domain_after))
    s = one.select(
        (1 - sa).alias("mixing"), F.when(sa.isNotNull() & sb.isNotNull(), clamp(sb - sa)).alias("mixing_gain"), da.alias("conservation"),
        F.when(da.isNotNull() & db.isNotNull(), clamp(da - db)).alias("conservation_gain"),
    )
    return s.withColumn("overall", mean_of(mean_of(F.col("mixing"), F.col("mixing_gain")), mean_of(F.col("conservation"), F.col("conservation_gain"))))


def mean_of(*values: Column) -> Column:
    """The mean of those that are not null."""
    n = sum((v.isNotNull().cast("int") for v in values), F.lit(0))
    return F.try_divide(sum((F.coalesce(v, F.lit(0e0)) for v in values), F.lit(0e0)), n)


def pivot_sections(per_section: DataFrame) -> DataFrame:
    """A row per section, a column per variant, of (section_id, variant, ari)."""
    return per_section.groupBy("section_id").pivot("variant").agg(F.first("ari")).orderBy("section_id")
