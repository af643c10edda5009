"""Reports of labelings and factors over many datasets: accuracy, coherence and interpretability of factors, lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..checkpoints import cut
from ..functions import concordance
from ..functions.concordance import has_label
from ..functions.factors import top_gene_mass

#: Metrics that domain comparisons show (fixed values).
DOMAIN_METRICS = ("ari_domain", "nmi_domain", "boundary_f1_domain", "weighted_dice_domain", "silhouette_domain")
REFERENCE_VARIANTS = ("coords", "spatial_smooth")


def domain_accuracy(labels: DataFrame) -> DataFrame:
    """dataset, variant, ari, nmi, ami in order of names, for labels (dataset, variant, t, p) of all datasets and variants
    at once; rows whose t says nothing are left out, and what can't be evaluated is null."""
    named = labels.where(has_label(F.col("t")))
    every = labels.select("dataset", "variant").distinct()
    scored = every.join(concordance.accuracy_sets(named, ("dataset", "variant")), ["dataset", "variant"], "left")
    return scored.select("dataset", "variant", "ari", "nmi", "ami").orderBy("dataset", "variant")


def finite(v: Column) -> Column:
    x = v.try_cast("double")
    return F.when(x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")), x)


def accuracy_records(spark: SparkSession, path: str) -> DataFrame:
    """dataset, variant, ari, nmi, ami of a JSON file dataset -> variant -> metrics, in order of names; a metric that is
    absent, a bool or no finite number is null. A file of {} gives no rows."""
    text = spark.read.text(path, wholetext=True)
    deep = text.select(F.explode(F.from_json("value", "map<string,map<string,map<string,string>>>")).alias("dataset", "v"))
    rows = deep.select("dataset", F.explode("v").alias("variant", "m"))
    return rows.select("dataset", "variant", *(finite(F.try_element_at("m", F.lit(k))).alias(k) for k in ("ari", "nmi", "ami"))).orderBy("dataset", "variant")


def baseline_scores(records: DataFrame, dataset: str) -> DataFrame:
    """variant, ari of the reference variants of a dataset, or where it isn't there of the first one; those without a
    finite number are left out."""
    names = records.agg(F.coalesce(F.max(F.when(F.col("dataset") == dataset, F.col("dataset"))), F.min("dataset")))
    own = records.where((F.col("dataset") == names.scalar()) & F.col("variant").isin(*REFERENCE_VARIANTS))
    return own.where("ari IS NOT NULL").select("variant", "ari")


def domain_metrics(metrics: DataFrame, keys: tuple[str, ...] = DOMAIN_METRICS) -> DataFrame:
    """One row per run (method, seed) with a column for each key of metrics (method, seed, name, value); null for what is
    absent or no finite number."""
    picked = [F.max(F.when(F.col("name") == k, finite(F.col("value").cast("string")))).alias(k) for k in keys]
    return metrics.groupBy("method", "seed").agg(*picked)


def summaries_to_scores(summary: DataFrame) -> tuple[DataFrame, DataFrame]:
    """From rows (dataset, variant, ari, nmi, ami, stability): scorecard points (dataset, variant, accuracy, stability)
    of those with a stability, and the accuracy of all as a map variant -> metrics for each dataset."""
    ok = lambda c: finite(F.col(c).cast("string")).alias(c)
    clean = summary.select("dataset", "variant", ok("ari"), ok("nmi"), ok("ami"), ok("stability"))
    points = clean.where("stability IS NOT NULL").select("dataset", "variant", F.col("ari").alias("accuracy"), "stability")
    entries = F.array_sort(F.collect_list(F.struct("variant", F.struct("ari", "nmi", "ami"))))
    return points, clean.groupBy("dataset").agg(F.map_from_entries(entries).alias("accuracy"))


def _moments(rows: DataFrame, k: int) -> DataFrame:
    """factor, n, mean, m2, m4 (central sums) and max_redundancy (largest absolute correlation with another factor) of
    scores (spot_id, h), in two passes: means, then products about them."""
    mean = rows.agg(F.count("*").alias("n"), *(F.avg(F.get("h", i)).alias(f"m{i}") for i in range(k)))
    c = [F.get("h", i) - mean.select(f"m{i}").scalar() for i in range(k)]
    centred = rows.select(*(v.alias(f"c{i}") for i, v in enumerate(c)))
    x = [F.col(f"c{i}") for i in range(k)]
    sums = centred.agg(
        F.count("*").alias("n"), *(F.sum(x[i] * x[j]).alias(f"p{i}_{j}") for i in range(k) for j in range(i, k)), *(F.sum(x[i] * x[i] * x[i] * x[i]).alias(f"q{i}") for i in range(k))
    )
    p = lambda i, j: F.col(f"p{min(i, j)}_{max(i, j)}")
    corr = lambda i, j: F.least(F.abs(p(i, j)) / F.greatest(F.sqrt(p(i, i) * p(j, j)), F.lit(1e-12)), F.lit(1e0))
    largest = lambda i: F.array_max(F.array(*(corr(i, j) for j in range(k) if j != i))) if k > 1 else F.lit(None).cast("double")
    each = F.array(*(F.struct(F.lit(i).alias("factor"), F.col("n"), p(i, i).alias("m2"), F.col(f"q{i}").alias("m4"), largest(i).alias("max_redundancy")) for i in range(k)))
    return sums.select(F.inline(each))


def _spatial(rows: DataFrame, edges: DataFrame, k: int) -> DataFrame:
    """factor, cross (sum over edges of centred products), and w, s1, s2 of the graph: one pass over the edges for all
    factors. Edges are a bag; both directions of a pair count in its weight."""
    mean = rows.agg(*(F.avg(F.get("h", i)).alias(f"m{i}") for i in range(k)))
    centred = cut(rows.select("spot_id", F.array(*(F.get("h", i) - mean.select(f"m{i}").scalar() for i in range(k))).alias("h")))
    a, b = centred.toDF("src", "hs"), centred.toDF("dst", "hd")
    cross = edges.join(a, "src").join(b, "dst").agg(*(F.sum(F.get("hs", i) * F.get("hd", i)).alias(f"x{i}") for i in range(k)))
    pair = edges.groupBy(F.least("src", "dst").alias("u"), F.greatest("src", "dst").alias("v")).agg(F.count("*").cast("double").alias("m"))
    # S1 sums (w_ij + w_ji) squared over ordered pairs, halved; on the diagonal a loop has twice its weight.
    s1 = pair.agg(F.sum(F.when(F.col("u") == F.col("v"), 2 * F.col("m") * F.col("m")).otherwise(F.col("m") * F.col("m"))).alias("s1"), F.sum("m").alias("w"))
    ends = edges.select(F.explode(F.array("src", "dst")).alias("spot_id")).groupBy("spot_id").agg(F.count("*").cast("double").alias("d"))
    s2 = ends.agg(F.sum(F.col("d") * F.col("d")).alias("s2"))
    each = F.array(*(F.struct(F.lit(i).alias("factor"), F.col(f"x{i}").alias("cross")) for i in range(k)))
    return cross.select(F.inline(each)).select("*", s1.select("w").scalar().alias("w"), s1.select("s1").scalar().alias("s1"), s2.scalar().alias("s2"))


def factor_interpretability(scores: DataFrame, loadings: DataFrame, edges: DataFrame, k: int, top_n: int = 10) -> DataFrame:
    """factor, coherence (Moran's I of the scores), null_mean, null_std and z of it when scores are dealt to spots at
    random, enrichment (share of a factor's absolute loadings in its top_n genes), max_redundancy and top_genes.

    scores: (spot_id, h) with k entries; loadings: (gene_id, k, w). The null's moments are those over all permutations,
    in closed form from the graph and the factor's fourth moment, so nothing is shuffled. A flat factor has coherence 0
    and no z, one without loadings no enrichment; without edges coherence is null. Needs four spots for null_std.
    """
    if k <= 0:
        raise ValueError("no factors")
    rows = scores.select("spot_id", "h")
    m = _moments(rows, k).join(_spatial(rows, edges, k), "factor")
    n, w, s1, s2 = F.col("n").cast("double"), F.col("w"), F.col("s1"), F.col("s2")
    flat = F.col("m2") <= 1e-12
    i = F.when(w > 0, F.when(flat, 0e0).otherwise(F.try_divide(n * F.col("cross"), w * F.col("m2"))))
    mean = F.try_divide(F.lit(-1e0), n - 1)
    b2 = F.try_divide(n * F.col("m4"), F.col("m2") * F.col("m2"))
    top = n * ((n * n - 3 * n + 3) * s1 - n * s2 + 3 * w * w) - b2 * ((n * n - n) * s1 - 2 * n * s2 + 6 * w * w)
    var = F.try_divide(top, (n - 1) * (n - 2) * (n - 3) * w * w) - mean * mean
    std = F.when((w > 0) & ~flat & (n > 3), F.sqrt(F.greatest(var, F.lit(0e0))))
    spatial = m.select("factor", i.alias("coherence"), F.when(w > 0, mean).alias("null_mean"), std.alias("null_std"), "max_redundancy")
    spatial = spatial.withColumn("z", F.try_divide(F.col("coherence") - F.col("null_mean"), F.col("null_std")))
    place = F.row_number().over(Window.partitionBy("k").orderBy(F.abs("w").desc(), "gene_id"))
    best = loadings.withColumn("r", place).where(F.col("r") <= max(1, top_n)).groupBy("k").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "gene_id"))), lambda x: x["gene_id"]).alias("top_genes"))
    mass = top_gene_mass(loadings, max(1, top_n)).withColumnRenamed("mass", "enrichment").join(best, "k").withColumnRenamed("k", "factor")
    out = spatial.join(mass.withColumn("factor", F.col("factor").cast("int")), "factor", "left")
    return out.select(F.col("factor").cast("long").alias("factor"), "coherence", "null_mean", "null_std", "z", "enrichment", "max_redundancy", "top_genes")


def factor_coherence(scores: DataFrame, loadings: DataFrame, edges: DataFrame, k: int, top_k: int = 10) -> DataFrame:
    """factor, top_gene_mass, spatial_coherence, max_redundancy of each factor, in order; as factor_interpretability."""
    rows = factor_interpretability(scores, loadings, edges, k, top_k)
    return rows.select("factor", F.col("enrichment").alias("top_gene_mass"), F.col("coherence").alias("spatial_coherence"), "max_redundancy").orderBy("factor")
