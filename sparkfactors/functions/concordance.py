"""Agreement of two labelings, from their contingency table. Metrics are null where they are undefined.

pairs has a row per item with the true label t and the predicted label p, and maybe columns `by` to group items by;
all groups are scored in one job. Contingency tables have partial counts before the shuffle.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..checkpoints import cut

#: Labels that say nothing (fixed values), compared after trimming and lower-casing.
MISSING = ("", "na", "nan", "none", "unknown", "unlabeled", "unlabelled")


def has_label(label: Column) -> Column:
    return ~F.lower(F.trim(F.coalesce(label.cast("string"), F.lit("")))).isin(*MISSING)


def contingency(pairs: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """by, t, p, n, with the margins a (of t) and b (of p) and the total."""
    c = pairs.groupBy(*by, "t", "p").agg(F.count("*").alias("n"))
    over = lambda *more: Window.partitionBy(*by, *more) if by or more else Window.partitionBy(F.lit(0))
    return c.withColumns({"a": F.sum("n").over(over("t")), "b": F.sum("n").over(over("p")), "total": F.sum("n").over(over())})


def lgamma(x: Column) -> Column:
    """Log of the gamma function for x > 0, by Stirling's series eight steps up; twelve digits."""
    x = x.cast("double")
    z = x + 8
    y = 1 / (z * z)
    series = (z - 0.5) * F.ln(z) - z + 0.5 * math.log(2 * math.pi) + (1 / 12 - y * (1 / 360 - y * (1 / 1260 - y * (1 / 1680 - y / 1188)))) / z
    product = x
    for i in range(1, 8):
        product = product * (x + i)
    return series - F.ln(product)


def _choose2(n: Column) -> Column:
    return n.cast("double") * (n.cast("double") - 1) / 2


def _xlogx_sum(margin: str, total: str = "total") -> Column:
    q = F.col(margin).cast("double") / F.col(total)
    return -F.sum(q * F.ln(q))


def information(pairs: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """by, total, mi, ht, hp (mutual information and entropies, in nats), kt, kp (numbers of labels)."""
    c = contingency(pairs, by)
    n, total = F.col("n").cast("double"), F.col("total").cast("double")
    mi = c.groupBy(*by).agg(F.max("total").alias("total"), F.greatest(F.sum(n / total * F.ln(n * total / (F.col("a").cast("double") * F.col("b")))), F.lit(0e0)).alias("mi"))
    ends = [c.select(*by, side, margin, "total").distinct().groupBy(*by).agg(_xlogx_sum(margin).alias(h), F.count("*").alias(k)) for side, margin, h, k in (("t", "a", "ht", "kt"), ("p", "b", "hp", "kp"))]
    return _join(_join(mi, ends[0], by), ends[1], by)


def _join(x: DataFrame, y: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """By groups; without groups, both have one row."""
    if by:
        return x.join(y, list(by))
    return x.withColumn("_", F.lit(0)).join(y.withColumn("_", F.lit(0)), "_").drop("_")


def ari(pairs: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """by, ari: adjusted Rand index; null for less than two items and where its range is empty."""
    c = contingency(pairs, by)
    both = c.groupBy(*by).agg(F.max("total").alias("total"), F.sum(_choose2(F.col("n"))).alias("c2"))
    for side, margin, name in (("t", "a", "a2"), ("p", "b", "b2")):
        both = _join(both, c.select(*by, side, margin).distinct().groupBy(*by).agg(F.sum(_choose2(F.col(margin))).alias(name)), by)
    expected = F.try_divide(F.col("a2") * F.col("b2"), _choose2(F.col("total")))
    value = F.try_divide(F.col("c2") - expected, 0.5 * (F.col("a2") + F.col("b2")) - expected)
    return both.select(*by, F.when(F.col("total") >= 2, value).alias("ari"))


def nmi(pairs: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """by, nmi: mutual information over the mean entropy, in [0, 1]; 1 if both have one label."""
    i = information(pairs, by)
    value = F.least(F.greatest(F.try_divide(F.col("mi"), (F.col("ht") + F.col("hp")) / 2), F.lit(0e0)), F.lit(1e0))
    return i.select(*by, F.when(F.col("total") < 2, None).when((F.col("kt") == 1) & (F.col("kp") == 1), 1e0).otherwise(value).alias("nmi"))


def expected_information(pairs: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """by, emi: mutual information expected of random labelings with these margins (hypergeometric).

    Terms more than 40 standard deviations from the mean are below any double's resolution and left out, so the work
    grows with the root of the number of items.
    """
    c = contingency(pairs, by)
    a = c.select(*by, "t", "a", "total").distinct().groupBy(*by, "a", "total").agg(F.count("*").alias("ka"))
    b = c.select(*by, "p", "b").distinct().groupBy(*by, "b").agg(F.count("*").alias("kb"))
    return expected_of_margins(a, b, by)


def expected_of_margins(a: DataFrame, b: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """by, emi from the margins' sizes and how often each occurs: a (by, a, total, ka) and b (by, b, kb)."""
    g = _join(a, b, by)
    A, B, N = (F.col(x).cast("double") for x in ("a", "b", "total"))
    mean = A * B / N
    spread = 40 * F.sqrt(mean * (N - A) * (N - B) / (N * F.greatest(N - 1, F.lit(1e0)))) + 40
    low = F.greatest(F.lit(1), F.col("a") + F.col("b") - F.col("total"), F.floor(mean - spread))
    high = F.least(F.col("a"), F.col("b"), F.ceil(mean + spread))
    e = g.where(low <= high).withColumn("x", F.explode(F.sequence(low.cast("long"), high.cast("long"))))
    X = F.col("x").cast("double")
    weight = F.exp(
        lgamma(A + 1) + lgamma(B + 1) + lgamma(N - A + 1) + lgamma(N - B + 1)
        - lgamma(N + 1) - lgamma(X + 1) - lgamma(A - X + 1) - lgamma(B - X + 1) - lgamma(N - A - B + X + 1)
    )
    term = X / N * (F.ln(N) + F.ln(X) - F.ln(A) - F.ln(B)) * weight * F.col("ka") * F.col("kb")
    return e.groupBy(*by).agg(F.sum(term).alias("emi"))


def ami(pairs: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """by, ami: mutual information adjusted for chance; 1 if both have one label. Its denominator stays off 0."""
    i = _join(information(pairs, by), expected_information(pairs, by), by)
    eps = 2.220446049250313e-16
    d = (F.col("ht") + F.col("hp")) / 2 - F.col("emi")
    d = F.when(d < 0, F.least(d, F.lit(-eps))).otherwise(F.greatest(d, F.lit(eps)))
    return i.select(*by, F.when(F.col("total") < 2, None).when((F.col("kt") == 1) & (F.col("kp") == 1), 1e0).otherwise((F.col("mi") - F.col("emi")) / d).alias("ami"))


def best_matches(pairs: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """by, t, p, n, a, b: of each true label, the predicted one it shares most items with; ties to the smaller."""
    order = Window.partitionBy(*by, "t").orderBy(F.desc("n"), "p")
    return contingency(pairs, by).withColumn("r", F.row_number().over(order)).where("r = 1").drop("r")


def weighted_dice(pairs: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """by, dice: Dice overlap of each true label with its best match, weighted by the label's size."""
    m = best_matches(pairs, by)
    dice = 2e0 * F.col("n") / (F.col("a") + F.col("b"))
    return m.groupBy(*by).agg((F.sum(dice * F.col("a")) / F.sum("a")).alias("dice"))


def majority_relabel(pairs: DataFrame) -> DataFrame:
    """p, t: each predicted label with the true one most of its items have; ties to the smaller."""
    order = Window.partitionBy("p").orderBy(F.desc("n"), "t")
    return contingency(pairs).withColumn("r", F.row_number().over(order)).where("r = 1").select("p", "t")


def accuracy(pairs: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """by, ari, nmi, ami."""
    return _join(_join(ari(pairs, by), nmi(pairs, by), by), ami(pairs, by), by)


def boundary_scores(truth: DataFrame, found: DataFrame) -> DataFrame:
    """precision, recall, f1 of found boundary spots (spot_id) against true ones; null where nothing is counted."""
    f, t = found.select("spot_id", F.lit(1).alias("f")), truth.select("spot_id", F.lit(1).alias("t"))
    both = f.join(t, "spot_id", "full_outer").agg(F.count("f").alias("nf"), F.count("t").alias("nt"), F.count_if(F.col("f").isNotNull() & F.col("t").isNotNull()).alias("tp"))
    tp = F.col("tp").cast("double")
    return both.select(F.try_divide(tp, "nf").alias("precision"), F.try_divide(tp, "nt").alias("recall"), F.try_divide(2 * tp, F.col("nf") + F.col("nt")).alias("f1"))


def pairwise_stability(runs: DataFrame) -> DataFrame:
    """method, stability: mean ARI over all pairs of a method's runs, for runs (method, seed, spot_id, label); null for
    one run. Runs meet by spot, so the work is spots times pairs of runs."""
    r = runs.select("method", "seed", "spot_id", "label")
    other = r.select("method", F.col("seed").alias("seed2"), "spot_id", F.col("label").alias("p"))
    pairs = r.withColumnRenamed("label", "t").join(other, ["method", "spot_id"]).where("seed < seed2")
    mean = ari(pairs, ("method", "seed", "seed2")).groupBy("method").agg(F.avg("ari").alias("stability"))
    return r.select("method").distinct().join(mean, "method", "left")


def accuracy_sets(pairs: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """by, total, ari, nmi, ami of every group, as ari, nmi and ami give, from one pass over the pairs.

    Tables and both margins of all groups are grouping sets of one aggregation; what the metrics need of them are sums
    over their rows, so nothing but the margins' sizes is joined.
    """
    sets = pairs.groupingSets([[*by, "t", "p"], [*by, "t"], [*by, "p"]], *by, "t", "p").agg(F.count("*").alias("n"), F.grouping("t").alias("no_t"), F.grouping("p").alias("no_p"))
    kind = F.when(F.col("no_p") == 1, "t").when(F.col("no_t") == 1, "p").otherwise("c")
    # A row per size and group, however many labels have it.
    sizes = cut(sets.groupBy(*by, kind.alias("kind"), "n").agg(F.count("*").alias("k")))
    n, k = F.col("n").cast("double"), F.col("k")
    of = lambda kind, v: F.coalesce(F.sum(F.when(F.col("kind") == kind, v)), F.lit(0e0))
    sums = sizes.groupBy(*by).agg(
        of("c", n * k).alias("total"), *(of(x, _choose2(F.col("n")) * k).alias(f"{x}2") for x in "ctp"), *(of(x, n * F.ln(n) * k).alias(f"{x}l") for x in "ctp"),
        of("t", k.cast("double")).alias("kt"), of("p", k.cast("double")).alias("kp"),
    )
    margin = lambda x, name: sizes.where(F.col("kind") == x).select(*by, F.col("n").alias(name), F.col("k").alias(f"k{name}"))
    s = _join(sums, expected_of_margins(_join(margin("t", "a"), sums.select(*by, "total"), by), margin("p", "b"), by), by)
    total = F.col("total")
    ht, hp = F.ln(total) - F.col("tl") / total, F.ln(total) - F.col("pl") / total
    mi = F.greatest(ht + hp - (F.ln(total) - F.col("cl") / total), F.lit(0e0))
    expected = F.try_divide(F.col("t2") * F.col("p2"), total * (total - 1) / 2)
    value = F.try_divide(F.col("c2") - expected, 0.5 * (F.col("t2") + F.col("p2")) - expected)
    one = (F.col("kt") == 1) & (F.col("kp") == 1)
    eps = 2.220446049250313e-16
    d = (ht + hp) / 2 - F.col("emi")
    d = F.when(d < 0, F.least(d, F.lit(-eps))).otherwise(F.greatest(d, F.lit(eps)))
    share = F.least(F.try_divide(mi, (ht + hp) / 2), F.lit(1e0))
    few = lambda v: F.when(total >= 2, v)
    return s.select(*by, total.cast("long").alias("total"), few(value).alias("ari"), few(F.when(one, 1e0).otherwise(share)).alias("nmi"), few(F.when(one, 1e0).otherwise((mi - F.col("emi")) / d)).alias("ami"))
