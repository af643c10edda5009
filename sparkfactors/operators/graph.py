"""Spatial graphs as edge tables (src, dst), which are bags unless a function says otherwise."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..checkpoints import cut
from . import contraction


def hash_unit(*parts) -> Column:
    """A number in [0, 1) that depends on the parts alone: the first 12 hex digits of their md5."""
    text = F.concat_ws(":", *(p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts))
    return F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("double") / float(16**12)


def _squares(px: Column, py: Column) -> Column:
    return (F.col("x") - px) * (F.col("x") - px) + (F.col("y") - py) * (F.col("y") - py)


def _cuts(values: DataFrame, by: tuple[str, ...], axis: str, most: int) -> DataFrame:
    """by, cuts: the inner edges of n_cuts runs of about equal size along an axis; values: by, axis, n_cuts <= most."""
    at = [i / most for i in range(1, most)] or [0.5]
    fine = values.groupBy(*by).agg(F.percentile_approx(axis, at, 10_000).alias("e"), F.max("n_cuts").alias("n_cuts"))
    picked = F.transform(F.sequence(F.lit(1), F.col("n_cuts") - 1), lambda i: F.get("e", F.round(i * F.lit(float(most)) / F.col("n_cuts")).cast("int") - 1))
    return fine.select(*by, F.when(F.col("n_cuts") > 1, picked).otherwise(F.array().cast("array<double>")).alias("cuts"))


def _reached(cuts: Column, v: Column) -> Column:
    """How many cuts lie at or below v: the number of v's run."""
    return F.size(F.filter(cuts, lambda e: e <= v))


def knn(spots: DataFrame, k: int, by_section: bool = True, per_cell: int = 64) -> DataFrame:
    """src, dst, rank, d2: the k nearest other spots (all others if fewer), ties by dst; of a section, or of all.

    Exact without comparing all pairs, however spots cluster: a section is cut by quantiles of x, and each slab by
    quantiles of y, into cells of about per_cell spots. A spot's k nearest in its own cell give a circle that holds its
    k nearest; the other cells which that circle meets are searched for what lies inside it.
    """
    if k < 0:
        raise ValueError("k must not be negative")
    key = F.col("section_id") if by_section else F.lit(0)
    points = cut(spots.select("spot_id", key.cast("long").alias("g"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")))
    sizes = points.groupBy("g").agg(F.count("*").alias("n"))
    largest = sizes.agg(F.max("n")).first()[0] or 0
    if not k or not largest:
        return points.select(F.col("spot_id").alias("src"), F.col("spot_id").alias("dst"), F.lit(1).alias("rank"), F.lit(0e0).alias("d2")).limit(0)
    per_cell = max(per_cell, 4 * k)
    most = max(1, int((largest / per_cell) ** 0.5))
    sizes = sizes.select("g", F.greatest(F.lit(1), F.floor(F.sqrt(F.col("n") / per_cell)).cast("int")).alias("n_cuts"))
    x_cuts = cut(_cuts(points.join(sizes, "g"), ("g",), "x", most)).withColumnRenamed("cuts", "x_cuts")
    slabs = points.join(x_cuts, "g").select("spot_id", "g", "x", "y", _reached(F.col("x_cuts"), F.col("x")).alias("i"))
    y_cuts = cut(_cuts(slabs.join(sizes, "g"), ("g", "i"), "y", most)).withColumnRenamed("cuts", "y_cuts")
    cells = slabs.join(y_cuts, ["g", "i"]).select("spot_id", "g", "x", "y", "i", _reached(F.col("y_cuts"), F.col("y")).alias("j"))
    cells = cut(cells)
    there = cells.select("g", "i", "j", F.col("spot_id").alias("dst"), F.col("x").alias("px"), F.col("y").alias("py"))
    found = F.struct(_squares(F.col("px"), F.col("py")).alias("d2"), "dst")
    own = cells.join(there, ["g", "i", "j"]).groupBy("spot_id", "g", "i", "j", "x", "y").agg(F.array_sort(F.collect_list(F.when(F.col("spot_id") != F.col("dst"), found))).alias("near"))
    own = cut(own.withColumn("near", F.slice("near", 1, k)))
    limit = F.when(F.size("near") == k, F.element_at("near", -1)["d2"]).otherwise(F.lit(float("inf")))
    r = F.sqrt(limit) * (1 + 1e-9)
    spread = lambda cuts, v: F.explode(F.sequence(_reached(cuts, v - F.col("r")), _reached(cuts, v + F.col("r"))))
    look = own.select("spot_id", "g", F.col("i").alias("i0"), F.col("j").alias("j0"), "x", "y", limit.alias("limit"), r.alias("r")).join(x_cuts, "g")
    look = look.withColumn("i", spread(F.col("x_cuts"), F.col("x"))).drop("x_cuts").join(y_cuts, ["g", "i"])
    look = look.withColumn("j", spread(F.col("y_cuts"), F.col("y"))).where("i <> i0 OR j <> j0")
    others = look.join(there, ["g", "i", "j"]).select("spot_id", found.alias("f"), "limit").where("f.d2 <= limit")
    every = own.select("spot_id", F.explode("near").alias("f")).unionByName(others.select("spot_id", "f"))
    order = Window.partitionBy("src").orderBy("d2", "dst")
    every = every.select(F.col("spot_id").alias("src"), "f.dst", "f.d2").withColumn("rank", F.row_number().over(order))
    return cut(every.where(F.col("rank") <= k).select("src", "dst", "rank", "d2"))


def knn_directed(spots: DataFrame, k: int, by_section: bool = True) -> DataFrame:
    return knn(spots, k, by_section).select("src", "dst")


def knn_undirected(spots: DataFrame, k: int, by_section: bool = False) -> DataFrame:
    """Distinct pairs in both directions."""
    e = knn_directed(spots, k, by_section)
    return e.union(e.select("dst", "src")).toDF("src", "dst").distinct()


def reverse(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))


def symmetrise(edges: DataFrame) -> DataFrame:
    """Both directions of every edge, as a bag: a reciprocal pair counts twice."""
    return edges.select("src", "dst").unionByName(reverse(edges))


def degree(edges: DataFrame, spots: DataFrame) -> DataFrame:
    """spot_id, degree (by src); 0 for spots without edges."""
    d = edges.groupBy(F.col("src").alias("spot_id")).agg(F.count("*").alias("degree"))
    return spots.select("spot_id").join(d, "spot_id", "left").withColumn("degree", F.coalesce("degree", F.lit(0)).cast("long"))


def neighbour_sum(edges: DataFrame, values: DataFrame, key: str) -> DataFrame:
    """spot_id, key, v: of each spot the sum of v over its dst, for long values (spot_id, key, v)."""
    e = edges.select("src", F.col("dst").alias("spot_id"))
    return e.join(values, "spot_id").groupBy(F.col("src").alias("spot_id"), key).agg(F.sum("v").alias("v"))


def neighbour_mean(edges: DataFrame, values: DataFrame, key: str, spots: DataFrame) -> DataFrame:
    """As neighbour_sum, over the larger of degree and 1."""
    d = degree(edges, spots)
    return neighbour_sum(edges, values, key).join(d, "spot_id").select("spot_id", key, (F.col("v") / F.greatest("degree", F.lit(1))).alias("v"))


def smooth(edges: DataFrame, values: DataFrame, key: str, alpha: float = 0.5, hops: int = 2) -> DataFrame:
    """hops times: (1 - alpha) times the value plus alpha times the mean over neighbours in both directions.

    Spots without neighbours keep the first part alone, so they shrink.
    """
    if not 0 <= alpha <= 1 or hops < 0:
        raise ValueError("alpha must lie in [0, 1] and hops must not be negative")
    both = cut(symmetrise(edges))
    deg = both.groupBy(F.col("src").alias("spot_id")).agg(F.count("*").alias("degree"))
    for hop in range(hops):
        mean = neighbour_sum(both, values, key).join(deg, "spot_id").select("spot_id", key, (F.col("v") / F.col("degree")).alias("m"))
        values = values.join(mean, ["spot_id", key], "full_outer").select(
            "spot_id", key, (F.lit(1 - alpha) * F.coalesce("v", F.lit(0e0)) + F.lit(float(alpha)) * F.coalesce("m", F.lit(0e0))).alias("v")
        )
        values = cut(values) if hop + 1 < hops else values
    return values


def components(edges: DataFrame, spots: DataFrame) -> DataFrame:
    """spot_id, component: the least spot_id reachable; edges count in both directions. Spots without edges are alone."""
    roots = contraction.components(edges.select(F.col("src").alias("a"), F.col("dst").alias("b"))).toDF("spot_id", "root")
    return spots.select("spot_id").join(roots, "spot_id", "left").select("spot_id", F.coalesce("root", "spot_id").alias("component"))


def _ends(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """src, dst, ls, ld: edges with the labels (spot_id, label) of both ends."""
    s, d = labels.select(F.col("spot_id").alias("src"), F.col("label").alias("ls")), labels.select(F.col("spot_id").alias("dst"), F.col("label").alias("ld"))
    return edges.select("src", "dst").join(s, "src").join(d, "dst")


def domain_components(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """label, component, size: connected parts of each label, counting edges inside labels alone."""
    inside = _ends(edges, labels).where(F.col("ls") == F.col("ld"))
    c = components(inside, labels)
    return c.join(labels, "spot_id").groupBy("label", "component").agg(F.count("*").alias("size"))


def boundary_mask(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """spot_id of both ends of every edge whose labels differ."""
    odd = _ends(edges, labels).where(F.col("ls") != F.col("ld"))
    return odd.select(F.explode(F.array("src", "dst")).alias("spot_id")).distinct()


def edge_purity(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """purity: share of edges with equal labels, null without edges."""
    return _ends(edges, labels).agg(F.avg((F.col("ls") == F.col("ld")).cast("double")).alias("purity"))


def laplacian_form(edges: DataFrame, values: DataFrame, key: str) -> DataFrame:
    """form: trace of V'LV of the symmetrised bag graph, for long values (spot_id, key, v)."""
    both = symmetrise(edges)
    deg = both.groupBy(F.col("src").alias("spot_id")).agg(F.count("*").alias("degree"))
    own = values.join(deg, "spot_id").agg(F.sum(F.col("degree") * F.col("v") * F.col("v")).alias("own"))
    a = neighbour_sum(both, values, key).withColumnRenamed("v", "av")
    cross = values.join(a, ["spot_id", key]).agg(F.sum(F.col("v") * F.col("av")).alias("cross"))
    return own.select((F.coalesce("own", F.lit(0e0)) - F.coalesce(cross.scalar(), F.lit(0e0))).alias("form"))


def edge_dropout(edges: DataFrame, p: float, seed: int = 0, keep_one: bool = False) -> DataFrame:
    """Edges, each dropped with probability p by a hash of seed, src and dst; keep_one: never all of them."""
    if not 0 <= p < 1:
        raise ValueError("p must lie in [0, 1)")
    u = hash_unit(seed, F.col("src"), F.col("dst"))
    kept = edges.where(u >= p) if p else edges
    if not keep_one:
        return kept
    return kept if kept.take(1) else edges.orderBy(u.desc(), "src", "dst").limit(1)


def edge_subset(edges: DataFrame, spots: DataFrame) -> DataFrame:
    """Edges with both ends among spots; ids are stable, so nothing is renumbered."""
    return edges.join(spots.select(F.col("spot_id").alias("src")), "src", "left_semi").join(spots.select(F.col("spot_id").alias("dst")), "dst", "left_semi").select("src", "dst")


def apportion(sizes: DataFrame, k: int) -> DataFrame:
    """component, size, budget: one each, and the k - C left by largest remainders; ties to the smaller component."""
    n = sizes.count()
    left = k - n
    if left < 0:
        raise ValueError("fewer clusters than components")
    total = sizes.agg(F.sum("size").cast("double"))
    ideal = F.col("size") / total.scalar() * left
    s = sizes.withColumn("ideal", ideal).withColumn("whole", F.floor("ideal"))
    # One row per component of a section, already aggregated.
    rank = F.row_number().over(Window.orderBy((F.col("ideal") - F.col("whole")).desc(), "component"))
    spare = left - s.agg(F.coalesce(F.sum("whole"), F.lit(0))).first()[0]
    return s.withColumn("r", rank).select("component", "size", (1 + F.col("whole") + (F.col("r") <= spare).cast("long")).cast("long").alias("budget"))

