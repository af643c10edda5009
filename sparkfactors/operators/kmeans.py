"""Lloyd's k-means with reproducible starts, over points (id, h: array<double>)."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..checkpoints import cut
from .graph import hash_unit


class Clustering(NamedTuple):
    labels: DataFrame  # id, label, d2
    centers: list[list[float]]
    inertia: float
    iterations: int


def squared(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0e0), lambda s, v: s + v)


def _assigned(points: DataFrame, centers: dict[int, list[list[float]]]) -> DataFrame:
    """id, h, run, label, d2: the nearest center of each run; ties to the first. Centers are k x d numbers a run."""
    table = points.sparkSession.createDataFrame([(r, c) for r, c in centers.items()], "run int, centers array<array<double>>")
    rows = points.withColumn("run", F.explode(F.array(*map(F.lit, centers)))).join(F.broadcast(table), "run")
    rows = rows.withColumn("d", F.transform("centers", lambda c: squared(F.col("h"), c)))
    return rows.select("id", "h", "run", (F.array_position("d", F.array_min("d")) - 1).alias("label"), F.array_min("d").alias("d2"))


def _updated(rows: DataFrame, centers: dict, empty: str) -> tuple[dict, dict[int, float]]:
    """New centers and the inertia of the old ones, by run, in one job whose sums are partial before the shuffle; only
    runs x k rows of d numbers return."""
    d = max(len(c) for cs in centers.values() for c in cs)
    means = F.array(*(F.avg(F.get("h", j)) for j in range(d))).alias("m")
    far = F.max(F.struct("d2", (-F.col("id")).alias("n"), "h")).alias("far")
    got = rows.groupBy("run", "label").agg(means, far, F.sum("d2").alias("inertia")).collect()
    new, inertia, farthest = {}, dict.fromkeys(centers, 0.0), {}
    for x in sorted(got, key=lambda x: (x["run"], x["label"])):
        r = x["run"]
        inertia[r] += x["inertia"]
        farthest[r] = max(farthest.get(r, x["far"]), x["far"], key=lambda f: (f["d2"], f["n"]))
        new[r, x["label"]] = list(x["m"])
    out = {r: [new.get((r, i)) or (list(farthest[r]["h"]) if empty == "farthest" else c) for i, c in enumerate(cs)] for r, cs in centers.items()}
    return out, inertia


def starts(points: DataFrame, k: int, runs: int, seed: int = 0) -> dict[int, list[list[float]]]:
    """Of each run, the k points that come first in a hashed order."""
    rows = points.withColumn("run", F.explode(F.array(*map(F.lit, range(runs))))).withColumn("u", hash_unit(seed, F.col("run"), F.col("id")))
    first = rows.withColumn("r", F.row_number().over(Window.partitionBy("run").orderBy("u", "id"))).where(F.col("r") <= k).orderBy("run", "r").collect()
    out: dict[int, list[list[float]]] = {}
    for x in first:
        out.setdefault(x["run"], []).append(list(x["h"]))
    return out


def kmeans(points: DataFrame, k: int, n_init: int = 4, max_iter: int = 100, seed: int = 0, empty: str = "farthest") -> Clustering:
    """The best of n_init runs by inertia (the first of equals). All runs advance in one job an iteration.

    empty: a center without points moves to the point farthest from its own ('farthest') or stays ('keep').
    """
    if k < 1:
        raise ValueError("k must be positive")
    points = cut(points.select("id", F.col("h").cast("array<double>").alias("h")))
    centers = starts(points, k, n_init, seed)
    if not centers:
        return Clustering(points.select("id", F.lit(0).cast("long").alias("label"), F.lit(0e0).alias("d2")), [], 0.0, 0)
    going, n = dict(centers), 0
    while going and n < max_iter:
        new, _ = _updated(_assigned(points, going), going, empty)
        centers |= new
        going = {r: c for r, c in new.items() if c != going[r]}
        n += 1
    _, inertia = _updated(_assigned(points, centers), centers, empty)
    best = min(centers, key=lambda r: (inertia[r], r))
    labels = _assigned(points, {best: centers[best]}).select("id", "label", "d2")
    return Clustering(labels, centers[best], inertia[best], n)


def kmeans_over_components(points: DataFrame, parts: DataFrame, k: int, seed: int = 0, **settings) -> DataFrame:
    """id, label, where parts (id, component) must not be mixed: with more components than k, components are clustered
    by their mean points; else each gets its share of k (apportion) and is clustered by itself."""
    from .graph import apportion

    joined = points.join(parts, "id")
    sizes = parts.groupBy("component").agg(F.count("*").alias("size"))
    n = sizes.count()
    if n > k:
        means = joined.select("component", F.posexplode("h").alias("j", "v")).groupBy("component", "j").agg(F.avg("v").alias("v"))
        means = means.groupBy(F.col("component").alias("id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("j", "v"))), lambda x: x["v"]).alias("h"))
        found = kmeans(means, k, seed=seed, **settings).labels
        return parts.join(found.select(F.col("id").alias("component"), "label"), "component").select("id", "label")
    out, offset = None, 0
    for i, row in enumerate(apportion(sizes, k).orderBy("component").collect()):  # at most k rows
        one = kmeans(joined.where(F.col("component") == row["component"]), row["budget"], seed=seed + i, **settings)
        labels = one.labels.select("id", (F.col("label") + offset).alias("label"))
        out = labels if out is None else out.unionByName(labels)
        offset += row["budget"]
    return out if out is not None else parts.select("id", F.lit(0).cast("long").alias("label"))
