"""Connected components of an edge table, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..checkpoints import cut


def components(edges: DataFrame, one_task: int = 300_000) -> DataFrame:
    """From edges a, b (long): v and root for every vertex with an edge to another; root is the least v of its component.

    Each round hooks every vertex to the neighbour (or itself) that comes first in a hashed order, follows the hooks
    twice, and contracts the edges; hashed order keeps chains of hooks short, so edges vanish after few rounds, whatever
    the graph's diameter. Minima are pre-aggregated, so a vertex with very many edges is no hot group. Rounds are
    written to the shared folder. Up to one_task edges are held in one partition, where a round is done faster than a
    shuffle deals it out; the result is the same. Loops, repeated and null edges change nothing; an empty table gives an empty one.
    """
    edges = edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"))
    left = cut(edges.where("a <> b").distinct())
    hooks: list[DataFrame] = []
    few = (lambda df: df.coalesce(1)) if left.count() <= one_task else (lambda df: df)
    left = few(left)
    while left.take(1):
        both = few(left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b"))))
        order = lambda x: F.struct(F.xxhash64(F.lit(len(hooks)), x).alias("h"), x.alias("v"))
        up = both.groupBy("a").agg(F.min(order(F.col("b"))).alias("m"))
        up = few(cut(up.select(F.col("a").alias("v"), F.least(order(F.col("a")), F.col("m"))["v"].alias("p"))))
        for _ in range(2):
            up = up.join(up.select(F.col("v").alias("p"), F.col("p").alias("q")), "p").select("v", F.col("q").alias("p"))
        up = few(cut(up))
        hooks.append(up)
        pairs = left.join(up.toDF("a", "pa"), "a").join(up.toDF("b", "pb"), "b").where("pa <> pb")
        left = few(cut(pairs.select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct()))
    if not hooks:
        return edges.limit(0).toDF("v", "root")
    top = hooks[0]
    for up in hooks[1:]:
        # Vertices of earlier rounds whose root has no edge left keep it.
        top = top.join(up.select(F.col("v").alias("p"), F.col("p").alias("q")), "p", "left").select("v", F.coalesce("q", "p").alias("p"))
    least = top.groupBy("p").agg(F.min("v").alias("root"))
    return cut(top.join(least, "p").select("v", "root"))
