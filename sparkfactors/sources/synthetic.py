"""Planted instances: shared and private factors, noisy values, neighbour graphs and spatial domains, all from hashes.

Every number depends on the seed and the row's ids alone, so any partitioning gives the same instance, of any size.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import graph
from ..operators.ranks import ranked


class Instance(NamedTuple):
    expr: DataFrame  # spot_id, gene_id, value > 0
    spots: DataFrame  # spot_id, section_id, x, y
    edges: DataFrame  # src, dst
    loadings: DataFrame  # gene_id, k, w
    scores: DataFrame  # spot_id, k, v: shared factors first, then private ones
    domains: DataFrame  # spot_id, domain_id


def exponential(*parts) -> Column:
    """A number of the standard exponential distribution from the hash of parts."""
    return -F.log(F.lit(1e0) - graph.hash_unit(*parts))


def normal(*parts) -> Column:
    """A number of the standard normal distribution from two hashes of parts."""
    return F.sqrt(2 * exponential(*parts, "r")) * F.cos(2 * F.pi() * graph.hash_unit(*parts, "a"))


def spatial_domains(spots: DataFrame, n_domains: int, seed: int = 0) -> DataFrame:
    """spot_id, domain_id: each section is cut across a direction of its own into up to n_domains runs of equal size.

    A spot of rank r among m gets r * k div m with k = min(n_domains, m, all spots); ties by spot_id.
    """
    if n_domains <= 0:
        return spots.select("spot_id", F.lit(0).cast("long").alias("domain_id"))
    along = F.col("x") * normal(seed, "D", F.col("section_id"), 0) + F.col("y") * normal(seed, "D", F.col("section_id"), 1)
    rows = ranked(spots.select("spot_id", "section_id", along.alias("along")), ("along", "spot_id"), ("section_id",), name="r", size="m")
    return rows.select("spot_id", F.expr(f"(r * least({int(n_domains)}L, m)) div m").alias("domain_id"))


def generate(
    spark: SparkSession, n_sections: int = 4, n_spots_per_section: int = 2000, n_genes: int = 500, k_shared: int = 4, k_private: int = 2,
    noise: float = 0.5, n_domains: int = 5, neighbours: int = 8, seed: int = 0,
) -> Instance:
    """Values are max(0, scores times loadings + noise). Private factor k is active in section k modulo n_sections."""
    k = k_shared + k_private
    ids = spark.range(n_sections * n_spots_per_section).withColumnRenamed("id", "spot_id")
    u = lambda tag: graph.hash_unit(seed, tag, F.col("spot_id"))
    spots = ids.select("spot_id", F.expr(f"spot_id div {max(1, n_spots_per_section)}").alias("section_id"), u("x").alias("x"), u("y").alias("y"))
    active = [F.lit(True) if j < k_shared else F.col("section_id") == (j - k_shared) % max(1, n_sections) for j in range(k)]
    z = [F.when(active[j], exponential(seed, "Z", F.col("spot_id"), j)).otherwise(0e0) for j in range(k)]
    w = [exponential(seed, "W", F.col("gene_id"), j) for j in range(k)]
    genes = spark.range(n_genes).select(F.col("id").alias("gene_id"), F.array(*w).alias("w"))
    rows = spots.select("spot_id", F.array(*z).alias("z"))
    # The genes are n_genes x k numbers; each spot gives a row for every one, which is the size of the result.
    cells = rows.select("spot_id", "z", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_genes - 1).cast("long"))).alias("gene_id")) if n_genes else rows.withColumn("gene_id", F.lit(0).cast("long")).limit(0)
    mean = sum((F.get("z", j) * F.get("w", j) for j in range(k)), F.lit(0e0))
    value = mean + float(noise) * normal(seed, "N", F.col("spot_id"), F.col("gene_id"))
    expr = cells.join(genes, "gene_id").select("spot_id", "gene_id", value.alias("value")).where("value > 0")
    pairs = lambda df, key, col, v: df.select(key, F.posexplode(col).alias("k", v))
    edges = graph.knn_directed(spots, neighbours)
    return Instance(expr, spots, edges, pairs(genes, "gene_id", "w", "w"), pairs(rows, "spot_id", "z", "v"), spatial_domains(spots, n_domains, seed))
