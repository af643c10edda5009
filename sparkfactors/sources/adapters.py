"""Spots, sparse values and labels as views of the relational test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import hash_unit

N_GENES = 62


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def embedding_spots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """spot_id, section_id, x, y, gt: vectors, placed by their first two entries, in four sections."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(
        F.col("vec_id").alias("spot_id"), F.pmod("vec_id", F.lit(4)).cast("long").alias("section_id"), F.get("embedding", 0).cast("double").alias("x"),
        F.get("embedding", 1).cast("double").alias("y"), F.col("label").cast("string").alias("gt"),
    )


def embedding_expr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """spot_id, gene_id, value: the positive ones of the other entries."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("spot_id"), F.posexplode(F.slice("embedding", 3, N_GENES)).alias("g", "v"))
    return e.where("v > 0").select("spot_id", F.col("g").cast("long").alias("gene_id"), F.col("v").cast("double").alias("value"))


def embedding_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, label, h: vectors as points."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("id"), F.col("label").cast("string").alias("label"), F.transform("embedding", lambda v: v.cast("double")).alias("h"))


def labels(spots: DataFrame) -> DataFrame:
    return spots.select("spot_id", F.col("gt").alias("label"))


def supplier_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """spot_id (supplier), gene_id (brand), value (quantity): true counts."""
    li = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey", "l_quantity")
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.regexp_extract("p_brand", "([0-9]+)", 1).cast("long").alias("gene_id"))
    return li.join(part, "l_partkey").groupBy(F.col("l_suppkey").alias("spot_id"), "gene_id").agg(F.sum("l_quantity").cast("double").alias("value"))


def document_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """spot_id, gt: documents and their quality, missing for most."""
    d, q = table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels").select("doc_id", "quality")
    return d.join(q, "doc_id", "left").select(F.col("doc_id").alias("spot_id"), F.col("quality").cast("string").alias("gt"))


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """method, seed, spot_id, label: labelings of the vectors, three seeds each: the truth with a fifth or half of the
    labels moved on by a hash."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("spot_id"), F.col("label").cast("long").alias("l"))
    grid = F.explode(F.array(*(F.struct(F.lit(m).alias("method"), F.lit(p).alias("p"), F.lit(s).alias("seed")) for m, p in (("mild", 0.2), ("wild", 0.5)) for s in range(3))))
    r = e.withColumn("g", grid).select("g.method", "g.p", "g.seed", "spot_id", "l")
    u = hash_unit(F.col("method"), F.col("seed"), F.col("spot_id"))
    return r.select("method", "seed", "spot_id", F.when(u < F.col("p"), (F.col("l") + 1 + F.col("seed")) % 10).otherwise(F.col("l")).alias("label"))
