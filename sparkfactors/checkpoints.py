"""Cutting the lineage of iterative computations in the folder that all executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, as in tests on one machine, /tmp/checkpoints; on a cluster an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return "file:///tmp/checkpoints"


def scratch(spark: SparkSession) -> str:
    """A new path below this application's own folder, which goes when the driver's JVM ends."""
    context = spark.sparkContext
    folder = f"{shared_folder(spark)}/sparkfactors/{context.applicationId}"
    path = context._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(context._jsc.hadoopConfiguration())
    if not fs.exists(path):
        fs.mkdirs(path)
        fs.deleteOnExit(path)
    return f"{folder}/{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """df, computed now and read from the shared folder from now on.

    It is a written table and not checkpoint(): a table knows its true size, where a checkpointed plan keeps the product
    of its inputs' estimates, which loops that join a frame with itself square in every round.
    """
    path = scratch(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
