"""Spark sessions with the settings the library expects."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Adaptive execution coalesces and splits partitions; Arrow carries batches to Python where a solver needs it.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
}


def configure(builder: SparkSession.Builder) -> SparkSession.Builder:
    for k, v in SETTINGS.items():
        builder = builder.config(k, v)
    return builder


def local_session(cores: int = 8, partitions: int = 8, folder: str = "/tmp/checkpoints") -> SparkSession:
    """A session on this machine, for tests and benchmarks, its warehouse below folder; clusters bring their own
    builder to configure()."""
    builder = configure(SparkSession.builder.master(f"local[{cores}]"))
    for k, v in {
        "spark.sql.shuffle.partitions": partitions,
        "spark.ui.enabled": "false",
        "spark.driver.memory": "8g",
        "spark.driver.host": "127.0.0.1",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.warehouse.dir": f"{folder or '/tmp/checkpoints'}/warehouse",
    }.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
