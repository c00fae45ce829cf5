"""One place for session defaults used by tests, the benchmark and local runs."""

from __future__ import annotations

from pyspark.sql import SparkSession


def local_session(cores: int = 8, shuffle_partitions: int = 8, memory: str = "12g") -> SparkSession:
    """A local session. On a cluster the caller brings its own session and settings."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("duotext")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.adaptive.enabled", "true")
        .getOrCreate()
    )


def read_table(spark: SparkSession, sf_dir: str, name: str):
    """A table of the data folder; columns and filters are pruned by the scan."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
