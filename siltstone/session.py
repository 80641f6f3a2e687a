"""Session builder used by tests, the bench and interactive work."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def get_session(app: str = "siltstone", cpus: int | str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A local session with the settings the engine expects: UTC and adaptive plans."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a dataset folder; the path may be in any store Spark reads."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
