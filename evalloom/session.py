"""Session defaults for local runs; a cluster's own settings win."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(master: str | None = None, partitions: int = 8) -> SparkSession:
    builder = SparkSession.builder.appName("evalloom")
    if master:
        builder = builder.master(master)
    return (
        builder.config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
