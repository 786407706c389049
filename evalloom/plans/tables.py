"""Helpers of the queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def rounded(rows: DataFrame, places: int = 6) -> DataFrame:
    """Doubles rounded, so that sums in another order compare equal."""
    return rows.select(*(F.round(c, places).alias(c) if t in ("double", "float") else F.col(c) for c, t in rows.dtypes))
