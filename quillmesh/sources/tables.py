"""Parquet tables of a data folder and the rule for repeated rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str, *columns: str) -> DataFrame:
    """One table of ``folder``; with ``columns`` the scan reads only those."""
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    return df.select(*columns) if columns else df


def once(df: DataFrame, *keys: str, order: str | None = "ingested_at") -> DataFrame:
    """One row for each key: the one taken in first (null ``order`` last, then by content hash, so that the
    choice does not depend on partitioning). Rows with a null key are kept out: they have no identity."""
    for k in keys:
        df = df.where(F.col(k).isNotNull())
    by = [F.col(order).asc_nulls_last()] if order and order in df.columns else []
    by.append(F.xxhash64(*[F.col(c) for c in df.columns]))
    n = "__once"
    return df.withColumn(n, F.row_number().over(Window.partitionBy(*keys).orderBy(*by))).where(F.col(n) == 1).drop(n)
