"""The test tables, one Parquet file or directory each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table whose rows cost much work each. If its files make fewer tasks than there are cores, rows are dealt out over
    all of them; a table of many files is read as it lies, without a shuffle."""
    rows = table(spark, folder, name)
    cores = spark.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows
