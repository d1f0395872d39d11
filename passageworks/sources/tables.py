"""Reading the given parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Give a scan that has fewer splits than the cluster has cores one split per core.

    Only an input of few files or row groups is moved; a large table already has far more
    splits than cores and is returned as it is, without a shuffle. For plain scans only: asking
    a plan with shuffles for its partitions would run them."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
