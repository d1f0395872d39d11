"""What the operators of this subpackage share: row identity, partition counts, tables in the shared folder."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from passageworks.functions.scale import shared_folder

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None = None):
    def register(build):
        QUERIES[name] = build
        if sql is not None:
            ORACLES[name] = sql
        return build

    return register


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def crc(column: str) -> Column:
    """crc32 of an integer column written as text; a null counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary"))


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the folder all executors share and read it again: later steps neither
    compute it twice nor lose it with an executor."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def own_names(*names: str) -> list[str]:
    """Column names for the inside of an operator that no input column has."""
    mark = uuid.uuid4().hex
    return [f"_{n}_{mark}" for n in names]


def parts(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
