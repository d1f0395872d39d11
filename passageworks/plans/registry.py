"""Registry of the queries shown to the driver: a Spark plan and, where SQL can say it, an
independent SQL text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

Build = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Build] = {}
ORACLES: dict[str, str] = {}


def _plain(df: DataFrame) -> DataFrame:
    """Integers as BIGINT and floats as DOUBLE, the types the SQL side states."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.ShortType | T.IntegerType | T.ByteType):
            c = c.cast("bigint")
        elif isinstance(f.dataType, T.FloatType | T.DecimalType):
            c = c.cast("double")
        cols.append(c.alias(f.name))
    return df.select(*cols)


def query(name: str, sql: str | None = None) -> Callable[[Build], Build]:
    def register(build: Build) -> Build:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = lambda spark, sf: _plain(build(spark, sf))
        if sql is not None:
            ORACLES[name] = sql
        return build

    return register
