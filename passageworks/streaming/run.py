"""Running a stream to the end of what its source holds now."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from passageworks.functions.scale import shared_folder

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def event_stream(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A given parquet table as a stream of files."""
    path = f"{root}/{name}.parquet"
    return spark.readStream.schema(spark.read.parquet(path).schema).option("pathGlobFilter", f"{name}.parquet").parquet(root)


def drain(stream: DataFrame, mode: str = "update", latest_by: list[str] | None = None) -> DataFrame:
    """Process all available input and return what was emitted, as a table in the shared folder.

    With ``latest_by`` only the last emission of each key is returned. Emissions carry their batch
    number and a batch replaces its own folder, so a batch that is repeated is not counted twice."""
    spark = stream.sparkSession
    provider = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    base = f"{shared_folder(spark)}/stream-{uuid4().hex}"

    def sink(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{base}/out/batch={batch}")

    try:
        q = (stream.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).foreachBatch(sink).start())
        q.awaitTermination()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", provider)
    out = spark.read.schema(stream.schema.add("batch", "long")).parquet(f"{base}/out")
    if latest_by:
        cols = [c for c in out.columns if c not in latest_by and c != "batch"]
        out = out.groupBy(*latest_by).agg(F.max_by(F.struct(*cols), "batch").alias("x")).select(*latest_by, "x.*")
        return out
    return out.drop("batch")
