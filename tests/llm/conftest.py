import pytest


@pytest.fixture
def table(spark, tmp_path_factory):
    """A DataFrame read from files, as the operators expect it."""

    def make(rows, schema, parts=3):
        path = str(tmp_path_factory.mktemp("table") / "t.parquet")
        spark.createDataFrame(rows, schema).repartition(parts).write.parquet(path)
        return spark.read.schema(schema).parquet(path)

    return make
