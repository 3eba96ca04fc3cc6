import pytest
from pyspark.sql import types as T


@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents from (doc_id, text) pairs, with columns whose names may clash."""
    schema = T.StructType(
        [
            T.StructField("doc_id", T.LongType()),
            T.StructField("text", T.StringType()),
            T.StructField("lang", T.StringType()),
            T.StructField("source", T.StringType()),
            T.StructField("n_chars", T.LongType()),
            *[
                T.StructField(n, T.StringType())
                for n in ("id", "row", "pos", "line", "key", "digest", "mark", "component", "bucket")
            ],
        ]
    )

    def make(pairs):
        rows = [
            (i, t, "en", "src0", None if t is None else len(t), *["x"] * 9) for i, t in pairs
        ]
        return spark.createDataFrame(rows, schema)

    return make


@pytest.fixture(scope="session")
def table(spark, sf):
    def read(name):
        return spark.read.parquet(f"{sf}/{name}.parquet")

    return read
