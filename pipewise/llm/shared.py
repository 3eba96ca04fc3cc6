"""What several of the text operators need."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WHITE = " \t\n\x0b\x0c\r"
"""The white space of words and line ends; no other character counts as white."""


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    """Where the installed vocabulary file of the registered queries lies."""
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))


def text_of(column: str | Column) -> Column:
    """The text, empty where it is null."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def ascii_lower(column: Column) -> Column:
    """A-Z in lower case, all other letters unchanged."""
    return F.translate(column, UPPER, LOWER)


def digest128(column: Column, salt: str = "second") -> Column:
    """Two independent 64-bit hashes: equal digests mean equal texts at any size."""
    return F.struct(F.xxhash64(column).alias("a"), F.xxhash64(F.lit(salt), column).alias("b"))


def whole_row(df: DataFrame) -> Column:
    """All columns of a row as one value, so that no name can clash with ours."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns])


def unpacked(df: DataFrame, packed: str, like: DataFrame, **changed: Column) -> DataFrame:
    """The columns of ``like`` back from ``whole_row``, some with new values."""
    return df.select(
        *[
            (changed[c] if c in changed else F.col(f"`{packed}`.`{c}`")).alias(c)
            for c in like.columns
        ]
    )


_ARROW = {
    "long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(),
    "boolean": pa.bool_(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64()),
    "array<string>": pa.list_(pa.string()),
}


def record_batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    """Rows under a schema written as ``name type, name type``."""
    named = [c.split() for c in schema.split(", ")]
    columns = list(zip(*rows)) if rows else [[] for _ in named]
    arrays = [pa.array(c, _ARROW[kind]) for c, (_, kind) in zip(columns, named)]
    return pa.RecordBatch.from_arrays(arrays, names=[name for name, _ in named])
