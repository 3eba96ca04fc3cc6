"""Labelled rows for fitting, of which a bounded number is used."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo; null for a row without id."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(modulus))


def sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int, train: Column) -> DataFrame:
    """(rank, label, text): at most ``per_class`` labelled texts of either class.

    ``train`` is a condition on ``doc_id``. The rows with the smallest hashes of
    their id (``rank``) are taken, so the choice is the same in every run and
    independent of any other column. Ids are chosen first, at most ``per_class``
    leaving any task; then their texts are fetched by a join whose small side is
    bounded by twice ``per_class`` rows. Labels other than 0 and 1, and labels
    without a document, are left out; of several labels or texts for one id the
    smallest is used.
    """
    known = labels.select(F.col("doc_id"), F.col(label).alias("label"))
    known = known.filter(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull() & train)
    known = known.groupBy("doc_id").agg(F.min("label").alias("label"))
    ranked = known.withColumn("rank", F.xxhash64(F.lit("sample"), "doc_id"))
    zeros, ones = [
        ranked.filter(F.col("label") == value).orderBy("rank", "doc_id").limit(per_class)
        for value in (0, 1)
    ]
    chosen = zeros.unionByName(ones)
    texts = docs.select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    found = texts.join(F.broadcast(chosen), F.col("id") == F.col("doc_id"))
    return found.groupBy("rank", "label").agg(F.min("text").alias("text"))
