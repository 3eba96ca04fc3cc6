"""From raw documents to packed training windows, a stage at a time.

Each stage takes all its predecessor kept, reread from Parquet in the shared
folder; all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pipewise.llm import decontamination, line_dedup, near_copies, packing, quality
from pipewise.llm.shared import read, tokenizer_path
from pipewise.sources.scratch import materialize


def keep_good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts (score 0.5 or more)."""
    model = quality.fit(docs, read(spark, sf_dir, "labels"))
    return quality.keep_good(docs, model)


def drop_shared_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that ten or more of them share."""
    return line_dedup.drop_repeated_lines(docs)


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, 0.8 or more alike)."""
    return near_copies.keep_one_of_each(docs, similarity=0.8, shingle=5)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, as written or asked again."""
    return decontamination.drop_contaminated(docs, read(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in windows of 2048 tokens."""
    return packing.pack_documents(docs, tokenizer_path())


STAGES = [
    ("quality_classifier", keep_good_quality),
    ("line_dedup", drop_shared_lines),
    ("simhash_near_dedup", keep_one_of_near_copies),
    ("benchmark_decontamination", drop_benchmark_leaks),
    ("packing", pack),
]

ORACLE_SQL = None
"""SQL can fit no classifier and pack no window; the tests hold the stages
against a brute-force version."""


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
