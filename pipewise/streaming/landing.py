"""Run records that keep arriving.

The record and script operators that work inside a row (flattening, durations
of single records, scans, parsing) take a streaming DataFrame as they are; what
is here reads newly landed records and appends them to a table once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from pipewise.sources.records import RUN, run_tasks


def landed_task_runs(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    """Task records of run files as they land."""
    runs = spark.readStream.schema(RUN).option("maxFilesPerTrigger", files_per_batch).json(path)
    return run_tasks(runs)


def append_landed(task_runs: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append all that has landed so far, then stop; each file is taken once."""
    return (
        task_runs.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
