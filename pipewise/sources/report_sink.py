"""Where the report goes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pipewise.sources.scratch import materialize

JOBS = 200
"""Jobs that a task writes."""
JOB_ROWS = 100_000
"""A job with more rows is written by several tasks."""


def write_report(rows: DataFrame, path: str, form: str = "json") -> None:
    """Write report rows, a folder per job; ``form`` is json or text.

    What takes time is a folder and a file for every job, however few the bytes.
    So the rows are written first and counted by job, and tasks are dealt a
    number of jobs; a job with most of the rows is dealt to several.
    """
    if form not in ("json", "text"):
        raise ValueError(f"unknown form {form!r}")
    rows = _dealt_by_job(materialize(rows, "report-rows"))
    if form == "json":
        rows.write.partitionBy("job_id").json(path)
    else:
        lines = rows.select("job_id", F.concat_ws("\t", "section", "item", "text").alias("value"))
        lines.write.partitionBy("job_id").text(path)


def _dealt_by_job(rows: DataFrame) -> DataFrame:
    sizes = rows.groupBy("job_id").agg(F.ceil(F.count("*") / JOB_ROWS).alias("_parts"))
    jobs, parts = sizes.agg(F.count("*"), F.sum("_parts")).first()
    large = sizes.where("_parts > 1")
    part = F.pmod(F.xxhash64(*rows.columns), F.col("_parts"))
    dealt = rows.join(large, "job_id", "left").withColumn("_part", part)
    n = jobs // JOBS + (parts or 0) - jobs + 1
    return dealt.repartition(n, "job_id", "_part").select(rows.columns)
