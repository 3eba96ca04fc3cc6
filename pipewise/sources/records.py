"""Landed run records and job definitions (JSON), with explicit schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RUN = (
    "run_id bigint, job_id bigint, tasks array<struct<task_key:string,"
    "state:struct<result_state:string>,start_time:bigint,end_time:bigint>>"
)
_CLUSTER = (
    "node_type_id:string,num_workers:int,autoscale:struct<max_workers:int>,runtime_engine:string"
)
JOB = (
    "job_id bigint, settings struct<tasks:array<struct<task_key:string,"
    "notebook_task:struct<notebook_path:string>,job_cluster_key:string,"
    "existing_cluster_id:string,depends_on:array<struct<task_key:string>>>>,"
    f"job_clusters:array<struct<job_cluster_key:string,new_cluster:struct<{_CLUSTER}>>>>"
)
CLUSTER = (
    "cluster_id string, node_type_id string, num_workers int, "
    "autoscale struct<max_workers:int>, runtime_engine string"
)


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RUN).json(path)


def read_jobs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(JOB).json(path)


def read_clusters(spark: SparkSession, path: str) -> DataFrame:
    """Existing clusters in the columns the ranking wants."""
    return spark.read.schema(CLUSTER).json(path).select(
        F.col("cluster_id").alias("cluster_key"), "node_type_id", "num_workers",
        F.col("autoscale.max_workers").alias("max_workers"), "runtime_engine",
    )


def run_tasks(runs: DataFrame) -> DataFrame:
    """One row per task of each run record; a record without tasks gives none."""
    return runs.select("job_id", "run_id", F.explode("tasks").alias("t")).select(
        "job_id", "run_id", F.col("t.task_key").alias("task_key"),
        F.col("t.state.result_state").alias("result_state"),
        F.col("t.start_time").alias("start_ms"), F.col("t.end_time").alias("end_ms"),
    )


def job_tasks(jobs: DataFrame) -> DataFrame:
    """One row per task of each job definition."""
    return jobs.select("job_id", F.explode("settings.tasks").alias("t")).select(
        "job_id", F.col("t.task_key").alias("task_key"),
        F.col("t.notebook_task.notebook_path").alias("script_path"),
        F.col("t.job_cluster_key").alias("job_cluster_key"),
        F.col("t.existing_cluster_id").alias("existing_cluster_id"),
    )


def job_dependencies(jobs: DataFrame) -> DataFrame:
    """One row per dependency; a task without any has one with NULL."""
    return (
        jobs.select("job_id", F.explode("settings.tasks").alias("t"))
        .select("job_id", "t.task_key", F.explode_outer("t.depends_on").alias("d"))
        .select("job_id", "task_key", F.col("d.task_key").alias("depends_on"))
    )


def job_clusters(jobs: DataFrame) -> DataFrame:
    """Clusters defined inside each job."""
    cluster = "c.new_cluster."
    return jobs.select("job_id", F.explode("settings.job_clusters").alias("c")).select(
        "job_id", F.col("c.job_cluster_key").alias("cluster_key"),
        F.col(cluster + "node_type_id").alias("node_type_id"),
        F.col(cluster + "num_workers").alias("num_workers"),
        F.col(cluster + "autoscale.max_workers").alias("max_workers"),
        F.col(cluster + "runtime_engine").alias("runtime_engine"),
    )
