"""Runs and task durations, for all jobs at once.

runs       job_id, run_id, start_ms, is_active
task runs  job_id, run_id, task_key, result_state, start_ms, end_ms
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pipewise.functions.fixed_values import RUNS_TO_AVERAGE
from pipewise.operators.topk import first_row, top_k

NEWEST_RUN = [("is_active", "desc"), ("start_ms", "desc"), ("run_id", "desc")]


def latest_runs(runs: DataFrame, n: int = RUNS_TO_AVERAGE,
                run_id: int | None = None) -> DataFrame:
    """The newest active run of each job, then its newest completed ones, up to n.

    A given ``run_id`` stands in for the choice. ``run_pos`` counts from 1.
    """
    if run_id is not None:
        return runs.where(F.col("run_id") == run_id).withColumn("run_pos", F.lit(1))
    active = first_row(runs.where("is_active"), ["job_id"], NEWEST_RUN)
    # a run whose flag is not known counts as completed
    pool = runs.where("NOT coalesce(is_active, false)").unionByName(active)
    return top_k(pool, ["job_id"], NEWEST_RUN, n, rank="run_pos")


def jobs_without_runs(jobs: DataFrame, runs: DataFrame) -> DataFrame:
    """Jobs for which no run is known; the caller decides whether to stop."""
    return jobs.select("job_id").distinct().join(
        runs.select("job_id").distinct(), "job_id", "left_anti"
    )


def succeeded() -> Column:
    """A finished, successful task run with usable times."""
    return (
        (F.col("result_state") == "SUCCESS")
        & (F.col("start_ms") != 0)
        & (F.col("end_ms") != 0)
    )


def task_durations(task_runs: DataFrame) -> DataFrame:
    """Duration of each successful task of each run; a repeated task counts once,
    with the record that ended last."""
    newest = F.max(F.struct("end_ms", "start_ms")).alias("m")
    return (
        task_runs.where(succeeded())
        .groupBy("job_id", "run_id", "task_key")
        .agg(newest)
        .select(
            "job_id", "run_id", "task_key",
            (F.col("m.end_ms") - F.col("m.start_ms")).alias("duration_ms"),
            ((F.col("m.end_ms") - F.col("m.start_ms")) / 1000.0).alias("duration_s"),
        )
    )


def avg_task_durations(task_runs: DataFrame, chosen_runs: DataFrame,
                       self_task: str | None = None) -> DataFrame:
    """Mean duration of each task over the runs in which it succeeded.

    The runs are chosen before anything is grouped, so that only their task
    records are shuffled. Milliseconds are summed as integers and divided
    once: the same answer in any order of addition.
    """
    wanted = task_runs
    if self_task is not None:
        wanted = wanted.where(F.col("task_key") != self_task)
    wanted = wanted.join(chosen_runs.select("job_id", "run_id"), ["job_id", "run_id"], "left_semi")
    return (
        task_durations(wanted)
        .groupBy("job_id", "task_key")
        .agg(
            (F.sum("duration_ms") / F.count(F.lit(1)) / 1000.0).alias("avg_s"),
            F.count(F.lit(1)).alias("n_runs"),
        )
    )
