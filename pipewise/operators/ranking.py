"""Which tasks cost most, which are in cooldown, what earlier changes gained.

tasks         job_id, task_key, script_path, job_cluster_key, existing_cluster_id
clusters      cluster_key, node_type_id, num_workers, max_workers, runtime_engine
              (job clusters may carry job_id too)
node weights  node_type_id, node_weight
proposals     proposal_id, job_id, task_key, duration_original_s, ...
applied       proposal_id, applied_ts, applied_by, rollback_ts, first_reported_ts
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pipewise.functions import cost, report
from pipewise.functions.fixed_values import (
    COOLDOWN_DAYS,
    PHOTON_MULTIPLIER,
    TOP_N,
)
from pipewise.operators.topk import first_row, rank_in_group, top_k

BY_SCORE = [("score", "desc"), ("task_key", "asc")]


def as_of_column(as_of: str | dt.datetime) -> Column:
    return F.lit(str(as_of)).cast("timestamp_ntz")


def task_paths(tasks: DataFrame) -> DataFrame:
    """Tasks that run a script, with its path."""
    return tasks.where(F.col("script_path").isNotNull()).select(
        "job_id", "task_key", "script_path"
    )


def cluster_specs(clusters: DataFrame) -> DataFrame:
    """Node type, workers and engine of each cluster, with their defaults.

    A fixed number of workers counts before the upper end of autoscaling, and
    zero workers is a number like any other.
    """
    keys = [c for c in ("job_id", "cluster_key") if c in clusters.columns]
    return clusters.select(
        *keys,
        F.coalesce("node_type_id", F.lit("")).alias("node_type"),
        F.coalesce("num_workers", "max_workers").cast("int").alias("workers"),
        (F.upper(F.coalesce("runtime_engine", F.lit(""))) == "PHOTON").alias("photon"),
    )


def weight_table(spark: SparkSession, weights: dict[str, float]) -> DataFrame:
    """The configured node weights as a table."""
    return spark.createDataFrame(
        sorted(weights.items()), "node_type_id string, node_weight double"
    )


def weigh_specs(specs: DataFrame, node_weights: DataFrame,
                photon_multiplier: float = PHOTON_MULTIPLIER) -> DataFrame:
    """Add ``cost_weight`` to rows with node_type, workers and photon."""
    weights = node_weights.select(F.col("node_type_id").alias("node_type"), "node_weight")
    return specs.join(weights, "node_type", "left").withColumn(
        "cost_weight",
        cost.cost_weight(
            F.col("node_weight"), F.col("workers"), F.col("photon"), photon_multiplier
        ),
    )


def task_cost_weights(tasks: DataFrame, job_clusters: DataFrame, clusters: DataFrame,
                      node_weights: DataFrame | None,
                      photon_multiplier: float = PHOTON_MULTIPLIER) -> DataFrame:
    """Cost weight of every task: its job cluster if known, else its existing
    cluster, else a cluster nothing is known about. No weight table: 1.0."""
    if node_weights is None:
        return tasks.select("job_id", "task_key", F.lit(1.0).alias("cost_weight"))

    def named(df: DataFrame, key: str, spec: str) -> DataFrame:
        extra = ["job_id"] if "job_id" in df.columns else []
        return cluster_specs(df).select(
            *extra, F.col("cluster_key").alias(key),
            F.struct("node_type", "workers", "photon").alias(spec),
        )

    on_job = named(job_clusters, "job_cluster_key", "_job_spec")
    on_own = named(clusters, "existing_cluster_id", "_own_spec")
    unknown = F.struct(
        F.lit("").alias("node_type"),
        F.lit(None).cast("int").alias("workers"),
        F.lit(False).alias("photon"),
    )
    job_keys = [c for c in ("job_id", "job_cluster_key") if c in on_job.columns]
    own_keys = [c for c in ("job_id", "existing_cluster_id") if c in on_own.columns]
    specs = (
        tasks.join(on_job, job_keys, "left")
        .join(on_own, own_keys, "left")
        .withColumn("_spec", F.coalesce("_job_spec", "_own_spec", unknown))
        .select("job_id", "task_key", "_spec.*")
    )
    return weigh_specs(specs, node_weights, photon_multiplier).select(
        "job_id", "task_key", "cost_weight"
    )


def scored_tasks(durations: DataFrame, paths: DataFrame, weights: DataFrame) -> DataFrame:
    """Mean durations of tasks that have a script, weighed by cluster cost."""
    return (
        durations.select("job_id", "task_key", "avg_s")
        .join(paths, ["job_id", "task_key"])
        .join(weights.select("job_id", "task_key", "cost_weight"), ["job_id", "task_key"], "left")
        .withColumn("cost_weight", F.coalesce("cost_weight", F.lit(1.0)))
        .withColumn("score", F.col("avg_s") * F.col("cost_weight"))
    )


def rank_by_cost(scored: DataFrame) -> DataFrame:
    """All tasks of each job, dearest first. Eager, see ``rank_in_group``."""
    return rank_in_group(scored, ["job_id"], BY_SCORE)


def rank_labels(scored: DataFrame) -> DataFrame:
    """How each job's ranking is to be called: are weights in play at all?"""
    return (
        scored.groupBy("job_id")
        .agg(F.bool_or(F.col("cost_weight") != 1.0).alias("weighted"))
        .withColumn("rank_label", report.rank_label(F.col("weighted")))
    )


def ranking_lines(ranked: DataFrame) -> DataFrame:
    """The ranking as lines of text."""
    return ranked.join(rank_labels(ranked), "job_id").select(
        "job_id", "rank",
        report.ranking_line(
            F.col("rank"), F.col("task_key"), F.col("avg_s"), F.col("cost_weight"),
            F.col("score"), F.col("weighted"),
        ).alias("line"),
    )


def cooled_tasks(applied: DataFrame, proposals: DataFrame, as_of: str | dt.datetime,
                 cooldown_days: int = COOLDOWN_DAYS) -> DataFrame:
    """Tasks changed within the last days, with the time of the last change."""
    now = as_of_column(as_of)
    recent = applied.where(
        F.lit(cooldown_days > 0)
        & F.col("rollback_ts").isNull()
        & (F.col("applied_ts") >= now - F.make_dt_interval(F.lit(cooldown_days)))
        & (F.col("applied_ts") <= now)
    )
    return (
        recent.select("proposal_id", "applied_ts")
        .join(proposals.select("proposal_id", "job_id", "task_key"), "proposal_id")
        .groupBy("job_id", "task_key")
        .agg(F.max("applied_ts").alias("last_applied"))
    )


def top_after_cooldown(scored: DataFrame, cooled: DataFrame, n: int = TOP_N) -> DataFrame:
    """The dearest tasks of each job that are not in cooldown."""
    free = scored.join(cooled, ["job_id", "task_key"], "left_anti")
    return top_k(free, ["job_id"], BY_SCORE, n)


def cooldown_skips(scored: DataFrame, cooled: DataFrame, as_of: str | dt.datetime) -> DataFrame:
    """The tasks passed over, with the whole days since their change."""
    age = F.timestamp_diff("DAY", F.col("last_applied"), as_of_column(as_of))
    return scored.select("job_id", "task_key").join(cooled, ["job_id", "task_key"]).select(
        "job_id", "task_key", age.cast("bigint").alias("days_ago")
    )


def leaf_tasks(dependencies: DataFrame, exclude: list[str] | None = None) -> DataFrame:
    """Tasks of each job that no other task waits for.

    ``dependencies`` has job_id, task_key and depends_on (NULL for none). What
    is waited for is made distinct before the join, so a task that everything
    waits for is one row there.
    """
    waited_for = (
        dependencies.where(F.col("depends_on").isNotNull())
        .select("job_id", F.col("depends_on").alias("task_key"))
        .distinct()
    )
    every = dependencies.select("job_id", "task_key").distinct()
    if exclude:
        every = every.where(~F.col("task_key").isin(exclude))
    return every.join(waited_for, ["job_id", "task_key"], "left_anti")


def performance_gains(applied: DataFrame, proposals: DataFrame, durations: DataFrame,
                      as_of: str | dt.datetime) -> DataFrame:
    """What the newest unreported change of each task gained.

    Only changes of an earlier day that were not rolled back; a task without a
    current duration did not run.
    """
    pending = applied.where(
        (F.to_date("applied_ts") < F.to_date(as_of_column(as_of)))
        & F.col("rollback_ts").isNull()
        & F.col("first_reported_ts").isNull()
    ).select("proposal_id", "applied_ts", "applied_by")
    changes = pending.join(
        proposals.select("proposal_id", "job_id", "task_key", "duration_original_s"),
        "proposal_id",
    )
    newest = first_row(
        changes, ["job_id", "task_key"], [("applied_ts", "desc"), ("proposal_id", "asc")]
    )
    pct = cost.gain_pct(F.col("duration_original_s"), F.col("avg_s"))
    return newest.join(
        durations.select("job_id", "task_key", "avg_s"), ["job_id", "task_key"], "left"
    ).select(
        "proposal_id", "job_id", "task_key",
        (F.coalesce("duration_original_s", F.lit(0.0)) / 60.0).alias("original_min"),
        (F.col("avg_s") / 60.0).alias("current_min"),
        pct.alias("delta_pct"),
        cost.user_part(F.col("applied_by")).alias("applied_by"),
        cost.gain_status(F.col("avg_s"), pct).alias("status"),
    )
