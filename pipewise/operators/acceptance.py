"""Walking down a ranking until enough candidates are accepted."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pipewise.functions.fixed_values import (
    NEITHER_REPORTED_NOR_COUNTED,
    REPORTED_NOT_COUNTED,
    TOP_N,
)
from pipewise.operators.topk import top_k


def accept_candidates(outcomes: DataFrame, top_n: int = TOP_N) -> DataFrame:
    """Candidates that get into the report, up to the n-th accepted one.

    ``outcomes`` has job_id, rank_pos and outcome. The walk of a job ends at
    its n-th accepted candidate, so it is enough to find that one row per job:
    the groups are cut to n rows before the shuffle, and no window runs over
    all candidates of a job. ``in_ledger`` marks the rows the ledger gets.
    """
    if top_n <= 0:
        reached = outcomes.where(F.lit(False))
    else:
        counted = outcomes.where(
            ~F.col("outcome").isin(REPORTED_NOT_COUNTED + NEITHER_REPORTED_NOR_COUNTED)
        )
        ends = (
            top_k(counted.select("job_id", "rank_pos"), ["job_id"], [("rank_pos", "asc")], top_n)
            .where(F.col("rank") == top_n)
            .select("job_id", F.col("rank_pos").alias("_end"))
        )
        reached = outcomes.join(ends, "job_id", "left").where(
            F.col("_end").isNull() | (F.col("rank_pos") <= F.col("_end"))
        ).drop("_end")
    accepted = ~F.col("outcome").isin(REPORTED_NOT_COUNTED)
    return (
        reached.where(~F.col("outcome").isin(NEITHER_REPORTED_NOR_COUNTED))
        .withColumn("accepted", accepted)
        .withColumn("in_ledger", accepted | (F.col("outcome") == "llm_error"))
    )


def run_summary(accepted: DataFrame) -> DataFrame:
    """Reported, accepted and failed candidates of each job."""
    return accepted.groupBy("job_id").agg(
        F.count(F.lit(1)).alias("n_reported"),
        F.count_if("accepted").alias("n_accepted"),
        F.count_if(~F.col("accepted")).alias("n_not_accepted"),
    )
