"""The daily report as rows of text: job_id, section, pos, text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pipewise.functions import report, responses
from pipewise.functions.fixed_values import TOP_N


def change_bullets(proposals: DataFrame) -> DataFrame:
    """One bullet per change named in a proposal's analysis."""
    return (
        proposals.select(
            "proposal_id",
            F.posexplode(responses.applied_changes_of(F.col("analysis"))).alias("pos", "c"),
        )
        .select(
            "proposal_id", "pos",
            report.change_bullet(F.col("c.description"), F.col("c.savings")).alias("bullet"),
        )
    )


def validation_lines(proposals: DataFrame, url: str = "") -> DataFrame:
    """How far the checks of each proposal came.

    Optional columns: validation_run_id, and the name arrays missing_columns,
    added_columns and changed_columns.
    """
    line = _checked(proposals, F.col("validation_status"), url)
    return proposals.select("proposal_id", line.alias("line"))


def _checked(rows: DataFrame, status: Column, url: str | None) -> Column:
    """The validation line, with the run and the columns that differ where known."""
    def optional(name: str) -> Column | None:
        return F.col(name) if name in rows.columns else None

    return report.validation_line(
        F.col("tier"), status, optional("validation_run_id"),
        optional("missing_columns"), optional("added_columns"), optional("changed_columns"), url,
    )


def gain_lines(gains: DataFrame) -> DataFrame:
    line = report.gain_line(
        F.col("task_key"), F.col("status"), F.col("original_min"), F.col("current_min"),
        F.col("delta_pct"), F.col("applied_by"),
    )
    return gains.select("job_id", "task_key", line.alias("line"))


def counted_weight() -> Column:
    """The cost weight a report shows: errors and unchanged scripts have none (1)."""
    plain = F.col("outcome").isin("export_error", "llm_error", "no_changes")
    return F.when(plain, 1.0).otherwise(F.coalesce("cost_weight", F.lit(1.0)))


def report_labels(jobs: DataFrame, reported: DataFrame) -> DataFrame:
    """(job_id, rank_label) for every job: do weights count among what is reported?"""
    weighted = reported.groupBy("job_id").agg(
        F.bool_or(counted_weight() != 1.0).alias("weighted")
    )
    return jobs.select("job_id").distinct().join(weighted, "job_id", "left").select(
        "job_id",
        report.rank_label(F.coalesce("weighted", F.lit(False))).alias("rank_label"),
    )


def proposal_cards(reported: DataFrame, url: str | None = None) -> DataFrame:
    """One card per reported candidate.

    ``reported`` has job_id, pos (place in the report), task_key, tier,
    outcome, duration_s, cost_weight, analysis (JSON), error, v2_path and
    proposal_id; validation_run_id, missing_columns, added_columns and
    changed_columns are told too where it has them.
    """
    changes = responses.applied_changes_of(F.col("analysis"))
    status = F.col("outcome")
    text = F.concat_ws(
        "\n",
        report.card_heading(
            F.col("pos"), F.col("task_key"), F.col("tier"), status,
            F.col("duration_s") / 60.0, counted_weight(),
        ),
        F.concat(F.lit("_"), responses.summary_of(F.col("analysis")), F.lit("_")),
        report.card_body(status, F.col("error"), changes),
        report.card_footer(
            _checked(reported, status, url), F.col("v2_path"), F.col("proposal_id")
        ),
    )
    return reported.select("job_id", "pos", text.alias("card"))


def report_header(runs: DataFrame, labels: DataFrame, top_n: int = TOP_N,
                  as_of: str | None = None) -> DataFrame:
    """Head of each job's report: which runs, how many candidates, ranked by what.

    ``runs`` is the output of ``latest_runs``; only the first two are named, so
    only these are gathered. ``as_of`` adds a line with the date and time.
    """
    first_two = (
        runs.where(F.col("run_pos") <= 2)
        .groupBy("job_id")
        .agg(F.array_sort(F.collect_list(F.struct("run_pos", "run_id"))).alias("r"))
        .select("job_id", F.transform("r", lambda x: x["run_id"]).alias("run_ids"))
    )
    line = F.concat(
        report.run_label(F.col("run_ids")), F.lit(f"  ·  Top {top_n} "), F.col("rank_label"),
        F.lit(" notebooks"),
    )
    if as_of is not None:
        day = f"Daily optimization report  ·  {as_of[:10]}  ·  {as_of[11:16]} UTC\n"
        line = F.concat(F.lit(day), line)
    return labels.join(first_two, "job_id", "left").select("job_id", line.alias("header"))


def result_lines(outcome: DataFrame) -> DataFrame:
    """The audit line of every decision that took effect."""
    line = report.result_line(
        F.col("action"), F.col("task_key"), F.col("proposal_id"), F.col("notes")
    )
    return outcome.where(~F.col("result").isin("refused", "stale")).select(
        "proposal_id", "action", line.alias("line")
    )


def report_rows(header: DataFrame, gains: DataFrame, cards: DataFrame) -> DataFrame:
    """Header, gains and cards of every job as one table, ready for any sink."""
    top = header.select(
        "job_id", F.lit("1 header").alias("section"), F.lit("").alias("item"),
        F.col("header").alias("text"),
    )
    middle = gains.select(
        "job_id", F.lit("2 gains").alias("section"), F.col("task_key").alias("item"),
        F.col("line").alias("text"),
    )
    bottom = cards.select(
        "job_id", F.lit("3 cards").alias("section"),
        F.col("pos").cast("string").alias("item"), F.col("card").alias("text"),
    )
    return top.unionByName(middle).unionByName(bottom)
