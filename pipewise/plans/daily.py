"""The daily plan for all jobs at once, in its two halves.

Between them stands whoever answers the prompts: ``prompt_batch`` gives one
prompt per candidate script, ``settle`` takes the responses.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pipewise.functions import scan
from pipewise.functions.fixed_values import COOLDOWN_DAYS, RUNS_TO_AVERAGE, TOP_N
from pipewise.operators import (
    acceptance,
    changes,
    corpus,
    ledger,
    ranking,
    reporting,
    runs,
    sizes,
)
from pipewise.operators.topk import rank_in_group
from pipewise.sources.scratch import materialize


@dataclass(frozen=True)
class Day:
    """The tables a day starts from (columns as in the operators they go to)."""

    runs: DataFrame
    task_runs: DataFrame
    tasks: DataFrame
    job_clusters: DataFrame
    clusters: DataFrame
    node_weights: DataFrame | None
    scripts: DataFrame
    table_sizes: DataFrame
    path_sizes: DataFrame
    proposals: DataFrame
    applied: DataFrame
    as_of: str
    top_n: int = TOP_N
    cooldown_days: int = COOLDOWN_DAYS
    runs_to_average: int = RUNS_TO_AVERAGE
    self_task: str | None = None
    run_id: int | None = None


@dataclass(frozen=True)
class Candidates:
    """What the first half found; everything here is written to scratch once."""

    chosen_runs: DataFrame
    ranked: DataFrame
    gains: DataFrame
    candidates: DataFrame
    prompts: DataFrame


def prompt_batch(day: Day, ranks: tuple[int, int] | None = None) -> Candidates:
    """Rank, leave out what is in cooldown, scan and size the scripts.

    ``ranks`` (first, last) prepares only that stretch of each job's ranking, so
    that a caller can go on further down while too few candidates are accepted.
    No run at all is an error.

    The chosen runs are written first: their real size then decides whether
    the join with all task runs is a broadcast or a shuffle.
    """
    chosen = materialize(runs.latest_runs(day.runs, day.runs_to_average, day.run_id), "runs")
    if chosen.isEmpty():
        raise ValueError("no run of any job is known")
    durations = materialize(
        runs.avg_task_durations(day.task_runs, chosen, day.self_task), "durations"
    )
    weights = ranking.task_cost_weights(
        day.tasks, day.job_clusters, day.clusters, day.node_weights
    )
    scored = ranking.scored_tasks(durations, ranking.task_paths(day.tasks), weights)
    ranked = ranking.rank_by_cost(scored)
    cooled = ranking.cooled_tasks(day.applied, day.proposals, day.as_of, day.cooldown_days)
    gains = ranking.performance_gains(day.applied, day.proposals, durations, day.as_of)

    free = ranked.join(cooled, ["job_id", "task_key"], "left_anti")
    if ranks is not None:
        free = free.where(F.col("rank").between(*ranks))
    # only scripts of tasks in the ranking are scanned, each of them once
    in_ranking = day.scripts.join(
        free.select(F.col("script_path").alias("path")).distinct(), "path", "left_semi"
    )
    scanned = corpus.with_hash(corpus.scan_scripts(in_ranking)).withColumnRenamed(
        "path", "script_path"
    )
    history = ledger.rejected_history(day.proposals)
    candidates = materialize(
        free.join(scanned, "script_path", "left")
        .join(history, ["job_id", "task_key"], "left")
        .withColumn("duration_s", F.col("avg_s")),
        "candidates",
    )
    found = candidates.where(F.col("source").isNotNull()).withColumn("path", F.col("script_path"))
    # one script may serve several tasks: it is sized once
    texts = found.select("script_id", "source").dropDuplicates(["script_id"])
    context = sizes.size_context(
        texts, sizes.script_input_sizes(texts, day.table_sizes, day.path_sizes)
    )
    wanted = found.join(context, "script_id").withColumn("_task", F.struct("job_id", "task_key"))
    prompts = changes.prompt_rows(
        wanted.withColumn("script_id", F.struct("script_id", "_task"))
    ).select("script_id.script_id", "script_id._task.*", "prompt")
    return Candidates(chosen, ranked, gains, candidates, prompts)


@dataclass(frozen=True)
class Settled:
    """What the second half leads to."""

    rewrites: DataFrame
    reported: DataFrame
    proposals: DataFrame
    events: DataFrame
    report: DataFrame
    shown_gains: DataFrame
    """To be appended once the report is out."""


def rewrites_of(found: Candidates, responses: DataFrame, mode: str = "on") -> DataFrame:
    """The rewrite of every candidate with its outcome so far, and its check.

    ``responses`` has response_id, job_id, task_key, script_id and raw. A
    candidate whose script is missing is an export error, one without a usable
    response a failed call, one whose text stays the same no change.
    """
    # used twice below: written, so that each response is parsed once
    chosen = materialize(
        changes.choose_rewrite(changes.parse_responses(responses)), "chosen-rewrites"
    )
    rebuilt = changes.rebuild_scripts(chosen, found.candidates.select(
        "script_id", "source").where(F.col("source").isNotNull()).dropDuplicates(["script_id"]))
    answered = responses.select(
        "response_id", "job_id", "task_key", _known(responses, "llm_duration_s", "double")
    ).join(
        rebuilt.drop("script_id"), "response_id"
    ).join(chosen.select("response_id", "parsed"), "response_id")
    outcome = (
        F.when(F.col("source").isNull(), "export_error")
        .when(~F.coalesce("parsed", F.lit(False)), "llm_error")
        .when(F.col("no_change"), "no_changes")
    )
    rewritten = (
        found.candidates.join(answered, ["job_id", "task_key"], "left")
        .withColumn("outcome", outcome)
        .withColumn("check", scan.rewrite_check(F.col("tier"), F.col("side_effects"), mode))
    )
    return materialize(rewritten, "rewrites")


def _known(df: DataFrame, name: str, kind: str) -> Column:
    """A column that may be absent."""
    return (F.col(name) if name in df.columns else F.lit(None)).cast(kind).alias(name)


def settle(found: Candidates, rewrites: DataFrame, checked: DataFrame, day: Day, model: str,
           v2_dir: str = "proposals") -> Settled:
    """Accept candidates, and derive ledger rows and the report from them.

    ``checked`` has job_id, task_key and validation_status for the rewrites
    that were checked; all others count as skipped. Its validation_details,
    validation_run_id and lists of missing, added and changed columns go to the
    ledger and the cards where it has them.
    """
    details = [
        _known(checked, name, kind)
        for name, kind in [
            ("validation_details", "string"), ("validation_run_id", "bigint"),
            *[(f"{c}_columns", "array<string>") for c in ("missing", "added", "changed")],
        ]
    ]
    named = rewrites.join(
        checked.select("job_id", "task_key", "validation_status", *details),
        ["job_id", "task_key"], "left",
    ).withColumn(
        "outcome", F.coalesce("outcome", "validation_status", F.lit("skipped"))
    ).withColumn("rank_pos", F.col("rank"))
    # the report needs no text
    reported = materialize(
        acceptance.accept_candidates(named, day.top_n).drop("source", "rewrite"), "reported"
    )
    primary = found.chosen_runs.where(F.col("run_pos") == 1).select("job_id", "run_id")
    stamp = F.regexp_replace(F.lit(day.as_of[:10]), "-", "")
    has_v2 = F.col("accepted")
    error = F.when(
        F.col("outcome") == "llm_error", "no usable JSON object found in the response"
    ).when(F.col("outcome") == "export_error", "the script could not be read")
    analysis = F.when(
        F.col("outcome") == "llm_error", F.to_json(F.struct(error.alias("error")))
    ).otherwise(F.col("analysis"))
    rows = reported.join(primary, "job_id", "left").select(
        "*",
        F.when(
            F.col("in_ledger"),
            F.sha2(F.concat_ws("\x1f", "job_id", "task_key", F.lit(day.as_of)), 256),
        ).alias("proposal_id"),
        F.when(
            has_v2,
            F.concat(
                F.lit(f"{v2_dir}/"), F.col("job_id").cast("string"), F.lit("/"), F.col("task_key"),
                F.lit("_v2_"), stamp,
            ),
        ).alias("v2_path"),
        F.col("script_path").alias("original_path"),
        F.col("avg_s").alias("duration_original_s"),
        F.col("reason").alias("tier_reason"),
        analysis.alias("llm_analysis"),
        F.col("source_hash").alias("original_source_hash"),
        error.alias("error"),
    ).drop("validation_status")
    new_rows = ledger.proposal_rows(rows, day.as_of, model)
    placed = rows.join(positions(reported), ["job_id", "rank_pos"])
    report = reporting.report_rows(
        reporting.report_header(
            found.chosen_runs, reporting.report_labels(found.chosen_runs, reported), day.top_n,
            day.as_of,
        ),
        reporting.gain_lines(found.gains),
        reporting.proposal_cards(placed),
    )
    shown = ledger.mark_reported(day.applied, found.gains, day.as_of)
    return Settled(rewrites, reported, new_rows, ledger.proposed_events(new_rows), report, shown)


def positions(reported: DataFrame) -> DataFrame:
    """Place of each candidate in its job's report."""
    return rank_in_group(
        reported.select("job_id", "rank_pos"), ["job_id"], [("rank_pos", "asc")], rank="pos"
    )
