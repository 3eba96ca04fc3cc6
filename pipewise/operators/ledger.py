"""Proposals and their state, kept as an append-only log of events.

events     proposal_id, event_ts, seq, status, actor, notes
           (``event_ts, seq`` is a total order within a proposal)
state      proposal_id, task_key, original_path, v2_path, stored_hash, tier,
           validation_status, status, notes
decisions  proposal_id, action, actor, decided_ts, notes
applied    proposal_id, applied_ts, backup_path, rollback_ts, ...
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pipewise.functions import cost, responses, text
from pipewise.functions.fixed_values import (
    HISTORY_DEPTH,
    HISTORY_HEADER,
    ROLLBACK_NOTE,
    STALE_NOTE,
)
from pipewise.operators.ranking import as_of_column
from pipewise.operators.topk import first_row, top_k
from pipewise.sources.scratch import materialize

EVENT_COLUMNS = ["proposal_id", "event_ts", "seq", "status", "actor", "notes"]
DETAIL_COLUMNS = [
    "proposal_id", "created_ts", "task_key", "original_path", "v2_path", "duration_original_s",
    "tier", "target_tables", "side_effects", "validation_status", "llm_analysis", "status",
    "status_updated_ts",
]


def ledger_current(events: DataFrame) -> DataFrame:
    """State of every proposal: its last event. A proposal with very many
    events leaves one row per map task."""
    last = F.max_by(F.struct("status", "event_ts", "actor", "notes"), F.struct("event_ts", "seq"))
    return events.groupBy("proposal_id").agg(last.alias("e")).select(
        "proposal_id", "e.status", F.col("e.event_ts").alias("status_updated_ts"),
        F.col("e.actor").alias("status_updated_by"), "e.notes",
    )


def proposal_details(proposals: DataFrame, current: DataFrame) -> DataFrame:
    """What a reviewer is shown of each proposal."""
    stated = proposals.drop("status", "status_updated_ts").join(
        current.select("proposal_id", "status", "status_updated_ts"), "proposal_id", "left"
    )
    return stated.select(*DETAIL_COLUMNS)


def latest_applied(applied: DataFrame) -> DataFrame:
    """The newest applied change of each proposal; of two at one time the one
    whose backup path is smaller."""
    return first_row(
        applied, ["proposal_id"], [("applied_ts", "desc"), ("backup_path", "asc")]
    )


def stale_proposals(state: DataFrame, scripts: DataFrame) -> DataFrame:
    """Proposals whose script was edited since they were made."""
    hashes = scripts.select(
        F.col("path").alias("original_path"), F.sha2("source", 256).alias("current_hash")
    )
    return state.join(hashes, "original_path").where(
        cost.is_stale(F.col("stored_hash"), F.col("current_hash"))
    ).select("proposal_id", "original_path", "stored_hash", "current_hash")


# --- decisions --------------------------------------------------------------

_OPEN = ["proposed", "approved"]


def _refusal(action: Column, status: Column, v2_path: Column) -> Column:
    """Why an action cannot be taken on a proposal in this state; NULL if it can."""
    return (
        F.when(status.isNull(), "proposal does not exist")
        .when(~action.isin("approve", "reject", "rollback"),
              F.concat(F.lit("invalid action '"), action, F.lit("'")))
        .when((action == "approve") & ~status.isin(_OPEN),
              F.concat(F.lit("current status is '"), status, F.lit("', cannot approve")))
        .when((action == "approve") & v2_path.isNull(), "there is no new script to apply")
        .when((action == "reject") & (status != "proposed"),
              F.concat(F.lit("current status is '"), status, F.lit("', cannot reject")))
        .when((action == "rollback") & (status != "applied"),
              F.concat(F.lit("can only rollback a proposal with status='applied', "
                             "current status: '"), status, F.lit("'")))
    )


def decision_guard(decisions: DataFrame, state: DataFrame) -> DataFrame:
    """Each decision on its own against the current state: allowed or why not.

    ``warn`` marks approvals of a green proposal that was neither checked
    through nor left unchecked on purpose.
    """
    joined = decisions.select("proposal_id", "action", "actor", "decided_ts").join(
        state.select("proposal_id", "status", "v2_path", "tier", "validation_status"),
        "proposal_id", "left",
    )
    refusal = _refusal(F.col("action"), F.col("status"), F.col("v2_path"))
    return joined.select(
        "proposal_id", "action", "decided_ts",
        refusal.isNull().alias("valid"),
        F.coalesce(refusal, F.lit("")).alias("reason"),
        F.coalesce(
            (F.col("action") == "approve") & refusal.isNull() & (F.col("tier") == "green")
            & ~F.col("validation_status").isin("passed", "skipped"),
            F.lit(False),
        ).alias("warn"),
    )


def apply_decisions(decisions: DataFrame, state: DataFrame, scripts: DataFrame,
                    applied: DataFrame) -> DataFrame:
    """What becomes of every decision of a batch, taken in order of time.

    A proposal can be closed once (approve, which may find it stale, or reject)
    and an applied one rolled back once, so it is enough to know the first
    closing decision and the first rollback after it. Both are minima, which
    are combined before the shuffle; no window runs over the decisions of one
    proposal. Approvals and rollbacks change the script, so after the first of
    them in a batch every further approval for that script that has a stored
    hash is stale. This holds even if a later rollback brings the old text
    back: such a proposal has to be made again.

    ``result``: applied, stale, rejected, rolled_back or refused (``reason``).
    Eager: the decisions, and with the state they meet, are written once, so that
    the ledger and the scripts are scanned once.
    """
    moment = F.struct("decided_ts", "action", "actor")
    decisions = materialize(decisions, "decisions-given")
    named = decisions.select("proposal_id").distinct()
    last = latest_applied(applied.join(named, "proposal_id", "left_semi")).select(
        "proposal_id", F.lit(True).alias("was_applied"), "rollback_ts", "backup_path"
    )
    known = (
        state.select("proposal_id", "task_key", "original_path", "v2_path", "stored_hash",
                     F.col("status").alias("before"), F.col("notes").alias("old_notes"))
        .join(named, "proposal_id", "left_semi")
        .join(last, "proposal_id", "left")
    )
    known = materialize(known, "decisions-known")
    # from the decisions outward: only scripts they are about are hashed
    wanted = known.select(F.col("original_path").alias("path")).distinct()
    hashes = scripts.join(wanted, "path", "left_semi").select(
        F.col("path").alias("original_path"), F.sha2("source", 256).alias("current_hash")
    )
    kept = known.where("backup_path IS NOT NULL").select(F.col("backup_path").alias("path")).distinct()
    backups = scripts.select("path").join(kept, "path", "left_semi").select(
        F.col("path").alias("backup_path"), F.lit(True).alias("has_backup")
    )
    # proposals without a backup have keys of their own, not all the same null
    place = F.coalesce("backup_path", F.concat(F.lit("\0"), F.col("proposal_id")))
    backups = backups.withColumnRenamed("backup_path", "_place")
    known = known.join(hashes, "original_path", "left").withColumn("_place", place)
    known = known.join(backups, "_place", "left").drop("_place")
    asked = materialize(
        decisions.join(known, "proposal_id", "left").withColumn("at", moment), "decisions-asked"
    )

    approvable = (
        (F.col("action") == "approve") & F.col("before").isin(_OPEN)
        & F.col("v2_path").isNotNull() & F.col("current_hash").isNotNull()
    )
    rejectable = (F.col("action") == "reject") & (F.col("before") == "proposed")
    closing = asked.where(approvable | rejectable).groupBy("proposal_id").agg(
        F.min(
            F.struct("at", "original_path", "stored_hash", "current_hash", "notes")
        ).alias("c")
    ).select("proposal_id", F.col("c.at").alias("closed_at"), "c.original_path",
             "c.stored_hash", "c.current_hash", F.col("c.notes").alias("closing_notes"))
    fresh = ~F.coalesce(
        cost.is_stale(F.col("stored_hash"), F.col("current_hash")), F.lit(False)
    )
    applied_before = (
        (F.col("before") == "applied") & F.col("was_applied") & F.col("rollback_ts").isNull()
        & F.col("has_backup")
    )
    rolls_back = F.col("action") == "rollback"
    restored = asked.where(rolls_back & applied_before).groupBy("original_path", "proposal_id").agg(
        F.min("at").alias("at")
    )
    replaced = closing.where((F.col("closed_at.action") == "approve") & fresh).select(
        "original_path", "proposal_id", F.col("closed_at").alias("at")
    )
    first_on_script = (
        replaced.unionByName(restored)
        .groupBy("original_path")
        .agg(F.min(F.struct(F.col("at").alias("closed_at"), "proposal_id")).alias("first"))
    )
    guarded = F.coalesce(F.col("stored_hash"), F.lit("")) != ""
    later = F.struct("closed_at", "proposal_id") > F.col("first")
    closed = closing.join(first_on_script, "original_path", "left").select(
        "proposal_id", "closed_at", "closing_notes",
        F.when(F.col("closed_at.action") == "reject", "rejected")
        .when(~fresh | (guarded & F.coalesce(later, F.lit(False))), "stale")
        .otherwise("applied").alias("closed_as"),
    )
    judged = asked.join(closed, "proposal_id", "left")

    can_undo = (F.col("closed_as") == "applied") & (F.col("at") > F.col("closed_at"))
    undone = judged.where(rolls_back & (can_undo | applied_before)).groupBy("proposal_id").agg(
        F.min("at").alias("undone_at")
    )
    judged = judged.join(undone, "proposal_id", "left")

    status_then = (
        F.when(F.col("at") > F.col("undone_at"), "rejected")
        .when(F.col("at") > F.col("closed_at"), F.col("closed_as"))
        .otherwise(F.col("before"))
    )
    refusal = F.coalesce(
        _refusal(F.col("action"), status_then, F.col("v2_path")),
        F.when((F.col("action") == "approve"), "the script does not exist"),
        F.when(F.col("was_applied").isNull(), "no applied change found"),
        F.when(F.col("rollback_ts").isNotNull(), "already rolled back"),
        F.lit("the backup text is missing"),
    )
    result = (
        F.when(F.col("at") == F.col("closed_at"), F.col("closed_as"))
        .when(F.col("at") == F.col("undone_at"), "rolled_back")
        .otherwise("refused")
    )
    # an approval earlier in the batch has already replaced the note
    notes_then = F.when(F.col("at") > F.col("closed_at"), F.col("closing_notes")).otherwise(
        F.col("old_notes")
    )
    return judged.withColumn("result", result).select(
        "proposal_id", "task_key", "original_path", "v2_path",
        F.when(F.col("before") == "applied", F.col("backup_path")).alias("backup_path"),
        "action", "actor", "decided_ts", "notes", notes_then.alias("old_notes"), "result",
        F.when(F.col("result") == "refused", refusal).otherwise("").alias("reason"),
    )


def decision_events(outcome: DataFrame) -> DataFrame:
    """The ledger events of the decisions that took effect: one append."""
    old = F.coalesce("old_notes", F.lit(""))
    return outcome.where(F.col("result") != "refused").select(
        "proposal_id",
        F.col("decided_ts").alias("event_ts"),
        F.when(F.col("result") == "rolled_back", 3).otherwise(2).alias("seq"),
        F.when(F.col("result") == "rolled_back", "rejected")
        .otherwise(F.col("result")).alias("status"),
        "actor",
        F.when(F.col("result") == "stale", F.concat(old, F.lit(STALE_NOTE)))
        .when(F.col("result") == "rolled_back", F.concat(old, F.lit(ROLLBACK_NOTE)))
        .otherwise(F.col("notes")).alias("notes"),
    )


def backup_place(backup_dir: str) -> Column:
    """Where the text goes that an approval replaces: a path per proposal and time."""
    stamp = F.date_format("decided_ts", "yyyyMMdd_HHmmss")
    return F.concat(
        F.lit(f"{backup_dir}/"), F.col("task_key"), F.lit("_"), F.col("proposal_id"), F.lit("_"),
        stamp,
    )


def applied_rows(outcome: DataFrame, backup_dir: str = "backups") -> DataFrame:
    """A row for every change that went in, with the place of its backup."""
    return outcome.where(F.col("result") == "applied").select(
        F.col("decided_ts").alias("applied_ts"), "proposal_id",
        F.col("original_path").alias("script_path"),
        backup_place(backup_dir).alias("backup_path"),
        F.col("actor").alias("applied_by"),
        F.lit(None).cast("timestamp_ntz").alias("rollback_ts"),
        F.lit(None).cast("string").alias("rollback_by"),
        F.lit(None).cast("timestamp_ntz").alias("first_reported_ts"),
    )


def rollback_rows(outcome: DataFrame) -> DataFrame:
    """Which proposals' applied changes were undone, when and by whom."""
    return outcome.where(F.col("result") == "rolled_back").select(
        "proposal_id", F.col("decided_ts").alias("rollback_ts"), F.col("actor").alias("rollback_by")
    )


def applied_state(applied: DataFrame, rollbacks: DataFrame, reported: DataFrame) -> DataFrame:
    """Applied changes with what was logged about them later; first news stay.

    ``applied`` are rows as they were appended, ``rollbacks`` the output of
    ``rollback_rows`` and ``reported`` that of ``mark_reported``. A rollback
    counts for the changes of its proposal that came before it.
    """
    undone = rollbacks.groupBy("proposal_id").agg(
        F.max(F.struct("rollback_ts", "rollback_by")).alias("_undone")
    )
    shown = reported.groupBy("proposal_id").agg(F.min("first_reported_ts").alias("_shown"))
    old = F.struct("rollback_ts", "rollback_by")
    late = F.when(F.col("_undone.rollback_ts") >= F.col("applied_ts"), F.col("_undone"))
    now = F.when(F.col("rollback_ts").isNotNull(), old).otherwise(late)
    return (
        applied.join(undone, "proposal_id", "left")
        .join(shown, "proposal_id", "left")
        .withColumn("_now", now)
        .withColumn("rollback_ts", F.col("_now.rollback_ts"))
        .withColumn("rollback_by", F.col("_now.rollback_by"))
        .withColumn("first_reported_ts", F.coalesce("first_reported_ts", "_shown"))
        .drop("_undone", "_shown", "_now")
    )


def script_changes(outcome: DataFrame) -> DataFrame:
    """(original_path, proposal_id, result, base, now, last, decided_ts, task_key):
    the changes of a batch, script by script.

    ``base`` and ``now`` are the paths of the text that a change finds and that
    it leaves: its new script, the backup of an earlier batch, or for a change
    undone within the batch what its approval found. The changes of one script
    in one batch come as an array and are gone through in order of time.
    """
    changed = outcome.where(F.col("result").isin("applied", "rolled_back"))
    step = F.struct(
        "decided_ts", "action", "actor", "proposal_id", "result", "v2_path", "backup_path",
        "task_key",
    )
    told = changed.groupBy("original_path").agg(F.array_sort(F.collect_list(step)).alias("steps"))
    change = "struct<proposal_id:string,result:string,base:string,now:string,decided_ts:timestamp_ntz,task_key:string>"

    def after(state: Column, s: Column) -> Column:
        own = F.get(
            F.filter(state["done"], lambda d: (d["proposal_id"] == s["proposal_id"])
                     & (d["result"] == "applied")), 0
        )
        now = F.when(s["result"] == "applied", s["v2_path"]).otherwise(
            F.coalesce(own["base"], s["backup_path"])
        )
        row = F.struct(
            s["proposal_id"], s["result"], state["text"], now, s["decided_ts"], s["task_key"]
        ).cast(change)
        return F.struct(now.alias("text"), F.concat(state["done"], F.array(row)).alias("done"))

    start = F.struct(
        F.col("original_path").alias("text"), F.array().cast(f"array<{change}>").alias("done")
    )
    done = F.aggregate("steps", start, after, lambda state: state["done"])
    rows = told.select("original_path", F.size("steps").alias("n"), F.posexplode(done).alias("k", "c"))
    return rows.select("original_path", "c.*", (F.col("k") == F.col("n") - 1).alias("last"))


def script_updates(outcome: DataFrame, scripts: DataFrame) -> DataFrame:
    """New text of each script that changed; its last change in the batch wins.

    ``scripts`` holds all texts by path: current ones, new ones and backups.
    """
    newest = script_changes(outcome).where("last").select("original_path", F.col("now").alias("path"))
    return newest.join(scripts.select("path", "source"), "path").select(
        F.col("original_path").alias("path"), "source"
    )


def script_backups(outcome: DataFrame, scripts: DataFrame,
                   backup_dir: str = "backups") -> DataFrame:
    """(path, source) of the text that each approval replaces, under its backup path."""
    replaced = script_changes(outcome).where(F.col("result") == "applied").select(
        F.col("base").alias("path"), backup_place(backup_dir).alias("backup_path")
    )
    return replaced.join(scripts.select("path", "source"), "path").select(
        F.col("backup_path").alias("path"), "source"
    )


def mark_reported(applied: DataFrame, gains: DataFrame, reported_ts: str | dt.datetime,
                  sent: bool = True) -> DataFrame:
    """Events for the gains that were shown, if the report went out."""
    return (
        applied.where(F.col("first_reported_ts").isNull() & F.lit(sent))
        .select("proposal_id", "applied_ts")
        .join(gains.select("proposal_id"), "proposal_id", "left_semi")
        .withColumn("first_reported_ts", as_of_column(reported_ts))
    )


# --- rejected history -------------------------------------------------------


def rejected_history(proposals: DataFrame, depth: int = HISTORY_DEPTH) -> DataFrame:
    """What was turned down lately for each task, as text.

    ``proposals`` has job_id, task_key, created_ts, proposal_id, status and
    analysis (JSON). Tasks with nothing to tell are left out.
    """
    latest = top_k(
        proposals.where(F.col("status") == "rejected"),
        ["job_id", "task_key"], [("created_ts", "desc"), ("proposal_id", "asc")], depth,
    )
    done = F.filter(
        F.transform(
            responses.applied_changes_of(F.col("analysis")),
            lambda c: text.trim_all(c["description"]),
        ),
        lambda d: d != "",
    )
    told = latest.groupBy("job_id", "task_key").agg(
        F.array_sort(F.collect_list(F.struct("rank", done.alias("items")))).alias("told")
    )
    items = F.flatten(F.transform("told", lambda t: t["items"]))
    bullets = F.transform(items, lambda d: F.concat(F.lit("- "), d))
    return told.where(F.size(items) > 0).select(
        "job_id", "task_key",
        F.concat(
            F.lit(HISTORY_HEADER + "\n"), F.array_join(bullets, "\n"), F.lit("\n")
        ).alias("rejected_history"),
    )


# --- proposals --------------------------------------------------------------


def proposal_rows(accepted: DataFrame, created_ts: str | dt.datetime, model: str,
                  actor: str = "agent") -> DataFrame:
    """Ledger rows of a day's candidates: the accepted ones and failed model calls.

    ``accepted`` is the output of ``accept_candidates`` with the columns of the
    candidate still in it. A failed call has no new script and took no time.
    """
    now = as_of_column(created_ts)
    failed = F.col("outcome") == "llm_error"
    return accepted.where("in_ledger").select(
        "proposal_id", now.alias("created_ts"), "run_id", "task_key", "original_path",
        F.when(~failed, F.col("v2_path")).alias("v2_path"),
        "duration_original_s", "tier", "tier_reason", "target_tables", "side_effects",
        F.lit(model).alias("llm_model"), "llm_analysis",
        F.when(failed, F.lit(0.0)).otherwise(F.col("llm_duration_s")).alias("llm_duration_s"),
        F.col("outcome").alias("validation_status"),
        F.when(~failed, F.col("validation_details")).alias("validation_details"),
        F.when(~failed, F.col("validation_run_id")).alias("validation_run_id"),
        "original_source_hash", "job_id",
        F.lit("proposed").alias("status"), now.alias("status_updated_ts"),
        F.lit(actor).alias("status_updated_by"), F.lit(None).cast("string").alias("notes"),
    )


def proposed_events(rows: DataFrame) -> DataFrame:
    """The first event of each new proposal."""
    return rows.select(
        "proposal_id", F.col("created_ts").alias("event_ts"), F.lit(0).alias("seq"), "status",
        F.col("status_updated_by").alias("actor"), "notes",
    )
