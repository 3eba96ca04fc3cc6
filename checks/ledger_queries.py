"""Proposals, decisions, history and the report."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from checks.fixtures import AS_OF
from checks.registry import PARTS, fx, query
from checks.run_queries import _gains
from pipewise.operators import acceptance, ledger, reporting
from pipewise.plans.daily import positions
from pipewise.sources.ledger_store import append, current_events, read, write_state
from pipewise.sources.report_sink import write_report
from pipewise.sources.scratch import new_path

PARTS["oq_current"] = """
SELECT proposal_id, status, event_ts AS status_updated_ts, actor AS status_updated_by, notes
FROM (SELECT *, row_number() OVER (PARTITION BY proposal_id ORDER BY event_ts DESC, seq DESC) AS rn FROM fx_events) WHERE rn = 1
"""
PARTS["oq_hashes"] = "SELECT path, sha256(source) AS current_hash FROM fx_scripts"
PARTS["oq_change_steps"] = """
SELECT original_path, proposal_id, result, task_key, decided_ts, v2_path, CASE WHEN before = 'applied' THEN backup_path END AS backup_path,
  row_number() OVER (PARTITION BY original_path ORDER BY decided_ts, action, actor, proposal_id) AS k,
  count(*) OVER (PARTITION BY original_path) AS n
FROM oq_decided WHERE result IN ('applied', 'rolled_back')
"""
# one change after the other: the path of the current text, and what approvals found
PARTS["oq_replayed"] = """
SELECT original_path, CAST(0 AS BIGINT) AS k, CAST(0 AS BIGINT) AS n, '' AS proposal_id, '' AS result, '' AS task_key, CAST(NULL AS TIMESTAMP) AS decided_ts,
  original_path AS base, original_path AS now, CAST([] AS VARCHAR[]) AS known_ids, CAST([] AS VARCHAR[]) AS known_bases
FROM (SELECT DISTINCT original_path FROM oq_change_steps)
UNION ALL
SELECT s.original_path, s.k, s.n, s.proposal_id, s.result, s.task_key, s.decided_ts, r.now,
  CASE WHEN s.result = 'applied' THEN s.v2_path ELSE coalesce(r.known_bases[list_position(r.known_ids, s.proposal_id)], s.backup_path) END,
  CASE WHEN s.result = 'applied' THEN list_append(r.known_ids, s.proposal_id) ELSE r.known_ids END,
  CASE WHEN s.result = 'applied' THEN list_append(r.known_bases, r.now) ELSE r.known_bases END
FROM oq_replayed r JOIN oq_change_steps s ON s.original_path = r.original_path AND s.k = r.k + 1
"""
PARTS["oq_asked"] = """
SELECT d.*, s.task_key, s.original_path, s.v2_path, s.stored_hash, s.status AS before, s.notes AS old_notes, h.current_hash,
  a.proposal_id IS NOT NULL AS was_applied, a.rollback_ts, 'b/' || a.proposal_id AS backup_path, b.path IS NOT NULL AS has_backup,
  row_number() OVER (PARTITION BY d.proposal_id ORDER BY d.decided_ts, d.action, d.actor) AS n,
  s.stored_hash <> '' AND s.stored_hash <> h.current_hash AS edited,
  (d.action = 'approve' AND s.status IN ('proposed', 'approved') AND s.v2_path IS NOT NULL AND h.current_hash IS NOT NULL)
    OR (d.action = 'reject' AND s.status = 'proposed') AS closes
FROM fx_decision_log d LEFT JOIN fx_state s ON d.proposal_id = s.proposal_id
LEFT JOIN oq_hashes h ON h.path = s.original_path
LEFT JOIN (SELECT proposal_id, arg_max(rollback_ts, applied_ts) AS rollback_ts FROM fx_applied GROUP BY proposal_id) a ON a.proposal_id = d.proposal_id
LEFT JOIN (SELECT path FROM fx_texts) b ON b.path = 'b/' || a.proposal_id
"""
PARTS["oq_first_closing"] = """
SELECT * FROM oq_asked WHERE closes AND n = (SELECT min(n) FROM oq_asked m WHERE m.proposal_id = oq_asked.proposal_id AND m.closes)
"""
PARTS["oq_first_change"] = """
SELECT * FROM (
  SELECT *, row_number() OVER (PARTITION BY original_path ORDER BY decided_ts, action, actor, proposal_id) AS rn FROM (
    SELECT original_path, decided_ts, action, actor, proposal_id FROM oq_first_closing WHERE action = 'approve' AND NOT coalesce(edited, FALSE)
    UNION ALL
    SELECT original_path, decided_ts, action, actor, proposal_id FROM oq_asked
    WHERE action = 'rollback' AND before = 'applied' AND was_applied AND rollback_ts IS NULL AND has_backup))
WHERE rn = 1
"""
PARTS["oq_closed"] = """
SELECT c.*, CASE WHEN c.action = 'reject' THEN 'rejected'
    WHEN coalesce(edited, FALSE) OR (coalesce(stored_hash, '') <> ''
      AND coalesce((c.decided_ts, c.action, c.actor, c.proposal_id) > (f.decided_ts, f.action, f.actor, f.proposal_id), FALSE)) THEN 'stale' ELSE 'applied' END AS closed_as
FROM oq_first_closing c LEFT JOIN oq_first_change f ON c.original_path = f.original_path
"""
PARTS["oq_decided"] = """
SELECT proposal_id, task_key, original_path, action, actor, decided_ts, notes, CASE WHEN n > closed_n THEN closing_notes ELSE old_notes END AS old_notes, v2_path, backup_path, before, n, closed_n, undone_n, closed_as,
  CASE WHEN n = closed_n THEN closed_as WHEN n = undone_n THEN 'rolled_back' ELSE 'refused' END AS result,
  CASE WHEN n > undone_n THEN 'rejected' WHEN n > closed_n THEN closed_as ELSE before END AS status_then, was_applied, rollback_ts
FROM (
  SELECT a.*, c.n AS closed_n, c.closed_as, c.notes AS closing_notes, min(CASE WHEN a.action = 'rollback' AND ((c.closed_as = 'applied' AND a.n > c.n)
      OR (a.before = 'applied' AND a.was_applied AND a.rollback_ts IS NULL AND a.has_backup)) THEN a.n END) OVER (PARTITION BY a.proposal_id) AS undone_n
  FROM oq_asked a LEFT JOIN oq_closed c ON a.proposal_id = c.proposal_id)
"""
PARTS["oq_history"] = """
SELECT job_id, task_key, 'PREVIOUSLY REJECTED OPTIMIZATIONS FOR THIS NOTEBOOK (do not re-propose any of these):' || chr(10)
  || string_agg('- ' || item, chr(10) ORDER BY rn, pos) || chr(10) AS rejected_history
FROM (
  SELECT job_id, task_key, rn, trim(json_extract_string(c, '$.description')) AS item, pos FROM (
    SELECT job_id, task_key, rn, unnest(json_extract(CASE WHEN json_valid(analysis) THEN analysis ELSE '{}' END, '$.changes_applied[*]')) AS c,
      unnest(generate_series(1, CAST(coalesce(json_array_length(CASE WHEN json_valid(analysis) THEN analysis ELSE '{}' END, '$.changes_applied'), 0) AS BIGINT))) AS pos
    FROM (SELECT *, row_number() OVER (PARTITION BY job_id, task_key ORDER BY created_ts DESC, proposal_id) AS rn
          FROM fx_proposals WHERE status = 'rejected') WHERE rn <= 5))
WHERE item <> '' GROUP BY job_id, task_key
"""
_LINE = """CASE WHEN validation_status = 'skipped' THEN 'Validation: ⏭ skipped' WHEN validation_status = 'failed' THEN 'Validation: ❌ error'
  WHEN tier = 'yellow' THEN CASE validation_status WHEN 'smoke_passed' THEN 'Validation: ✅ smoke' WHEN 'smoke_failed' THEN 'Validation: ❌ smoke' ELSE 'Validation: ⏭ skipped' END
  WHEN validation_status = 'smoke_failed' THEN 'Validation: ❌ smoke'
  WHEN validation_status = 'schema_mismatch' THEN 'Validation: ✅ smoke  ❌ schema'
  WHEN validation_status = 'data_mismatch' THEN 'Validation: ✅ smoke  ✅ schema  ❌ data'
  WHEN validation_status = 'passed' THEN 'Validation: ✅ smoke  ✅ schema  ✅ data'
  ELSE 'Validation: ✅ smoke  ✅ schema' END"""

# What a day's walk down the ranking reports, with what the cards need.
PARTS["oq_reported"] = """
SELECT a.job_id, a.rank_pos, a.outcome, a.in_ledger, CAST(row_number() OVER (PARTITION BY a.job_id ORDER BY a.rank_pos) AS INTEGER) AS pos,
  p.proposal_id, p.task_key, p.tier, p.duration_original_s, p.analysis, p.v2_path
FROM oq_accepted a JOIN fx_state p ON p.proposal_id = 'p' || CAST(a.rank_pos AS STRING)
"""


def _state(spark, sf):
    return fx(spark, sf, "fx_state")


def _outcome(spark, sf):
    return ledger.apply_decisions(
        fx(spark, sf, "fx_decision_log"), _state(spark, sf), fx(spark, sf, "fx_texts"),
        fx(spark, sf, "fx_applied").withColumn("backup_path", F.concat(F.lit("b/"), "proposal_id")),
    )


def _reported(spark, sf):
    """Accepted candidates with the proposal of the same number."""
    state = _state(spark, sf).drop("job_id", "validation_status", "status", "notes")
    accepted = acceptance.accept_candidates(fx(spark, sf, "fx_outcomes"))
    return accepted.withColumn(
        "proposal_id", F.concat(F.lit("p"), F.col("rank_pos").cast("string"))
    ).join(state, "proposal_id")


def _proposal_rows(spark, sf):
    rows = _reported(spark, sf).select(
        "*", F.lit(1).cast("bigint").alias("run_id"), F.lit("").alias("tier_reason"),
        F.array().cast("array<string>").alias("target_tables"),
        F.array().cast("array<string>").alias("side_effects"),
        F.col("analysis").alias("llm_analysis"), F.lit(1.5).alias("llm_duration_s"),
        F.lit(None).cast("string").alias("validation_details"),
        F.lit(None).cast("bigint").alias("validation_run_id"),
        F.col("stored_hash").alias("original_source_hash"),
    )
    return ledger.proposal_rows(rows, AS_OF, "some-model")


def _cards(spark, sf):
    reported = _reported(spark, sf)
    return reporting.proposal_cards(
        reported.join(positions(reported), ["job_id", "rank_pos"])
        .withColumn("duration_s", F.col("duration_original_s"))
        .withColumn("cost_weight", F.when(F.col("pos") == 1, 3.0).otherwise(1.0))
        .withColumn("error", F.col("analysis"))
    )


# --- queries ----------------------------------------------------------------


@query("ledger_current", "SELECT * FROM oq_current")
def ledger_current(spark, sf):
    return ledger.ledger_current(fx(spark, sf, "fx_events"))


@query("ledger_state", "SELECT * FROM oq_current")
def ledger_state(spark, sf):
    """A batch appended twice, and the state from two written months and the rest."""
    place, events = new_path(spark, "ledger"), fx(spark, sf, "fx_events")
    for _ in range(2):
        append(events, place, "events", batch="all")
    for month in (dt.date(1994, 1, 1), dt.date(1996, 7, 1)):
        write_state(spark, place, month)
    return ledger.ledger_current(current_events(spark, place))


@query(
    "proposal_details",
    """SELECT s.proposal_id, created_ts, task_key, original_path, v2_path, duration_original_s, tier, validation_status,
  'wh.t,wh.u' AS target_tables, CASE WHEN tier = 'yellow' THEN 'Email' ELSE '' END AS side_effects, analysis AS llm_analysis,
  c.status, c.status_updated_ts FROM fx_state s LEFT JOIN oq_current c ON s.proposal_id = c.proposal_id""",
)
def proposal_details(spark, sf):
    effects = F.when(F.col("tier") == "yellow", F.array(F.lit("Email"))).otherwise(F.array())
    state = _state(spark, sf).select(
        "*", F.array(F.lit("wh.t"), F.lit("wh.u")).alias("target_tables"),
        effects.alias("side_effects"), F.col("analysis").alias("llm_analysis"),
    )
    details = ledger.proposal_details(state, ledger.ledger_current(fx(spark, sf, "fx_events")))
    return details.withColumns(
        {c: F.array_join(c, ",") for c in ("target_tables", "side_effects")}
    )


@query(
    "ledger_append",
    """SELECT proposal_id, event_ts, seq, status, actor, notes, CAST(date_trunc('month', event_ts) AS DATE) AS event_month FROM fx_events
UNION ALL
SELECT proposal_id, TIMESTAMP '1998-07-01 00:00:00', 0, 'proposed', 'agent', NULL, DATE '1998-07-01' FROM oq_reported WHERE in_ledger""",
)
def ledger_append(spark, sf):
    place = new_path(spark, "ledger")
    append(fx(spark, sf, "fx_events"), place, "events")
    rows = _proposal_rows(spark, sf)
    append(ledger.proposed_events(rows), place, "events")
    return read(spark, place, "events").withColumnRenamed("month", "event_month")


@query(
    "proposal_rows",
    """SELECT proposal_id, TIMESTAMP '1998-07-01 00:00:00' AS created_ts, task_key, outcome AS validation_status,
  CASE WHEN outcome <> 'llm_error' THEN v2_path END AS v2_path,
  CASE WHEN outcome = 'llm_error' THEN 0.0 ELSE 1.5 END::DOUBLE AS llm_duration_s, 'proposed' AS status
FROM oq_reported WHERE in_ledger""",
)
def proposal_rows(spark, sf):
    return _proposal_rows(spark, sf).select(
        "proposal_id", "created_ts", "task_key", "validation_status", "v2_path",
        "llm_duration_s", "status",
    )


@query(
    "latest_applied",
    "SELECT proposal_id, applied_ts, applied_by, rollback_ts, first_reported_ts FROM fx_applied",
)
def latest_applied(spark, sf):
    applied = fx(spark, sf, "fx_applied").withColumn("backup_path", F.lit("b"))
    earlier = applied.withColumn("applied_ts", F.expr("applied_ts - INTERVAL '3' DAY")).withColumn(
        "applied_by", F.lit("earlier")
    )
    return ledger.latest_applied(earlier.unionByName(applied)).drop("backup_path")


@query(
    "stale_proposals",
    """SELECT proposal_id, original_path, stored_hash, current_hash FROM fx_state s JOIN oq_hashes h ON h.path = s.original_path
WHERE stored_hash <> '' AND stored_hash <> current_hash""",
)
def stale_proposals(spark, sf):
    return ledger.stale_proposals(_state(spark, sf), fx(spark, sf, "fx_scripts"))


@query(
    "decision_guard",
    """SELECT proposal_id, action, decided_ts, reason = '' AS valid, reason,
  coalesce(action = 'approve' AND reason = '' AND tier = 'green' AND validation_status NOT IN ('passed', 'skipped'), FALSE) AS warn
FROM (
  SELECT d.proposal_id, d.action, d.decided_ts, s.tier, s.validation_status,
    CASE WHEN s.status IS NULL THEN 'proposal does not exist'
      WHEN action = 'approve' AND status NOT IN ('proposed', 'approved') THEN 'current status is ''' || status || ''', cannot approve'
      WHEN action = 'approve' AND v2_path IS NULL THEN 'there is no new script to apply'
      WHEN action = 'reject' AND status <> 'proposed' THEN 'current status is ''' || status || ''', cannot reject'
      WHEN action = 'rollback' AND status <> 'applied' THEN 'can only rollback a proposal with status=''applied'', current status: ''' || status || ''''
      ELSE '' END AS reason
  FROM fx_decision_log d LEFT JOIN fx_state s ON d.proposal_id = s.proposal_id)""",
)
def decision_guard(spark, sf):
    return ledger.decision_guard(fx(spark, sf, "fx_decision_log"), _state(spark, sf))


@query(
    "apply_decisions",
    """SELECT proposal_id, action, actor, decided_ts, result,
  CASE WHEN result <> 'refused' THEN '' WHEN status_then IS NULL THEN 'proposal does not exist'
    WHEN action = 'approve' AND status_then NOT IN ('proposed', 'approved') THEN 'current status is ''' || status_then || ''', cannot approve'
    WHEN action = 'approve' AND v2_path IS NULL THEN 'there is no new script to apply'
    WHEN action = 'reject' AND status_then <> 'proposed' THEN 'current status is ''' || status_then || ''', cannot reject'
    WHEN action = 'rollback' AND status_then <> 'applied' THEN 'can only rollback a proposal with status=''applied'', current status: ''' || status_then || ''''
    WHEN action = 'approve' THEN 'the script does not exist' WHEN NOT was_applied THEN 'no applied change found' WHEN rollback_ts IS NOT NULL THEN 'already rolled back' ELSE 'the backup text is missing' END AS reason
FROM oq_decided""",
)
def apply_decisions(spark, sf):
    return _outcome(spark, sf).select(
        "proposal_id", "action", "actor", "decided_ts", "result", "reason"
    )


@query(
    "decision_events",
    """SELECT proposal_id, decided_ts AS event_ts, CASE result WHEN 'rolled_back' THEN 3 ELSE 2 END AS seq, CASE result WHEN 'rolled_back' THEN 'rejected' ELSE result END AS status, actor,
  CASE result WHEN 'stale' THEN coalesce(old_notes, '') || '[STALE: notebook manually edited after proposal]'
    WHEN 'rolled_back' THEN coalesce(old_notes, '') || chr(10) || '[ROLLBACK] ' ELSE notes END AS notes
FROM oq_decided WHERE result <> 'refused'""",
)
def decision_events(spark, sf):
    return ledger.decision_events(_outcome(spark, sf))


@query(
    "applied_rows",
    """SELECT decided_ts AS applied_ts, proposal_id, original_path AS script_path,
  'backups/' || task_key || '_' || proposal_id || '_' || strftime(decided_ts, '%Y%m%d_%H%M%S') AS backup_path, actor AS applied_by
FROM oq_decided WHERE result = 'applied'""",
)
def applied_rows(spark, sf):
    return ledger.applied_rows(_outcome(spark, sf)).select(
        "applied_ts", "proposal_id", "script_path", "backup_path", "applied_by"
    )


@query(
    "script_updates",
    """WITH RECURSIVE ends AS (SELECT original_path, now FROM oq_replayed WHERE k = n AND k > 0)
SELECT e.original_path AS path, t.source FROM ends e JOIN fx_texts t ON t.path = e.now""",
)
def script_updates(spark, sf):
    return ledger.script_updates(_outcome(spark, sf), fx(spark, sf, "fx_texts"))


@query(
    "script_backups",
    """WITH RECURSIVE found AS (SELECT * FROM oq_replayed WHERE result = 'applied')
SELECT 'backups/' || f.task_key || '_' || f.proposal_id || '_' || strftime(f.decided_ts, '%Y%m%d_%H%M%S') AS path, t.source
FROM found f JOIN fx_texts t ON t.path = f.base""",
)
def script_backups(spark, sf):
    return ledger.script_backups(_outcome(spark, sf), fx(spark, sf, "fx_texts"))


@query(
    "result_lines",
    """SELECT proposal_id, action, CASE action WHEN 'approve' THEN '✅ *Approve*' WHEN 'reject' THEN '❌ *Reject*' ELSE '↩️ *Rollback*' END
  || ' — `' || task_key || '`' || chr(10) || 'proposal `' || substr(proposal_id, 1, 8) || '`'
  || CASE WHEN coalesce(notes, '') <> '' THEN chr(10) || '_' || notes || '_' ELSE '' END AS line
FROM oq_decided WHERE result NOT IN ('refused', 'stale')""",
)
def result_lines(spark, sf):
    return reporting.result_lines(_outcome(spark, sf))


@query(
    "mark_reported",
    f"""SELECT a.proposal_id, a.applied_ts, TIMESTAMP '{AS_OF}' AS first_reported_ts FROM fx_applied a
WHERE a.first_reported_ts IS NULL AND a.proposal_id IN (SELECT proposal_id FROM oq_gains)""",
)
def mark_reported(spark, sf):
    return ledger.mark_reported(fx(spark, sf, "fx_applied"), _gains(spark, sf), AS_OF)


@query(
    "ledger_tables",
    """SELECT 'applied_changes' AS "table", a.proposal_id, a.applied_ts AS at, CAST(date_trunc('month', a.applied_ts) AS DATE) AS month FROM fx_applied a
UNION ALL
SELECT 'rollbacks', proposal_id, decided_ts, CAST(date_trunc('month', decided_ts) AS DATE) FROM oq_decided WHERE result = 'rolled_back'
UNION ALL
SELECT 'proposals', proposal_id, TIMESTAMP '1998-07-01 00:00:00', DATE '1998-07-01' FROM oq_reported WHERE in_ledger""",
)
def ledger_tables(spark, sf):
    place = new_path(spark, "ledger")
    applied = fx(spark, sf, "fx_applied").select(
        "*", F.lit("s").alias("script_path"), F.lit("b").alias("backup_path"),
        F.lit(None).cast("string").alias("rollback_by"),
    )
    append(applied, place, "applied_changes")
    append(ledger.rollback_rows(_outcome(spark, sf)), place, "rollbacks")
    append(_proposal_rows(spark, sf), place, "proposals")

    def told(table, time):
        rows = read(spark, place, table)
        return rows.select(
            F.lit(table).alias("table"), "proposal_id", F.col(time).alias("at"), "month"
        )

    return (
        told("applied_changes", "applied_ts")
        .unionByName(told("rollbacks", "rollback_ts"))
        .unionByName(told("proposals", "created_ts"))
    )


@query(
    "applied_state",
    f"""SELECT a.proposal_id, a.applied_ts, a.applied_by,
  CASE WHEN a.rollback_ts IS NOT NULL THEN a.rollback_ts WHEN d.decided_ts >= a.applied_ts THEN d.decided_ts END AS rollback_ts,
  CASE WHEN a.rollback_ts IS NULL AND d.decided_ts >= a.applied_ts THEN d.actor END AS rollback_by,
  CASE WHEN a.first_reported_ts IS NOT NULL THEN a.first_reported_ts WHEN g.proposal_id IS NOT NULL THEN TIMESTAMP '{AS_OF}' END AS first_reported_ts
FROM fx_applied a
LEFT JOIN (SELECT * FROM oq_decided WHERE result = 'rolled_back') d ON d.proposal_id = a.proposal_id
LEFT JOIN oq_gains g ON g.proposal_id = a.proposal_id""",
)
def applied_state(spark, sf):
    applied = fx(spark, sf, "fx_applied").withColumn("rollback_by", F.lit(None).cast("string"))
    reported = ledger.mark_reported(applied, _gains(spark, sf), AS_OF)
    return ledger.applied_state(applied, ledger.rollback_rows(_outcome(spark, sf)), reported)


@query("rejected_history", "SELECT job_id, task_key, rejected_history FROM oq_history")
def rejected_history(spark, sf):
    return ledger.rejected_history(fx(spark, sf, "fx_proposals"))


@query(
    "change_bullets",
    """SELECT proposal_id, CAST(pos AS INTEGER) AS pos, rtrim('• ' || CASE WHEN length(d) > 100 THEN substr(d, 1, 97) || '…' ELSE d END || '  '
  || CASE s WHEN 'high' THEN '🔴' ELSE '' END, ' ') AS bullet
FROM (SELECT proposal_id, pos, json_extract_string(c, '$.description') AS d, coalesce(json_extract_string(c, '$.estimated_savings'), '') AS s FROM (
  SELECT proposal_id, unnest(json_extract(analysis, '$.changes_applied[*]')) AS c,
    unnest(generate_series(0, CAST(json_array_length(analysis, '$.changes_applied') AS BIGINT) - 1)) AS pos
  FROM (SELECT proposal_id, replace(analysis, 'opt 3', repeat('long text ', 12)) AS analysis FROM fx_proposals WHERE json_valid(analysis))))""",
)
def change_bullets(spark, sf):
    longer = F.replace(F.col("analysis"), F.lit("opt 3"), F.lit("long text " * 12))
    return reporting.change_bullets(
        fx(spark, sf, "fx_proposals").select("proposal_id", longer.alias("analysis"))
    )


@query("validation_lines", f"SELECT proposal_id, {_LINE} AS line FROM fx_state")
def validation_lines(spark, sf):
    return reporting.validation_lines(_state(spark, sf))


_BULLET = """(SELECT string_agg(rtrim('• ' || coalesce(json_extract_string(c, '$.description'), '') || '  ' ||
    CASE json_extract_string(c, '$.estimated_savings') WHEN 'high' THEN '🔴' ELSE '' END, ' '), chr(10))
  FROM (SELECT unnest(json_extract(CASE WHEN json_valid(analysis) THEN analysis ELSE '{}' END, '$.changes_applied[*]')) AS c))"""

PARTS["oq_cards"] = f"""
SELECT job_id, pos, concat_ws(chr(10),
  '*' || pos || '. `' || task_key || '`*  ' || CASE tier WHEN 'green' THEN '🟢' ELSE '🟡' END || ' '
    || CASE outcome WHEN 'passed' THEN '✅' WHEN 'skipped' THEN '⏭️' WHEN 'no_changes' THEN '💤' WHEN 'llm_error' THEN '💥' ELSE '🚫' END
    || chr(10) || '*' || CAST(CAST(round(duration_original_s / 60, 1) AS DECIMAL(18,1)) AS VARCHAR) || ' min*' || CASE WHEN pos = 1 AND outcome NOT IN ('no_changes', 'llm_error', 'export_error') THEN '  ·  *3.0×*' ELSE '' END,
  CASE WHEN outcome = 'no_changes' THEN '💤 _No changes — LLM found no worthwhile optimizations._'
    WHEN outcome = 'llm_error' THEN '_💥 Error: ' || substr(coalesce(analysis, 'see the proposals table'), 1, 180) || '_'
    WHEN outcome = 'export_error' THEN '_🚫 Error: ' || substr(coalesce(analysis, 'see the proposals table'), 1, 180) || '_'
    WHEN json_valid(analysis) THEN '*Proposed changes:*' || chr(10) || {_BULLET} END,
  CASE WHEN outcome = 'skipped' THEN 'Validation: ⏭ skipped' WHEN tier = 'yellow' THEN 'Validation: ⏭ skipped'
    WHEN outcome = 'passed' THEN 'Validation: ✅ smoke  ✅ schema  ✅ data' ELSE 'Validation: ✅ smoke  ✅ schema' END,
  'v2: `' || v2_path || '`',
  CASE WHEN v2_path IS NOT NULL THEN 'Approve with proposal_id `' || proposal_id || '`' END) AS card
FROM oq_reported
"""


@query("proposal_cards", "SELECT job_id, pos, card FROM oq_cards")
def proposal_cards(spark, sf):
    return _cards(spark, sf)


@query(
    "report_rows",
    """SELECT job_id, '1 header' AS section, '' AS item, 'Top of job ' || job_id AS text FROM (SELECT DISTINCT job_id FROM fx_outcomes)
UNION ALL
SELECT job_id, '2 gains', task_key, status FROM oq_gain_status
UNION ALL
SELECT job_id, '3 cards', CAST(pos AS VARCHAR), card FROM oq_cards""",
)
def report_rows(spark, sf):
    header = fx(spark, sf, "fx_outcomes").select("job_id").distinct().withColumn(
        "header", F.concat(F.lit("Top of job "), F.col("job_id").cast("string"))
    )
    gains = _gains(spark, sf).select("job_id", "task_key", F.col("status").alias("line"))
    rows = reporting.report_rows(header, gains, _cards(spark, sf))
    path = new_path(spark, "report")
    write_report(rows, path)
    return spark.read.schema("section string, item string, text string, job_id bigint").json(path)
