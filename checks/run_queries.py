"""Runs, ranking, cooldown, gains, acceptance."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.fixtures import AS_OF
from checks.registry import PARTS, fx, query
from pipewise.operators import acceptance, ranking, reporting, runs
from pipewise.sources import records
from pipewise.sources.scratch import materialize, new_path

N_RUNS = 200
SELF_TASK = "task_39"
COOLDOWN = 90

# --- oracle parts -----------------------------------------------------------

PARTS["oq_latest"] = f"""
SELECT * FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY job_id ORDER BY is_active DESC, start_ms DESC, run_id DESC) AS INTEGER) AS run_pos
  FROM (
    SELECT job_id, run_id, start_ms, is_active FROM (
      SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY start_ms DESC, run_id DESC) AS rn
      FROM fx_runs WHERE is_active) WHERE rn = 1
    UNION ALL SELECT job_id, run_id, start_ms, is_active FROM fx_runs WHERE NOT is_active))
WHERE run_pos <= {N_RUNS}
"""
PARTS["oq_durations"] = """
SELECT job_id, run_id, task_key, end_ms - start_ms AS duration_ms, (end_ms - start_ms) / 1000.0::DOUBLE AS duration_s
FROM fx_task_runs WHERE result_state = 'SUCCESS' AND start_ms <> 0 AND end_ms <> 0
"""
PARTS["oq_avg"] = f"""
SELECT d.job_id, d.task_key, CAST(sum(d.duration_ms) AS DOUBLE) / count(*) / 1000.0::DOUBLE AS avg_s, count(*) AS n_runs
FROM oq_durations d JOIN oq_latest l ON d.job_id = l.job_id AND d.run_id = l.run_id
WHERE d.task_key <> '{SELF_TASK}' GROUP BY d.job_id, d.task_key
"""
PARTS["oq_weights"] = """
SELECT t.job_id, t.task_key,
  round(coalesce(w.node_weight, 1.0::DOUBLE)
    * (coalesce(CASE WHEN j.cluster_key IS NOT NULL THEN coalesce(j.num_workers, j.max_workers)
                     WHEN e.cluster_key IS NOT NULL THEN coalesce(e.num_workers, e.max_workers) END, 1) + 1)
    * (CASE WHEN upper(coalesce(j.runtime_engine, CASE WHEN j.cluster_key IS NULL THEN e.runtime_engine END, '')) = 'PHOTON'
            THEN 1.5::DOUBLE ELSE 1.0::DOUBLE END), 2) AS cost_weight
FROM fx_job_tasks t
LEFT JOIN fx_clusters j ON t.job_cluster_key = j.cluster_key
LEFT JOIN fx_clusters e ON t.existing_cluster_id = e.cluster_key
LEFT JOIN fx_node_weights w ON w.node_type_id = CASE WHEN j.cluster_key IS NOT NULL THEN j.node_type_id ELSE e.node_type_id END
"""
PARTS["oq_scored"] = """
SELECT a.job_id, a.task_key, a.avg_s, p.script_path, coalesce(w.cost_weight, 1.0::DOUBLE) AS cost_weight,
  a.avg_s * coalesce(w.cost_weight, 1.0::DOUBLE) AS score
FROM oq_avg a
JOIN fx_job_tasks p ON a.job_id = p.job_id AND a.task_key = p.task_key AND p.script_path IS NOT NULL
LEFT JOIN oq_weights w ON a.job_id = w.job_id AND a.task_key = w.task_key
"""
PARTS["oq_ranked"] = """
SELECT job_id, task_key, avg_s, script_path, cost_weight, score,
  CAST(row_number() OVER (PARTITION BY job_id ORDER BY score DESC, task_key) AS INTEGER) AS rank
FROM oq_scored
"""
PARTS["oq_cooled"] = f"""
SELECT p.job_id, p.task_key, max(a.applied_ts) AS last_applied
FROM fx_applied a JOIN fx_proposals p ON a.proposal_id = p.proposal_id
WHERE a.rollback_ts IS NULL AND a.applied_ts <= TIMESTAMP '{AS_OF}'
  AND a.applied_ts >= TIMESTAMP '{AS_OF}' - INTERVAL '{COOLDOWN}' DAY
GROUP BY p.job_id, p.task_key
"""
PARTS["oq_gains"] = f"""
SELECT proposal_id, n.job_id, n.task_key, coalesce(duration_original_s, 0) / 60.0::DOUBLE AS original_min,
  avg_s / 60.0::DOUBLE AS current_min,
  CASE WHEN avg_s IS NULL THEN NULL WHEN duration_original_s > 0 THEN (duration_original_s - avg_s) / duration_original_s * 100.0::DOUBLE ELSE 0 END AS delta_pct,
  split_part(coalesce(applied_by, ''), '@', 1) AS applied_by
FROM (
  SELECT p.proposal_id, p.job_id, p.task_key, p.duration_original_s, a.applied_by,
    row_number() OVER (PARTITION BY p.job_id, p.task_key ORDER BY a.applied_ts DESC, p.proposal_id) AS rn
  FROM fx_applied a JOIN fx_proposals p ON a.proposal_id = p.proposal_id
  WHERE CAST(a.applied_ts AS DATE) < DATE '{AS_OF[:10]}' AND a.rollback_ts IS NULL AND a.first_reported_ts IS NULL) n
LEFT JOIN oq_avg d ON d.job_id = n.job_id AND d.task_key = n.task_key
WHERE rn = 1
"""
PARTS["oq_gain_status"] = """
SELECT *, CASE WHEN current_min IS NULL THEN 'no_ran' WHEN delta_pct > 3 THEN 'improved'
  WHEN delta_pct < -3 THEN 'regressed' ELSE 'neutral' END AS status FROM oq_gains
"""
PARTS["oq_accepted"] = """
SELECT job_id, rank_pos, outcome, outcome NOT IN ('export_error', 'llm_error', 'no_changes') AS accepted,
  outcome NOT IN ('export_error', 'no_changes') AS in_ledger
FROM (
  SELECT *, coalesce(sum(CASE WHEN outcome IN ('export_error', 'llm_error', 'no_changes', 'schema_mismatch', 'data_mismatch') THEN 0 ELSE 1 END)
    OVER (PARTITION BY job_id ORDER BY rank_pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM fx_outcomes)
WHERE before < 3 AND outcome NOT IN ('schema_mismatch', 'data_mismatch')
"""

# --- inputs -----------------------------------------------------------------


def _latest(spark, sf):
    return runs.latest_runs(fx(spark, sf, "fx_runs"), N_RUNS)


def _avg(spark, sf):
    # written first, so that the join with all task runs knows how small it is
    chosen = materialize(_latest(spark, sf), "runs")
    return runs.avg_task_durations(fx(spark, sf, "fx_task_runs"), chosen, SELF_TASK)


def _weights(spark, sf):
    clusters = fx(spark, sf, "fx_clusters")
    return ranking.task_cost_weights(
        fx(spark, sf, "fx_job_tasks"), clusters, clusters, fx(spark, sf, "fx_node_weights")
    )


def _scored(spark, sf):
    paths = ranking.task_paths(fx(spark, sf, "fx_job_tasks"))
    return ranking.scored_tasks(_avg(spark, sf), paths, _weights(spark, sf))


def _cooled(spark, sf):
    return ranking.cooled_tasks(
        fx(spark, sf, "fx_applied"), fx(spark, sf, "fx_proposals"), AS_OF, COOLDOWN
    )


def _gains(spark, sf):
    return ranking.performance_gains(
        fx(spark, sf, "fx_applied"), fx(spark, sf, "fx_proposals"), _avg(spark, sf), AS_OF
    )


def _land_jobs(spark, sf):
    """Job definitions as they are landed: one JSON record per job."""
    tasks = fx(spark, sf, "fx_job_tasks")
    task = F.struct(
        "task_key",
        F.struct(F.col("script_path").alias("notebook_path")).alias("notebook_task"),
        "job_cluster_key", "existing_cluster_id",
        F.when(
            F.col("depends_on").isNotNull(),
            F.array(F.struct(F.col("depends_on").alias("task_key"))),
        ).alias("depends_on"),
    )
    jobs = tasks.groupBy("job_id").agg(F.struct(F.collect_list(task).alias("tasks")).alias("settings"))
    path = new_path(spark, "landed-jobs")
    jobs.write.json(path)
    return records.read_jobs(spark, path)


# --- queries ----------------------------------------------------------------


@query("run_tasks_flat", "SELECT job_id, run_id, task_key, result_state, start_ms, end_ms FROM fx_task_runs")
def run_tasks_flat(spark, sf):
    task = F.struct(
        "task_key", F.struct("result_state").alias("state"),
        F.col("start_ms").alias("start_time"), F.col("end_ms").alias("end_time"),
    )
    landed = fx(spark, sf, "fx_task_runs").groupBy("job_id", "run_id").agg(
        F.collect_list(task).alias("tasks")
    )
    path = new_path(spark, "landed-runs")
    landed.write.json(path)
    return records.run_tasks(records.read_runs(spark, path))


@query(
    "task_paths",
    "SELECT job_id, task_key, script_path FROM fx_job_tasks WHERE script_path IS NOT NULL",
)
def task_paths(spark, sf):
    return ranking.task_paths(records.job_tasks(_land_jobs(spark, sf)))


@query(
    "cluster_specs",
    """SELECT cluster_key, coalesce(node_type_id, '') AS node_type, coalesce(num_workers, max_workers) AS workers,
  upper(coalesce(runtime_engine, '')) = 'PHOTON' AS photon FROM fx_line_clusters""",
)
def cluster_specs(spark, sf):
    landed = fx(spark, sf, "fx_line_clusters").select(
        F.col("cluster_key").alias("cluster_id"), "node_type_id", "num_workers",
        F.when(F.col("max_workers").isNotNull(), F.struct("max_workers")).alias("autoscale"),
        "runtime_engine",
    )
    path = new_path(spark, "landed-clusters")
    landed.write.json(path)
    return ranking.cluster_specs(records.read_clusters(spark, path))


@query(
    "cost_weight_cases",
    """SELECT cluster_key, round(coalesce(node_weight, 1.0::DOUBLE) * (coalesce(num_workers, max_workers, 1) + 1)
    * (CASE WHEN upper(coalesce(runtime_engine, '')) = 'PHOTON' THEN 1.5::DOUBLE ELSE 1.0::DOUBLE END), 2) AS cost_weight
FROM fx_line_clusters c LEFT JOIN fx_node_weights w ON c.node_type_id = w.node_type_id""",
)
def cost_weight_cases(spark, sf):
    specs = ranking.cluster_specs(fx(spark, sf, "fx_line_clusters"))
    return ranking.weigh_specs(specs, fx(spark, sf, "fx_node_weights")).select(
        "cluster_key", "cost_weight"
    )


@query("latest_runs", "SELECT job_id, run_id, start_ms, is_active, run_pos FROM oq_latest")
def latest_runs(spark, sf):
    return _latest(spark, sf)


@query("task_durations", "SELECT job_id, run_id, task_key, duration_ms, duration_s FROM oq_durations")
def task_durations(spark, sf):
    return runs.task_durations(fx(spark, sf, "fx_task_runs"))


@query("avg_task_durations", "SELECT job_id, task_key, avg_s, n_runs FROM oq_avg")
def avg_task_durations(spark, sf):
    return _avg(spark, sf)


@query("task_cost_weights", "SELECT job_id, task_key, cost_weight FROM oq_weights")
def task_cost_weights(spark, sf):
    return _weights(spark, sf)


@query(
    "rank_by_cost",
    "SELECT job_id, task_key, avg_s, script_path, cost_weight, score, rank FROM oq_ranked",
)
def rank_by_cost(spark, sf):
    return ranking.rank_by_cost(_scored(spark, sf))


@query(
    "rank_label",
    """SELECT job_id, bool_or(cost_weight <> 1.0) AS weighted,
  CASE WHEN bool_or(cost_weight <> 1.0) THEN 'by cost score' ELSE 'slowest' END AS rank_label
FROM oq_scored GROUP BY job_id""",
)
def rank_label(spark, sf):
    return ranking.rank_labels(_scored(spark, sf))


@query(
    "ranking_lines",
    """SELECT r.job_id, rank, '  ' || rank || '. ' || rpad(task_key, 50, ' ') || ' '
  || lpad(CAST(CAST(round(avg_s / 60, 1) AS DECIMAL(18,1)) AS VARCHAR), 6, ' ') || ' min'
  || CASE WHEN weighted THEN '  ×' || CAST(CAST(round(cost_weight, 1) AS DECIMAL(18,1)) AS VARCHAR)
     || '  →  ' || CAST(CAST(round(score / 60, 1) AS DECIMAL(18,1)) AS VARCHAR) || ' score' ELSE '' END AS line
FROM oq_ranked r JOIN (SELECT job_id, bool_or(cost_weight <> 1.0) AS weighted FROM oq_scored GROUP BY job_id) l ON r.job_id = l.job_id""",
)
def ranking_lines(spark, sf):
    return ranking.ranking_lines(ranking.rank_by_cost(_scored(spark, sf)))


@query("cooled_tasks", "SELECT job_id, task_key, last_applied FROM oq_cooled")
def cooled_tasks(spark, sf):
    return _cooled(spark, sf)


@query(
    "top_after_cooldown",
    """SELECT * FROM (
  SELECT job_id, task_key, avg_s, script_path, cost_weight, score,
    CAST(row_number() OVER (PARTITION BY job_id ORDER BY score DESC, task_key) AS INTEGER) AS rank
  FROM oq_scored s WHERE NOT EXISTS (SELECT 1 FROM oq_cooled c WHERE c.job_id = s.job_id AND c.task_key = s.task_key))
WHERE rank <= 3""",
)
def top_after_cooldown(spark, sf):
    return ranking.top_after_cooldown(_scored(spark, sf), _cooled(spark, sf))


@query(
    "cooldown_skips",
    f"""SELECT s.job_id, s.task_key, date_sub('day', last_applied, TIMESTAMP '{AS_OF}') AS days_ago
FROM oq_scored s JOIN oq_cooled c ON c.job_id = s.job_id AND c.task_key = s.task_key""",
)
def cooldown_skips(spark, sf):
    return ranking.cooldown_skips(_scored(spark, sf), _cooled(spark, sf), AS_OF)


@query(
    "leaf_tasks",
    """SELECT job_id, task_key FROM fx_job_tasks t WHERE task_key <> 'task_39'
  AND NOT EXISTS (SELECT 1 FROM fx_job_tasks d WHERE d.job_id = t.job_id AND d.depends_on = t.task_key)""",
)
def leaf_tasks(spark, sf):
    return ranking.leaf_tasks(records.job_dependencies(_land_jobs(spark, sf)), exclude=[SELF_TASK])


@query(
    "performance_gains",
    "SELECT proposal_id, job_id, task_key, original_min, current_min, delta_pct, applied_by, status FROM oq_gain_status",
)
def performance_gains(spark, sf):
    return _gains(spark, sf)


@query(
    "gain_lines",
    """SELECT job_id, task_key,
  CASE status
    WHEN 'no_ran' THEN '⏭️  `' || task_key || '` — did not run in this execution _(approved by ' || applied_by || ')_'
    WHEN 'improved' THEN '✅  ' || span || '_(−' || pct || '%)_  approved by ' || applied_by
    WHEN 'regressed' THEN '🔴  ' || span || '_(+' || pct || '% — please review)_  approved by ' || applied_by
    ELSE '➡️  ' || span || '_(no significant change)_  approved by ' || applied_by END AS line
FROM (SELECT *, '`' || task_key || '`: *' || CAST(CAST(round(original_min, 1) AS DECIMAL(18,1)) AS VARCHAR) || ' min* → *'
    || CAST(CAST(round(current_min, 1) AS DECIMAL(18,1)) AS VARCHAR) || ' min* ' AS span,
    CAST(CAST(round(abs(delta_pct)) AS BIGINT) AS VARCHAR) AS pct FROM oq_gain_status)""",
)
def gain_lines(spark, sf):
    return reporting.gain_lines(_gains(spark, sf))


@query(
    "report_header",
    """SELECT l.job_id, CASE WHEN n IS NULL THEN 'No runs recorded'
    WHEN n > 1 THEN 'Runs `' || r1 || '` + `' || r2 || '` (avg 2)' ELSE 'Run `' || r1 || '`' END
  || '  ·  Top 3 ' || CASE WHEN weighted THEN 'by cost score' ELSE 'slowest' END || ' notebooks' AS header
FROM (SELECT job_id, bool_or(cost_weight <> 1.0) AS weighted FROM oq_scored GROUP BY job_id) l
LEFT JOIN (SELECT job_id, count(*) AS n, max(CASE WHEN run_pos = 1 THEN run_id END) AS r1,
    max(CASE WHEN run_pos = 2 THEN run_id END) AS r2 FROM oq_latest GROUP BY job_id) r ON l.job_id = r.job_id""",
)
def report_header(spark, sf):
    return reporting.report_header(_latest(spark, sf), ranking.rank_labels(_scored(spark, sf)))


@query("accept_candidates", "SELECT job_id, rank_pos, outcome, accepted, in_ledger FROM oq_accepted")
def accept_candidates(spark, sf):
    return acceptance.accept_candidates(fx(spark, sf, "fx_outcomes"))


@query(
    "run_summary",
    """SELECT job_id, count(*) AS n_reported, count(*) FILTER (accepted) AS n_accepted,
  count(*) FILTER (NOT accepted) AS n_not_accepted FROM oq_accepted GROUP BY job_id""",
)
def run_summary(spark, sf):
    return acceptance.run_summary(acceptance.accept_candidates(fx(spark, sf, "fx_outcomes")))
