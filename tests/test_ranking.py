import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from pipewise.operators import ranking, runs
from pipewise.operators.acceptance import accept_candidates
from pipewise.operators.topk import rank_in_group, top_k

WEIGHTS = {"Standard_DS3_v2": 1.0, "Standard_E8d_v4": 3.0}


@pytest.mark.parametrize(
    "node, workers, photon, weights, multiplier, expected",
    [
        ("Standard_DS3_v2", 1, False, WEIGHTS, 1.5, 2.0),
        ("Standard_E8d_v4", 4, False, WEIGHTS, 1.5, 15.0),
        ("Unknown_Xyz_v99", 2, False, WEIGHTS, 1.5, 3.0),
        ("Standard_DS3_v2", 1, True, WEIGHTS, 1.5, 3.0),
        ("Standard_DS3_v2", 1, False, WEIGHTS, 1.5, 2.0),
        ("Standard_DS3_v2", None, False, WEIGHTS, 1.5, 2.0),
        ("Standard_DS3_v2", 0, False, WEIGHTS, 1.5, 1.0),
        ("Standard_DS3_v2", 1, True, WEIGHTS, 2.0, 4.0),
        ("Standard_DS3_v2", 2, False, {}, 1.5, 3.0),
    ],
)
def test_cost_weight(spark, node, workers, photon, weights, multiplier, expected):
    spec = spark.createDataFrame(
        [(node, workers, photon)], "node_type string, workers int, photon boolean"
    )
    table = ranking.weight_table(spark, weights)
    assert ranking.weigh_specs(spec, table, multiplier).first().cost_weight == expected


def test_zero_workers_is_not_missing(spark):
    clusters = spark.createDataFrame(
        [("a", "n", 0, 9, None), ("b", None, None, 9, "Photon"), ("c", "n", None, None, "X")],
        "cluster_key string, node_type_id string, num_workers int, max_workers int, "
        "runtime_engine string",
    )
    got = {r.cluster_key: (r.node_type, r.workers, r.photon)
           for r in ranking.cluster_specs(clusters).collect()}
    assert got == {"a": ("n", 0, False), "b": ("", 9, True), "c": ("n", None, False)}


def test_no_weight_table_means_weight_one(spark):
    tasks = spark.createDataFrame(
        [(1, "t", "jc", None)],
        "job_id int, task_key string, job_cluster_key string, existing_cluster_id string",
    )
    assert ranking.task_cost_weights(tasks, None, None, None).first().cost_weight == 1.0


def test_job_clusters_belong_to_their_job(spark):
    tasks = spark.createDataFrame(
        [(1, "t", "main", None), (2, "t", "main", None), (3, "t", "main", "own"), (4, "t", None, "gone")],
        "job_id int, task_key string, job_cluster_key string, existing_cluster_id string",
    )
    columns = "node_type_id string, num_workers int, max_workers int, runtime_engine string"
    in_jobs = spark.createDataFrame(
        [(1, "main", "a", 1, None, None), (2, "main", "a", 3, None, None)],
        f"job_id int, cluster_key string, {columns}",
    )
    own = spark.createDataFrame([("own", "a", 5, None, None)], f"cluster_key string, {columns}")
    got = ranking.task_cost_weights(tasks, in_jobs, own, ranking.weight_table(spark, {"a": 1.0}))
    assert {r.job_id: r.cost_weight for r in got.collect()} == {1: 2.0, 2: 4.0, 3: 6.0, 4: 2.0}


def skewed(spark, n=3000):
    rng = random.Random(1)
    rows = [
        (0 if rng.random() < 0.5 else rng.randrange(1, 20), f"t{i}", float(rng.randrange(40)))
        for i in range(n)
    ]
    return spark.createDataFrame(rows, "job_id int, task_key string, score double")


def test_rank_over_many_tasks_equals_rank_in_one(spark):
    df = skewed(spark)
    order = [("score", "desc"), ("task_key", "asc")]
    window = Window.partitionBy("job_id").orderBy(F.desc("score"), "task_key")
    plain = df.withColumn("rank", F.row_number().over(window))
    spread = rank_in_group(df, ["job_id"], order, parts=7)
    assert sorted(plain.collect()) == sorted(spread.select(plain.columns).collect())
    hot = spread.where("job_id = 0").agg(F.count("*"), F.max("rank"), F.countDistinct("rank")).first()
    assert hot[0] == hot[1] == hot[2] > 1000


def test_salted_top_k_equals_plain(spark):
    df = skewed(spark)
    order = [("score", "desc"), ("task_key", "asc")]
    window = Window.partitionBy("job_id").orderBy(F.desc("score"), "task_key")
    ranked = df.withColumn("rank", F.row_number().over(window))
    for k in (1, 50, 1500):
        want = sorted(ranked.where(F.col("rank") <= k).collect())
        assert sorted(top_k(df.repartition(5), ["job_id"], order, k).collect()) == want
    assert top_k(df, ["job_id"], order, 0).count() == 0


def test_latest_runs_takes_one_active_run(spark):
    rows = [(1, i, i * 10, i in (7, 9)) for i in range(1, 11)] + [(2, 50, 1, True), (3, 60, 1, False)]
    df = spark.createDataFrame(rows, "job_id int, run_id int, start_ms int, is_active boolean")
    got = {(r.job_id, r.run_pos): r.run_id for r in runs.latest_runs(df, 3).collect()}
    assert got == {(1, 1): 9, (1, 2): 10, (1, 3): 8, (2, 1): 50, (3, 1): 60}
    assert [r.run_id for r in runs.latest_runs(df, 3, run_id=4).collect()] == [4]
    jobs = spark.createDataFrame([(1,), (4,)], "job_id int")
    assert [r.job_id for r in runs.jobs_without_runs(jobs, df).collect()] == [4]


def test_repeated_task_counts_once(spark):
    rows = [
        (1, 1, "a", "SUCCESS", 1000, 3000), (1, 1, "a", "SUCCESS", 4000, 9000),
        (1, 1, "b", "FAILED", 1000, 2000), (1, 1, "c", "SUCCESS", 0, 2000),
        (1, 1, "d", "SUCCESS", 1000, None), (1, 2, "a", "SUCCESS", 1000, 2000),
    ]
    df = spark.createDataFrame(
        rows, "job_id int, run_id int, task_key string, result_state string, "
        "start_ms bigint, end_ms bigint",
    )
    got = {(r.run_id, r.task_key): r.duration_s for r in runs.task_durations(df).collect()}
    assert got == {(1, "a"): 5.0, (2, "a"): 1.0}
    avg = runs.avg_task_durations(df, df.select("job_id", "run_id").distinct()).first()
    assert (avg.avg_s, avg.n_runs) == (3.0, 2)


def walk(rows, top_n):
    """The walk as a loop over one job's candidates."""
    seen, accepted = [], 0
    for pos, outcome in sorted(rows):
        if accepted >= top_n:
            break
        if outcome in ("upload_error", "schema_mismatch", "data_mismatch"):
            continue
        seen.append((pos, outcome))
        accepted += outcome not in ("export_error", "llm_error", "no_changes")
    return seen


@pytest.mark.parametrize("top_n", [0, 1, 3, 1000])
def test_acceptance_equals_the_walk(spark, top_n):
    rng = random.Random(top_n)
    kinds = ["export_error", "llm_error", "no_changes", "upload_error", "schema_mismatch",
             "data_mismatch", "passed", "skipped", "smoke_failed", "failed"]
    rows = [(0 if i % 3 else rng.randrange(1, 5), i, rng.choice(kinds)) for i in range(600)]
    df = spark.createDataFrame(rows, "job_id int, rank_pos int, outcome string").repartition(5)
    got = accept_candidates(df, top_n).collect()
    for job in range(5):
        want = walk([(p, o) for j, p, o in rows if j == job], top_n)
        assert sorted((r.rank_pos, r.outcome) for r in got if r.job_id == job) == want
        assert sum(r.accepted for r in got if r.job_id == job) <= top_n
    assert all(r.in_ledger == (r.accepted or r.outcome == "llm_error") for r in got)


def test_gains_keep_the_newest_unreported_change(spark):
    applied = spark.createDataFrame(
        [("p1", "1998-06-01", "a@x", None, None), ("p2", "1998-06-02", None, None, None),
         ("p3", "1998-06-03", "c@x", "1998-06-04", None), ("p4", "1998-07-01", "d@x", None, None),
         ("p5", "1998-06-01", "e@x", None, None)],
        "proposal_id string, applied_ts string, applied_by string, rollback_ts string, "
        "first_reported_ts string",
    ).withColumn("applied_ts", F.col("applied_ts").cast("timestamp_ntz"))
    proposals = spark.createDataFrame(
        [("p1", 1, "t", 100.0), ("p2", 1, "t", 0.0), ("p3", 1, "t", 9.0), ("p4", 1, "t", 9.0),
         ("p5", 1, "u", 120.0)],
        "proposal_id string, job_id int, task_key string, duration_original_s double",
    )
    durations = spark.createDataFrame([(1, "t", 50.0)], "job_id int, task_key string, avg_s double")
    got = ranking.performance_gains(applied, proposals, durations, "1998-07-01 12:00:00").collect()
    assert {(r.proposal_id, r.delta_pct, r.status, r.applied_by) for r in got} == {
        ("p2", 0.0, "neutral", ""), ("p5", None, "no_ran", "e"),
    }


def test_leaves(spark):
    df = spark.createDataFrame(
        [(1, "a", None), (1, "b", "a"), (1, "c", "a"), (1, "d", "c"), (2, "a", None), (2, "x", "zz")],
        "job_id int, task_key string, depends_on string",
    )
    got = {(r.job_id, r.task_key) for r in ranking.leaf_tasks(df, exclude=["x"]).collect()}
    assert got == {(1, "b"), (1, "d"), (2, "a")}
