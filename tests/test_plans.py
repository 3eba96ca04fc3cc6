"""Whole plans on the given tables, and the shape of physical plans."""

import re

import pytest
from pyspark.sql import functions as F

from checks import registry
from checks.fixtures import AS_OF
from checks.registry import fx
from pipewise.operators import corpus, ledger, lineage, runs
from pipewise.operators.topk import top_k
from pipewise.plans import daily
from pipewise.sources import ledger_store, records, report_sink
from pipewise.sources.scratch import new_path
from pipewise.streaming import landing


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def day(spark, sf):
    # scripts under the paths the tasks name, some of them missing
    source = fx(spark, sf, "fx_lineage_scripts").select("script_id", "source")
    paths = fx(spark, sf, "fx_job_tasks").where("script_path IS NOT NULL AND task_key <> 'task_3'")
    numbered = paths.select("script_path").distinct().withColumn(
        "script_id", F.regexp_extract("script_path", r"(\d+)$", 1).cast("bigint")
    )
    clusters = fx(spark, sf, "fx_clusters")
    return daily.Day(
        runs=fx(spark, sf, "fx_runs"), task_runs=fx(spark, sf, "fx_task_runs"),
        tasks=fx(spark, sf, "fx_job_tasks"), job_clusters=clusters, clusters=clusters,
        node_weights=fx(spark, sf, "fx_node_weights"),
        scripts=numbered.join(source, "script_id").withColumnRenamed("script_path", "path"),
        table_sizes=fx(spark, sf, "fx_table_sizes"), path_sizes=fx(spark, sf, "fx_path_sizes"),
        proposals=fx(spark, sf, "fx_proposals"), applied=fx(spark, sf, "fx_applied"),
        as_of=AS_OF, top_n=2, cooldown_days=30, runs_to_average=400,
    )


def test_a_day_from_runs_to_report(spark, day):
    found = daily.prompt_batch(day)
    candidates, prompts = found.candidates.collect(), found.prompts.collect()
    with_text = {(c.job_id, c.task_key) for c in candidates if c.source is not None}
    assert with_text and {(p.job_id, p.task_key) for p in prompts} == with_text
    assert len(prompts) == len(with_text)
    assert all("TABLE SIZES ON DISK" in p.prompt for p in prompts)

    number = F.regexp_extract("task_key", r"(\d+)", 1).cast("int")
    raw = (
        F.when(number % 4 == 0, F.lit("no json"))
        .when(number % 4 == 1, F.lit('{"changes": []}'))
        .otherwise('{"changes": [{"cell_id": "idx_0", "new_code": "x = 1"}], '
                   '"analysis": {"changes_applied": [{"description": "less work"}]}}')
    )
    answers = found.prompts.select(
        F.concat_ws("/", "job_id", "task_key").alias("response_id"), "job_id", "task_key",
        "script_id", raw.alias("raw"),
    )
    rewrites = daily.rewrites_of(found, answers)
    outcomes = {(r.job_id, r.task_key): r for r in rewrites.collect()}
    assert set(outcomes) == {(c.job_id, c.task_key) for c in candidates}
    for (job, task), r in outcomes.items():
        n = int(re.search(r"\d+", task).group())
        if (job, task) not in with_text:
            assert r.outcome == "export_error"
        else:
            assert r.outcome == {0: "llm_error", 1: "no_changes"}.get(n % 4)
    checked = rewrites.where("check = 'full' AND outcome IS NULL").select(
        "job_id", "task_key", F.lit("passed").alias("validation_status"),
        F.lit(77).cast("bigint").alias("validation_run_id"),
    )
    done = daily.settle(found, rewrites, checked, day, "some-model")
    reported = done.reported.collect()
    for job in {r.job_id for r in reported}:
        assert sum(r.accepted for r in reported if r.job_id == job) <= 2
    rows = done.proposals.collect()
    assert rows and len({r.proposal_id for r in rows}) == len(rows)
    assert len(rows) == sum(r.in_ledger for r in reported)
    assert {r.status for r in rows} == {"proposed"}
    assert all((r.v2_path is None) == (r.validation_status == "llm_error") for r in rows)
    assert {r.validation_run_id for r in rows if r.validation_status == "passed"} == {77}
    assert done.proposals.columns == [
        c.split()[0] for c in ledger_store.TABLES["proposals"][0].split(", ")
    ]

    gains = found.gains.collect()
    assert {r.proposal_id for r in done.shown_gains.collect()} == {g.proposal_id for g in gains}
    path = new_path(spark, "report")
    report_sink.write_report(done.report, path, "text")
    assert spark.read.text(path).count() > 0
    events = new_path(spark, "events")
    ledger_store.append(done.events, events, "events")
    ledger_store.append(done.proposals, events, "proposals")
    state = ledger.ledger_current(ledger_store.read(spark, events, "events")).collect()
    assert ledger_store.read(spark, events, "proposals").count() == len(rows)
    assert {s.proposal_id for s in state} == {r.proposal_id for r in rows}


def test_landed_runs_are_taken_once(spark):
    rows = [(1, 7, [("a", ("SUCCESS",), 1000, 2000), ("b", ("FAILED",), 1000, None)]), (2, 7, None)]
    schema = records.RUN
    path, out, marks = (new_path(spark, n) for n in ("landed", "task-runs", "marks"))
    spark.createDataFrame(rows, schema).write.json(path)
    for _ in range(2):
        query = landing.append_landed(landing.landed_task_runs(spark, path), out, marks)
        assert query.awaitTermination(120)
    got = spark.read.parquet(out)
    assert sorted(r.task_key for r in got.collect()) == ["a", "b"]
    assert runs.task_durations(got).first().duration_s == 1.0
    more = spark.createDataFrame([(3, 7, [("c", ("SUCCESS",), 1, 2)])], schema)
    more.write.mode("append").json(path)
    assert landing.append_landed(landing.landed_task_runs(spark, path), out, marks).awaitTermination(120)
    assert spark.read.parquet(out).count() == 3


def test_scans_do_not_shuffle_and_read_only_text(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select(
        F.col("doc_id").alias("script_id"), F.col("text").alias("source")
    )
    for df in (corpus.scan_scripts(docs), corpus.read_inputs(docs), lineage.lineage_edges(docs)):
        plan = plan_of(df)
        assert "Exchange" not in plan and "Python" not in plan
        assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan


def test_groups_are_cut_before_the_shuffle(spark, sf):
    df = fx(spark, sf, "fx_runs")
    for n in (5, 1500):
        plan = plan_of(top_k(df, ["job_id"], runs.NEWEST_RUN, n))
        # cut within input partitions first, then between them
        assert plan.count("Exchange hashpartitioning") == 2
        assert "hashpartitioning(job_id" in plan and "_input" in plan
        limits = len(re.findall(rf"WindowGroupLimit.*, {n}, Partial", plan))
        assert limits == (2 if n <= 1000 else 0)


def test_no_python_in_any_plan(spark, sf):
    eager = {"script_corpus"}
    for name, fn in registry.QUERIES.items():
        if name not in eager:
            plan = plan_of(fn(spark, sf))
            assert "Python" not in plan and "CartesianProduct" not in plan, name
            assert "BroadcastNestedLoopJoin" not in plan, name
