"""What must not grow with a few files, a few keys or a number of folders."""

import datetime as dt
import glob
import os

import checks.queries  # noqa: F401  (fills the registry)
from checks import registry
from pipewise.operators import ledger
from pipewise.sources import report_sink
from pipewise.sources.scratch import new_path, scratch_dir
from pipewise.sources.scripts import read_scripts, write_bundles


def test_scripts_are_no_file_each(spark, sf):
    before = set(glob.glob(f"{scratch_dir(spark)}/pipewise/scripts-*"))
    n = registry.QUERIES["script_corpus"](spark, sf).count()
    new = set(glob.glob(f"{scratch_dir(spark)}/pipewise/scripts-*")) - before
    files = [f for p in new for f in glob.glob(f"{p}/**/part-*", recursive=True)]
    assert n == registry.table(spark, sf, "part").count() and 0 < len(files) < n / 10


def test_bundles_hold_any_text(spark):
    texts = ["", "\n", "a\r\nb \x1e\x00c", '{"path":"x"}\n', "ñ 🙂 \\n \\u000a"]
    root = new_path(spark, "bundles")
    rows = spark.createDataFrame([(f"/j/{k}", t) for k, t in enumerate(texts)], "path string, source string")
    write_bundles(rows, root)
    got = {r.path: r.source for r in read_scripts(spark, root, bundled=True).collect()}
    assert got == {f"/j/{k}": t for k, t in enumerate(texts)}


def test_texts_of_one_file_are_scanned_by_all_cores(spark, sf):
    """A scan of one row group, and then the work on all that is made of its rows."""
    names = "validation_plan self_reference suffix_targets prompt_rows unmatched_changes parquet_var_sizes size_context"
    for name in names.split():
        plan = registry.QUERIES[name](spark, sf)._jdf.queryExecution().toString()
        physical = plan[plan.index("== Physical Plan ==") :]
        assert "RoundRobinPartitioning" in physical or name == "size_context", name
    plan = registry.QUERIES["self_reference"](spark, sf)._jdf.queryExecution().toString()
    before_dealing = plan[plan.index("== Physical Plan ==") :].split("RoundRobinPartitioning")[1:]
    assert all("regexp_extract_all" not in part.split("FileScan")[0] for part in before_dealing)


def test_shuffles_begin_by_the_size_of_the_tables(spark, sf, monkeypatch):
    monkeypatch.setattr(registry, "PART_ROWS", 10)
    before = spark.conf.get(registry.INITIAL, None)
    try:
        registry.fx(spark, sf, "fx_runs")
        rows = registry.table(spark, sf, "orders").count()
        assert int(spark.conf.get(registry.INITIAL)) >= rows // 10
    finally:
        if before is None:
            spark.conf.unset(registry.INITIAL)
        else:
            spark.conf.set(registry.INITIAL, before)


def test_report_is_dealt_by_jobs(spark, monkeypatch):
    monkeypatch.setattr(report_sink, "JOBS", 2)
    monkeypatch.setattr(report_sink, "JOB_ROWS", 50)
    rows = [(k % 10, "2 gains", str(k), "x") for k in range(100)]
    rows += [(77, "3 cards", str(k), "y") for k in range(400)] + [(None, "1 header", "", "z")]
    df = spark.createDataFrame(rows, "job_id bigint, section string, item string, text string")
    path = new_path(spark, "report")
    report_sink.write_report(df, path)
    files = glob.glob(f"{path}/job_id=*/part-*")
    tasks = {os.path.basename(f).split("-")[1] for f in files}
    assert len(tasks) > 3 and len(glob.glob(f"{path}/job_id=77/part-*")) > 1
    got = spark.read.schema(df.schema).json(path).select(df.columns).collect()
    assert sorted(map(str, got)) == sorted(map(str, df.collect()))


def test_proposals_without_backup_do_not_meet_in_one_task(spark):
    day = dt.datetime(2026, 1, 1)
    n = 200
    decisions = spark.createDataFrame(
        [(f"p{k}", "rollback" if k else "approve", "u", day, "n") for k in range(n)],
        "proposal_id string, action string, actor string, decided_ts timestamp_ntz, notes string",
    )
    state = spark.createDataFrame(
        [(f"p{k}", "t", f"/s{k}", f"/v{k}", "", "applied" if k else "proposed", "") for k in range(n)],
        "proposal_id string, task_key string, original_path string, v2_path string, stored_hash string, status string, notes string",
    )
    scripts = spark.createDataFrame([("/s0", "x"), ("b1", "old")], "path string, source string")
    applied = spark.createDataFrame(
        [("p1", day, "b1", None)],
        "proposal_id string, applied_ts timestamp_ntz, backup_path string, rollback_ts timestamp_ntz",
    )
    asked = []
    own = ledger.materialize
    ledger.materialize = lambda df, name: (asked.append((name, df)), own(df, name))[1]
    try:
        out = ledger.apply_decisions(decisions, state, scripts, applied)
    finally:
        ledger.materialize = own
    got = {r.proposal_id: (r.result, r.reason) for r in out.collect()}
    assert got["p0"] == ("applied", "") and got["p1"] == ("rolled_back", "")
    assert {got[f"p{k}"] for k in range(2, n)} == {("refused", "no applied change found")}
    assert [name for name, _ in asked] == ["decisions-given", "decisions-known", "decisions-asked"]
    plan = dict(asked)["decisions-asked"]._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftOuter, (backup_path" not in plan
