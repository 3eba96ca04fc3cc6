import datetime as dt
import pytest
from pyspark.sql import functions as F

from pipewise.functions import report
from pipewise.operators import reporting
from pipewise.sources import ledger_store
from pipewise.sources.scratch import new_path

STATUSES = "tier string, status string, run bigint, m array<string>, a array<string>, c array<string>"


@pytest.mark.parametrize(
    "row, expected",
    [
        (("green", "passed", 5, [], [], []), "✅ <http://w/jobs/runs/5|smoke>  ✅ schema  ✅ data"),
        (("green", "passed", None, [], [], []), "✅ smoke  ✅ schema  ✅ data"),
        (("green", "schema_mismatch", None, ["x"], ["y", "z"], ["q"]), "✅ smoke  ❌ schema — `x` +2 more"),
        (("green", "schema_mismatch", None, [], ["y"], []), "✅ smoke  ❌ schema — `y`"),
        (("green", "schema_mismatch", None, [], [], ["q", "r"]), "✅ smoke  ❌ schema — type `q` changed"),
        (("green", "schema_mismatch", None, None, None, None), "✅ smoke  ❌ schema"),
        (("green", "smoke_failed", None, [], [], []), "❌ smoke"),
        (("yellow", "smoke_failed", 1, [], [], []), "❌ <http://w/jobs/runs/1|smoke>"),
        (("yellow", "passed", None, [], [], []), "⏭ skipped"),
        (("green", "skipped", None, [], [], []), "⏭ skipped"),
        (("yellow", "failed", None, [], [], []), "❌ error"),
        (("green", "llm_error", None, [], [], []), "✅ smoke  ✅ schema"),
    ],
)
def test_validation_line(spark, row, expected):
    cols = [F.col(c) for c in ("tier", "status", "run", "m", "a", "c")]
    df = spark.createDataFrame([row], STATUSES)
    line = df.select(report.validation_line(*cols, url="http://w")).first()[0]
    assert line == "Validation: " + expected


def test_cards(spark):
    many = ",".join('{"description":"d%d","estimated_savings":"low"}' % i for i in range(6))
    rows = [
        (1, 1, "t", "green", "passed", 90.0, 15.0, '{"what_it_does":"Loads.","changes_applied":[%s]}' % many,
         None, "/v2", "p1"),
        (1, 2, "u", "unknown", "export_error", 60.0, None, None, "e" * 200, None, None),
        (1, 3, "v", "yellow", "no_changes", 60.0, 1.0, "{}", None, None, None),
    ]
    df = spark.createDataFrame(
        rows, "job_id int, pos int, task_key string, tier string, outcome string, duration_s double, "
        "cost_weight double, analysis string, error string, v2_path string, proposal_id string",
    )
    got = [r.card for r in reporting.proposal_cards(df).orderBy("pos").collect()]
    assert got[0] == (
        "*1. `t`*  🟢 ✅\n*1.5 min*  ·  *15.0×*\n_Loads._\n*Proposed changes:*\n"
        "• d0  🟢\n• d1  🟢\n• d2  🟢\n• d3  🟢\nValidation: ✅ smoke  ✅ schema  ✅ data\n"
        "v2: `/v2`\nApprove with proposal_id `p1`"
    )
    assert got[1].startswith("*2. `u`*  ❔ 🚫\n*1.0 min*\n_🚫 Error: " + "e" * 180 + "_\n")
    assert "💤 _No changes" in got[2] and "v2:" not in got[2]


def test_header(spark):
    runs = spark.createDataFrame(
        [(1, 10, 1), (1, 11, 2), (1, 12, 3), (2, 20, 1)], "job_id int, run_id bigint, run_pos int"
    )
    labels = spark.createDataFrame(
        [(1, "by cost score"), (2, "slowest"), (3, "slowest")], "job_id int, rank_label string"
    )
    got = {r.job_id: r.header for r in reporting.report_header(runs, labels, 3, "1998-07-01 08:30:00").collect()}
    assert got == {
        j: "Daily optimization report  ·  1998-07-01  ·  08:30 UTC\n" + t
        for j, t in {
            1: "Runs `10` + `11` (avg 2)  ·  Top 3 by cost score notebooks",
            2: "Run `20`  ·  Top 3 slowest notebooks", 3: "No runs recorded  ·  Top 3 slowest notebooks",
        }.items()
    }


def test_ledger_tables(spark):
    place = new_path(spark, "ledger")
    ledger_store.create_ledger(spark, place)
    assert ledger_store.read(spark, place, "proposals").count() == 0
    assert len(ledger_store.read(spark, place, "proposals").columns) == 24
    rows = spark.createDataFrame(
        [("p", "u", dt.datetime(1998, 2, 3))],
        "proposal_id string, rollback_by string, rollback_ts timestamp_ntz",
    )
    ledger_store.append(rows, place, "rollbacks")
    ledger_store.create_ledger(spark, place)
    assert [r.month for r in ledger_store.read(spark, place, "rollbacks").collect()] == [
        dt.date(1998, 2, 1)
    ]
