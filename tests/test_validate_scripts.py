"""From scanned scripts to validation statuses."""

import re

import pytest

from pipewise.plans import validation


def run_sql(spark, proposal, source):
    for statement in re.findall(r'spark\.sql\("(.*?)"\)', source):
        spark.sql(statement).collect()


@pytest.fixture()
def tables(spark, tmp_path):
    spark.sql(f"CREATE SCHEMA wh LOCATION '{tmp_path}/wh'")
    spark.sql(f"CREATE SCHEMA lake LOCATION '{tmp_path}/lake'")
    spark.range(100).selectExpr("id AS k", "id * 2.5D AS v").write.saveAsTable("wh.out")
    spark.range(7).selectExpr("id AS k").write.saveAsTable("wh.two")
    spark.range(7).selectExpr("id AS k").write.saveAsTable("lake.two")
    yield
    for schema in ("wh", "lake", "scratch"):
        spark.sql(f"DROP SCHEMA IF EXISTS {schema} CASCADE")


def test_all_statuses(spark, tables):
    good = "spark.sql(\"INSERT INTO wh.out SELECT id AS k, id * 2.5D AS v FROM range(100)\")"
    rows = [
        ("passed", good, "green", [], ["wh.out"]),
        ("again", good, "green", [], ["wh.out"]),
        ("rows", good.replace("range(100)", "range(99)"), "green", [], ["wh.out"]),
        ("shape", 'spark.sql("CREATE OR REPLACE TEMP VIEW x AS SELECT 1") '
                  'spark.sql("DROP TABLE wh.out") spark.sql("CREATE TABLE wh.out USING parquet AS SELECT 1 AS k")',
         "green", [], ["wh.out"]),
        ("gone", 'spark.sql("DROP TABLE wh.out")', "green", [], ["wh.out"]),
        ("crash", 'spark.sql("INSERT INTO wh.out SELECT no_such_column")', "green", [], ["wh.out"]),
        ("yellow", good, "yellow", [], ["wh.out"]),
        ("yellow crash", 'spark.sql("SELECT raise_error(\'no\')")', "yellow", [], ["wh.out"]),
        ("mails", good, "yellow", ["Email"], ["wh.out"]),
        ("one name", good, "green", [], ["wh.two", "lake.two"]),
        ("two pairs", good + ' spark.sql("INSERT INTO wh.two SELECT id FROM range(7)")', "green", [], ["wh.out", "wh.two"]),
        ("new table", 'spark.sql("CREATE TABLE wh.fresh USING parquet AS SELECT 1 AS k")', "green", [], ["wh.fresh"]),
    ]
    scripts = spark.createDataFrame(
        rows, "proposal_id string, source string, tier string, side_effects array<string>, target_tables array<string>"
    )
    got = {r.proposal: (r.n_pairs, r.validation_status) for r in validation.validate_scripts(spark, scripts, run_sql).collect()}
    assert got == {
        "passed": (1, "passed"), "again": (1, "passed"), "rows": (1, "data_mismatch"),
        "shape": (1, "schema_mismatch"), "gone": (1, "schema_mismatch"), "crash": (0, "smoke_failed"),
        "yellow": (0, "smoke_passed"), "yellow crash": (0, "smoke_failed"), "mails": (0, "skipped"),
        "one name": (0, "failed"), "two pairs": (2, "passed"), "new table": (1, "schema_mismatch"),
    }
    # the tables themselves are untouched and the scratch tables gone
    assert spark.table("wh.out").count() == 100 and spark.table("wh.two").count() == 7
    assert spark.sql("SHOW TABLES IN scratch").where("NOT isTemporary").count() == 0


def test_modes_and_no_scripts(spark, tables):
    rows = [("p", "spark.sql(\"SELECT 1\")", "green", [], ["wh.out"])]
    schema = "proposal_id string, source string, tier string, side_effects array<string>, target_tables array<string>"
    scripts = spark.createDataFrame(rows, schema)
    for mode, want in (("off", "skipped"), ("smoke", "skipped"), ("auto", "data_mismatch")):
        got = validation.validate_scripts(spark, scripts, run_sql, mode=mode).first()
        assert got.validation_status == want
    assert validation.validate_scripts(spark, scripts.limit(0), run_sql).count() == 0
