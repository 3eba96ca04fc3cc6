"""Checking rewrites: schema first, data only where the schema holds."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from functools import reduce

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pipewise.functions import scan
from pipewise.operators.equivalence import Pair, ladder, schema_diff, schema_summary, table_diff
from pipewise.sources.ledger_store import drop_scratch, empty_copy
from pipewise.sources.scratch import materialize, new_path

CHECKS = (
    "proposal string, table string, smoke_ok boolean, smoke_only boolean, "
    "schema_match boolean, data_match boolean, broken boolean"
)


def data_checks(pairs: list[Pair], rel_tol: float = 0.0) -> DataFrame:
    """Sum and count comparison of all pairs as one plan; each side of a pair
    is scanned once."""
    diffs = [
        table_diff(p.reference, p.candidate, rel_tol).select(
            F.lit(p.proposal).alias("proposal"), F.lit(p.table).alias("table"),
            "column", "ref_sum", "cand_sum", "match",
        )
        for p in pairs
    ]
    return reduce(DataFrame.unionByName, diffs)


def smoke(pairs: list[Pair]) -> tuple[list[Pair], set[str]]:
    """Run every candidate once, into a scratch table.

    Gives the pairs over what was written, so that no later step runs a
    candidate again, and the proposals of which a candidate failed.
    """
    written, failed = [], set()
    for p in pairs:
        try:
            written.append(replace(p, candidate=materialize(p.candidate, "candidate")))
        except Exception:  # noqa: BLE001 - whatever stops a candidate is its failure
            failed.add(p.proposal)
            written.append(p)
    return written, failed


def _compared(pairs: list[Pair], rel_tol: float) -> tuple[list[DataFrame], list[Pair]]:
    """Written comparisons, and the pairs whose comparison raises. All are one
    plan; only if that raises is each run by itself."""
    if not pairs:
        return [], []
    try:
        return [materialize(data_checks(pairs, rel_tol), "checks")], []
    except Exception:  # noqa: BLE001 - told apart below
        if len(pairs) == 1:
            return [], pairs
    done, broken = [], []
    for pair in pairs:
        own, lost = _compared([pair], rel_tol)
        done, broken = done + own, broken + lost
    return done, broken


def validate_tables(spark: SparkSession, pairs: list[Pair], smoke_failed: set[str] = frozenset(),
                    smoke_only: set[str] = frozenset(), proposals: list[str] | None = None,
                    rel_tol: float = 0.0) -> DataFrame:
    """Validation status of every proposal. Eager: the comparisons are written.

    The schema step reads metadata only; data is scanned only for proposals
    whose schemas all match and that are to be checked in full. ``proposals``
    names those without any pair, too. All comparisons are one plan; if it
    raises, pairs are compared one by one, and those that raise have ``failed``.
    """
    names = sorted(set(proposals or []) | {p.proposal for p in pairs})
    fields = {
        id(p): [
            sorted((f.name, f.dataType.simpleString()) for f in df.schema.fields)
            for df in (p.reference, p.candidate)
        ]
        for p in pairs
    }
    differs = {p.proposal for p in pairs if fields[id(p)][0] != fields[id(p)][1]}
    full = [
        p for p in pairs
        if p.proposal not in differs and p.proposal not in smoke_failed
        and p.proposal not in smoke_only
    ]
    rows = [
        (p.proposal, p.table, p.proposal not in smoke_failed, p.proposal in smoke_only,
         fields[id(p)][0] == fields[id(p)][1], None, False)
        for p in pairs if p not in full
    ] + [
        (n, None, n not in smoke_failed, n in smoke_only, None, None, False)
        for n in names if n not in {p.proposal for p in pairs}
    ]
    compared, broken = _compared(full, rel_tol)
    rows += [(p.proposal, p.table, True, False, True, None, True) for p in broken]
    checks = spark.createDataFrame(rows, CHECKS)
    for df in compared:
        measured = df.groupBy("proposal", "table").agg(
            F.bool_and("match").alias("data_match")
        ).select(
            "proposal", "table", F.lit(True).alias("smoke_ok"), F.lit(False).alias("smoke_only"),
            F.lit(True).alias("schema_match"), "data_match", F.lit(False).alias("broken"),
        )
        checks = checks.unionByName(measured)
    return ladder(checks)


def schema_report(spark: SparkSession, pairs: list[Pair]) -> DataFrame:
    """Which columns of each pair are missing, added or changed."""
    return schema_summary(schema_diff(spark, pairs))


# --- from scanned scripts to statuses ------------------------------------------

Run = Callable[[SparkSession, str, str], None]
"""Runs a script, given the proposal and the text; raises if it fails."""


def check_plan(scripts: DataFrame, mode: str = "on", schema: str = "scratch") -> DataFrame:
    """(proposal_id, check, target_tables, scratch_tables, source): which check each
    rewrite gets, and its text pointed at scratch tables of its own.

    ``scripts`` has proposal_id, source (the new text), tier, side_effects and
    target_tables, as ``scan_scripts`` gives them. The suffix of a proposal's
    scratch tables is a hash of its id, so that proposals with one target keep
    apart.
    """
    suffix = F.lower(F.hex(F.xxhash64("proposal_id")))
    return scripts.select(
        "proposal_id",
        scan.rewrite_check(F.col("tier"), F.col("side_effects"), mode).alias("check"),
        "target_tables",
        F.transform("target_tables", lambda t: scan.scratch_name(t, suffix, schema)).alias("scratch_tables"),
        scan.suffix_targets(F.col("source"), F.col("target_tables"), suffix, schema).alias("source"),
    )


def _table(spark: SparkSession, name: str) -> DataFrame:
    """The table; one that cannot be read has columns that nothing equals."""
    try:
        return spark.table(name)
    except PySparkException:
        return spark.createDataFrame([], f"no_table_{abs(hash(name))} int")


def _smoke_run(spark: SparkSession, row, run: Run) -> str | None:
    """What went wrong: ``failed`` before the script ran, ``smoke_failed`` in it."""
    folded = [t.lower() for t in row.scratch_tables]
    if len(set(folded)) < len({t.lower() for t in row.target_tables}):
        return "failed"  # two targets would share a scratch table
    try:
        for target, stand_in in zip(row.target_tables, row.scratch_tables):
            if spark.catalog.tableExists(target):
                empty_copy(spark.table(target)).write.saveAsTable(stand_in)
    except PySparkException:
        return "failed"
    try:
        run(spark, row.proposal_id, row.source)
    except Exception:  # noqa: BLE001 - whatever stops a script is its failure
        return "smoke_failed"
    return None


def validate_scripts(spark: SparkSession, scripts: DataFrame, run: Run, mode: str = "on",
                     schema: str = "scratch", rel_tol: float = 0.0) -> DataFrame:
    """(proposal, n_pairs, validation_status): every rewrite run against scratch
    tables and held against the tables its targets are.

    ``scripts`` as for ``check_plan``; the batch comes to the driver, where runs
    are started, so it is as large as the day's quota of proposals. Each script
    finds an empty copy of every target that exists, with the target's columns.
    Two targets on one scratch name, or a copy that cannot be made: failed. A
    target or scratch table that cannot be read after the run is a schema
    mismatch. Not checked by mode, tier or side effects: skipped. All data
    comparisons are one plan. Scratch tables are dropped at the end, whatever
    happens. Eager.
    """
    spark.sql(f"CREATE SCHEMA IF NOT EXISTS {schema} LOCATION '{new_path(spark, schema)}'")
    rows = sorted(check_plan(scripts, mode, schema).collect(), key=lambda r: r.proposal_id)
    pairs, fixed, smoke_failed, smoke_only, checked = [], [], set(), set(), []
    try:
        for row in rows:
            if row.check == "skip":
                fixed.append((row.proposal_id, 0, "skipped"))
                continue
            wrong = _smoke_run(spark, row, run)
            if wrong == "failed":
                fixed.append((row.proposal_id, 0, "failed"))
                continue
            checked.append(row.proposal_id)
            if wrong:
                smoke_failed.add(row.proposal_id)
            if row.check == "smoke":
                smoke_only.add(row.proposal_id)
            elif not wrong:
                pairs += [
                    Pair(row.proposal_id, target, _table(spark, target), _table(spark, stand_in))
                    for target, stand_in in zip(row.target_tables, row.scratch_tables)
                ]
        statuses = spark.createDataFrame(fixed, "proposal string, n_pairs long, validation_status string")
        if checked:
            found = validate_tables(spark, pairs, smoke_failed, smoke_only, checked, rel_tol)
            statuses = statuses.unionByName(found)
        return materialize(statuses, "validated")
    finally:
        drop_scratch(spark, [t for row in rows if row.check != "skip" for t in row.scratch_tables])
