"""The ledger on disk: append-only tables, written in parquet."""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pipewise.sources.scratch import materialize

TABLES = {
    "events": (
        "proposal_id STRING, event_ts TIMESTAMP_NTZ, seq INT, status STRING, actor STRING, "
        "notes STRING",
        "event_ts",
    ),
    "proposals": (
        "proposal_id STRING, created_ts TIMESTAMP_NTZ, run_id BIGINT, task_key STRING, "
        "original_path STRING, v2_path STRING, duration_original_s DOUBLE, tier STRING, "
        "tier_reason STRING, target_tables ARRAY<STRING>, side_effects ARRAY<STRING>, "
        "llm_model STRING, llm_analysis STRING, llm_duration_s DOUBLE, validation_status STRING, "
        "validation_details STRING, validation_run_id BIGINT, original_source_hash STRING, "
        "job_id BIGINT, status STRING, status_updated_ts TIMESTAMP_NTZ, "
        "status_updated_by STRING, notes STRING",
        "created_ts",
    ),
    "applied_changes": (
        "applied_ts TIMESTAMP_NTZ, proposal_id STRING, script_path STRING, backup_path STRING, "
        "applied_by STRING, rollback_ts TIMESTAMP_NTZ, rollback_by STRING, "
        "first_reported_ts TIMESTAMP_NTZ",
        "applied_ts",
    ),
    "rollbacks": (
        "proposal_id STRING, rollback_ts TIMESTAMP_NTZ, rollback_by STRING",
        "rollback_ts",
    ),
    "reported": (
        "proposal_id STRING, applied_ts TIMESTAMP_NTZ, first_reported_ts TIMESTAMP_NTZ",
        "first_reported_ts",
    ),
}
"""Columns of each table, and the time whose month parts it into folders."""


KEYS = {
    "events": ["proposal_id", "event_ts", "seq"],
    "proposals": ["proposal_id"],
    "applied_changes": ["proposal_id", "applied_ts"],
    "rollbacks": ["proposal_id", "rollback_ts"],
    "reported": ["proposal_id", "applied_ts"],
}
"""What tells the rows of one batch apart."""
STATE = "proposal_id STRING, event_ts TIMESTAMP_NTZ, seq INT, status STRING, actor STRING, notes STRING"


def create_ledger(spark: SparkSession, place: str) -> None:
    """The ledger's tables below ``place``, empty where they do not exist."""
    for name, (columns, _) in TABLES.items():
        spark.createDataFrame([], f"{columns}, batch STRING, month DATE").write.mode("ignore").parquet(
            f"{place}/{name}"
        )


def _written(spark: SparkSession, place: str, table: str) -> DataFrame:
    """The table with the batch of each row; no rows where nothing was written."""
    schema = f"{TABLES[table][0]}, batch STRING, month DATE"
    try:
        return spark.read.schema(schema).parquet(f"{place}/{table}")
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def append(rows: DataFrame, place: str, table: str, batch: str | None = None) -> None:
    """Append to a table of the ledger, a folder per month.

    Under the name of a ``batch`` an append can be repeated: rows that the batch
    has written before are left out, told by the keys of the table in the months
    of the new rows alone; of rows with one key in the batch one is written, the
    smallest. Without a name every row is written. The rows of a month are
    brought together first, so that a batch writes a few files per month and not
    one per task; adaptive execution splits a month that holds most of the rows.
    Rows of a month that a state was written for make that state anew.
    """
    spark = rows.sparkSession
    columns, time = TABLES[table]
    names = [c.split()[0] for c in columns.split(", ")]
    dated = rows.select(*names, F.lit(batch).alias("batch"), F.trunc(time, "month").alias("month"))
    states = state_months(spark, place) if table == "events" else []
    months: list = []
    if batch is not None or states:
        dated = materialize(dated, "batch")
        months = [r.month for r in dated.select("month").distinct().collect()]
    if batch is not None and months:
        keys = KEYS[table]
        others = [c for c in dated.columns if c not in keys]
        dated = dated.groupBy(*keys).agg(F.min(F.struct(*others)).alias("_r")).select(*keys, "_r.*")
        # months are folders: no other month of the table is read
        mine = _written(spark, place, table).where(F.col("month").isin(months) & (F.col("batch") == batch))
        known = mine.select(*[F.col(k).alias(f"_{k}") for k in keys])
        same = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys])
        dated = dated.join(known, same, "left_anti").select(*names, "batch", "month")
    dated.hint("rebalance", "month").write.mode("append").partitionBy("month").parquet(
        f"{place}/{table}"
    )
    first = min((m for m in months if m is not None), default=None)
    for month in states:
        if first is not None and first < month:
            write_state(spark, place, month)


def read(spark: SparkSession, place: str, table: str) -> DataFrame:
    return spark.read.schema(f"{TABLES[table][0]}, month DATE").parquet(f"{place}/{table}")


# --- state of the proposals at the beginning of a month --------------------------


def _states(spark: SparkSession, place: str) -> DataFrame | None:
    try:
        return spark.read.schema(f"{STATE}, month DATE").parquet(f"{place}/state")
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def state_months(spark: SparkSession, place: str) -> list[dt.date]:
    """Months at whose beginning a state was written, in order; from the names of
    folders alone."""
    states = _states(spark, place)
    if states is None:
        return []
    return sorted(r.month for r in states.select("month").distinct().collect())


def _last_events(spark: SparkSession, place: str, until: dt.date | None) -> DataFrame:
    """The last event of each proposal before ``until``: the newest state before it
    and the months from there on; older months are not read."""
    own = [m for m in state_months(spark, place) if until is None or m < until]
    rows = read(spark, place, "events")
    if until is not None:
        rows = rows.where(F.col("month") < F.lit(until))
    names = [c.split()[0] for c in STATE.split(", ")]
    if own:
        rows = rows.where(F.col("month") >= F.lit(own[-1])).select(*names)
        rows = rows.unionByName(_states(spark, place).where(F.col("month") == F.lit(own[-1])).select(*names))
    last = F.max_by(F.struct(*names[1:]), F.struct("event_ts", "seq"))
    return rows.groupBy("proposal_id").agg(last.alias("e")).select("proposal_id", "e.*")


def write_state(spark: SparkSession, place: str, month: dt.date) -> None:
    """The state of every proposal at the beginning of ``month``: its last event
    before that, made from the state before and the months between. Written
    again, it takes the place of the old one."""
    if month.day != 1:
        raise ValueError("a state belongs to the first day of a month")
    found = materialize(_last_events(spark, place, month), "state")
    found.write.mode("overwrite").parquet(f"{place}/state/month={month.isoformat()}")


def current_events(spark: SparkSession, place: str) -> DataFrame:
    """The last event of every proposal, as columns of the event log; equal to a
    replay of the whole log (``ledger.ledger_current``), but only the newest state
    and the months since are read."""
    return _last_events(spark, place, None)


BITS = 10
"""Bits of the rank of a column in a z-order key."""


def z_order_key(df: DataFrame, by: list[str], bits: int = BITS, accuracy: int = 10_000) -> Column:
    """The bits of the columns' ranks, interleaved: rows near each other in every
    column are near each other in this order.

    A rank is the number of cut values, at most 2^bits - 1 of them, that a value
    reaches; cuts are approximate quantiles (of times and numbers as doubles, of other
    values by the first eight bytes of their text). Nulls come
    first. One aggregation for all columns; the cuts come to the driver.
    """
    if bits * len(by) > 63:
        raise ValueError("too many bits for one key")

    def number(name: str) -> Column:
        kind = dict(df.dtypes)[name]
        if kind.startswith("timestamp") or kind == "date":
            return F.unix_micros(F.col(name).cast("timestamp")).cast("double")
        if kind in ("tinyint", "smallint", "int", "bigint", "float", "double") or kind.startswith("decimal"):
            return F.col(name).cast("double")
        text = F.col(name).cast("string").cast("binary")
        return F.conv(F.rpad(F.hex(F.substring(text, 1, 8)), 16, "0"), 16, 10).cast("double")

    parts = 1 << bits
    shares = [k / parts for k in range(1, parts)]
    cuts = df.agg(*[F.percentile_approx(number(c), shares, accuracy).alias(f"c{i}") for i, c in enumerate(by)])
    found = cuts.first()

    def rank(name: str, values: list[float]) -> Column:
        own = F.array(*[F.lit(x) for x in sorted(set(values))]).cast("array<double>")
        value = number(name)
        reached = F.size(F.filter(own, lambda cut: cut <= value))
        return F.when(value.isNull(), 0).otherwise(reached)

    ranks = [rank(name, found[f"c{i}"] or []) for i, name in enumerate(by)]
    key = F.lit(0).cast("bigint")
    for bit in range(bits):
        for i, rank in enumerate(ranks):
            one = F.shiftright(rank.cast("bigint"), bit).bitwiseAND(F.lit(1).cast("bigint"))
            key = key.bitwiseOR(F.shiftleft(one, bit * len(ranks) + len(ranks) - 1 - i))
    return key


def write_clustered(df: DataFrame, path: str, by: list[str], files: int, bits: int = BITS) -> None:
    """Rewrite a table clustered by columns in z-order, so that a filter on any one
    of them skips files. A single column is simply sorted."""
    if len(by) == 1:
        ordered = df.repartitionByRange(files, *by).sortWithinPartitions(*by)
    else:
        keyed = df.withColumn("_z", z_order_key(df, by, bits))
        ordered = keyed.repartitionByRange(files, "_z").sortWithinPartitions("_z", *by).drop("_z")
    ordered.write.mode("errorifexists").parquet(path)


def empty_copy(df: DataFrame) -> DataFrame:
    """No rows, same schema: the scratch stand-in for a target table."""
    return df.sparkSession.createDataFrame([], df.schema)


def drop_scratch(spark: SparkSession, tables: list[str]) -> None:
    for table in tables:
        spark.sql("DROP TABLE IF EXISTS IDENTIFIER(:name)", args={"name": table})
