"""The ledger on disk: repeatable appends, states of a month, z-order."""

import datetime as dt
import random

import pytest

from pipewise.operators import ledger
from pipewise.sources import ledger_store as store
from pipewise.sources.scratch import new_path

EVENT = "proposal_id string, event_ts timestamp_ntz, seq int, status string, actor string, notes string"


def log(rng, n, first=dt.datetime(2024, 1, 3), days=200):
    rows = {}
    for _ in range(n):
        at = first + dt.timedelta(days=rng.randrange(days), hours=rng.randrange(24))
        p, seq = f"p{rng.randrange(40)}", rng.randrange(4)
        rows[p, at, seq] = (p, at, seq, rng.choice(["proposed", "applied", "rejected"]), "a", rng.choice(["n", None]))
    return list(rows.values())


def rows_of(df):
    return sorted([tuple(r) for r in df.collect()], key=str)


def replay(spark, place):
    return rows_of(ledger.ledger_current(store.read(spark, place, "events")))


def shown(df):
    return rows_of(ledger.ledger_current(df))


def test_appending_a_batch_twice_changes_nothing(spark):
    place = new_path(spark, "ledger")
    store.create_ledger(spark, place)
    rows = log(random.Random(1), 60)
    events = spark.createDataFrame(rows, EVENT)
    store.append(events, place, "events", batch="day-1")
    once = rows_of(store.read(spark, place, "events"))
    assert len(once) == len(rows)
    store.append(events.union(events), place, "events", batch="day-1")
    assert rows_of(store.read(spark, place, "events")) == once
    # a run that stopped half way is completed
    half = new_path(spark, "ledger")
    store.append(spark.createDataFrame(rows[:20], EVENT), half, "events", batch="day-1")
    store.append(events, half, "events", batch="day-1")
    assert rows_of(store.read(spark, half, "events")) == once
    # another batch, and an append without a name, write every row
    store.append(spark.createDataFrame(rows[:5], EVENT), place, "events", batch="day-2")
    store.append(spark.createDataFrame(rows[:5], EVENT), place, "events")
    assert len(rows_of(store.read(spark, place, "events"))) == len(rows) + 10
    store.append(events.limit(0), place, "events", batch="day-3")


@pytest.mark.parametrize("table", sorted(store.TABLES))
def test_every_table_can_be_appended_again(spark, table):
    place = new_path(spark, "ledger")
    columns, time = store.TABLES[table]
    names = [c.split()[0] for c in columns.split(", ")]
    values = {time: dt.datetime(2024, 5, 6), "proposal_id": "p1", "applied_ts": dt.datetime(2024, 5, 1)}
    values[time] = dt.datetime(2024, 5, 6)
    row = tuple(values.get(n) for n in names)
    rows = spark.createDataFrame([row], columns)
    for _ in range(2):
        store.append(rows, place, table, batch="b")
    assert store.read(spark, place, table).count() == 1


def test_old_months_are_not_read(spark):
    place = new_path(spark, "ledger")
    store.append(spark.createDataFrame(log(random.Random(2), 80), EVENT), place, "events")
    store.write_state(spark, place, dt.date(2024, 5, 1))
    plan = store.current_events(spark, place)._jdf.queryExecution().executedPlan().toString()
    assert "month#" in plan and "2024-05-01" in plan and "PartitionFilters" in plan
    # nothing is lost when the old months are gone
    want = replay(spark, place)
    old = spark.read.parquet(f"{place}/events").where("month >= DATE'2024-05-01'")
    kept = new_path(spark, "ledger")
    old.write.partitionBy("month").parquet(f"{kept}/events")
    spark.read.parquet(f"{place}/state").write.partitionBy("month").parquet(f"{kept}/state")
    assert shown(store.current_events(spark, kept)) == want


def test_states_equal_a_full_replay(spark):
    rng = random.Random(3)
    place = new_path(spark, "ledger")
    store.create_ledger(spark, place)
    assert store.state_months(spark, place) == []
    assert shown(store.current_events(spark, place)) == []
    months = [dt.date(2024, 3, 1), dt.date(2024, 5, 1), dt.date(2024, 6, 1)]
    for k in range(3):
        store.append(spark.createDataFrame(log(rng, 40, days=250), EVENT), place, "events", batch=f"b{k}")
        store.write_state(spark, place, months[k])
        assert store.state_months(spark, place) == months[: k + 1]
        assert shown(store.current_events(spark, place)) == replay(spark, place)
    # events of a month before the states make those anew
    late = [("p1", dt.datetime(2024, 2, 28), 9, "applied", "late", None), ("new", dt.datetime(2024, 2, 1), 0, "proposed", "late", None)]
    store.append(spark.createDataFrame(late, EVENT), place, "events", batch="late")
    assert shown(store.current_events(spark, place)) == replay(spark, place)
    assert ("new" in {r[0] for r in replay(spark, place)})
    with pytest.raises(ValueError):
        store.write_state(spark, place, dt.date(2024, 5, 2))


def test_z_order_skips_files_for_every_column(spark):
    rows = spark.range(40_000).selectExpr(
        "concat('s', lpad(string(pmod(hash(id), 1000)), 4, '0')) AS status",
        "timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(int(pmod(hash(id, 7), 365))) AS at",
        "id",
    )
    path = new_path(spark, "z")
    store.write_clustered(rows, path, ["status", "at"], 64)
    by_file = spark.read.parquet(path).selectExpr("_metadata.file_path AS f", "*").groupBy("f").agg(
        {"status": "min", "at": "min"}
    )
    ends = spark.read.parquet(path).selectExpr("_metadata.file_path AS f", "*").groupBy("f").agg(
        {"status": "max", "at": "max"}
    )
    files = by_file.join(ends, "f").collect()
    assert 32 <= len(files) <= 64
    one = sum(r["min(status)"] <= "s0500" <= r["max(status)"] for r in files)
    day = dt.datetime(2024, 7, 1)
    other = sum(r["min(at)"] <= day <= r["max(at)"] for r in files)
    assert one <= len(files) / 2 and other <= len(files) / 2
    assert sorted(r.id for r in spark.read.parquet(path).collect()) == list(range(40_000))


def test_z_order_of_odd_values(spark):
    rows = spark.createDataFrame([(None, None), ("é", 1.0), ("", float("nan")), ("b" * 50, -1.0)], "a string, b double")
    path = new_path(spark, "z")
    store.write_clustered(rows, path, ["a", "b"], 2)
    assert len(rows_of(spark.read.parquet(path))) == 4
    store.write_clustered(rows.limit(0), new_path(spark, "z"), ["a", "b"], 2)
