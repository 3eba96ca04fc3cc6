import datetime as dt
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from pipewise.operators import ledger
from pipewise.plans.decisions import decide
from pipewise.sources import ledger_store
from pipewise.sources.scratch import new_path

T0 = dt.datetime(1998, 1, 1)
STATE = (
    "proposal_id string, task_key string, original_path string, v2_path string, stored_hash string, "
    "status string, notes string, tier string, validation_status string"
)
DECISIONS = "proposal_id string, action string, actor string, decided_ts timestamp_ntz, notes string"
APPLIED = "proposal_id string, applied_ts timestamp_ntz, backup_path string, rollback_ts timestamp_ntz"


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def world(seed, n=60, paths=12):
    rng = random.Random(seed)
    texts = {f"/s{i}": f"text {i}" for i in range(paths)}
    state, applied, decisions = [], [], []
    for i in range(n):
        # one script per proposal but for approvals that compete on /s0
        path = f"/s{rng.randrange(paths)}" if rng.random() < 0.3 else f"/own{i}"
        texts.setdefault(path, f"text {path}")
        if rng.random() < 0.05:
            path = "/gone"
        stored = rng.choice([sha(texts.get(path, "")), sha(texts.get(path, "")), "other", "", None])
        status = rng.choice(["proposed", "proposed", "proposed", "applied", "rejected", "stale"])
        v2 = None if rng.random() < 0.1 else f"/v2/{i}"
        state.append((f"p{i}", f"t{i}", path, v2, stored, status, None, "green", "passed"))
        if status == "applied" and rng.random() < 0.8:
            applied.append((f"p{i}", T0, f"/b/{i}", T0 if rng.random() < 0.3 else None))
            if rng.random() < 0.9:
                texts[f"/b/{i}"] = f"backup {i}"
        if v2:
            texts[v2] = f"new {i}"
        for _ in range(rng.randrange(5)):
            decisions.append(
                (f"p{i}", rng.choice(["approve", "approve", "reject", "rollback", "x"]), "u",
                 T0 + dt.timedelta(minutes=rng.randrange(100000)), "n")
            )
    decisions.append(("nobody", "approve", "u", T0, None))
    return texts, state, applied, sorted(set(decisions), key=lambda d: (d[3], d[1], d[0]))


def one_by_one(texts, state, applied, decisions):
    """The decisions carried out in order of time, texts and notes included."""
    texts, saved, notes = dict(texts), {}, {s[0]: s[6] for s in state}
    found = {a[0]: a[2] for a in applied}
    rows = {s[0]: s for s in state}
    status = {s[0]: s[5] for s in state}
    undoable = {a[0]: a[3] is None and a[2] in texts for a in applied}
    changed = set()
    out = []
    for pid, action, _, at, note in decisions:
        result = "refused"
        if pid in rows:
            _, _, path, v2, stored, *_ = rows[pid]
            now = status[pid]
            if action == "approve" and now == "proposed" and v2 and path in texts:
                edited = stored and (stored != sha(texts[path]) or path in changed)
                result = "stale" if edited else "applied"
                status[pid] = result
                if result == "applied":
                    changed.add(path)
                    undoable[pid] = True
                    found[pid] = f"backups/{rows[pid][1]}_{pid}_{at:%Y%m%d_%H%M%S}"
                    texts[found[pid]] = saved[found[pid]] = texts[path]
                    texts[path] = texts[v2]
                    notes[pid] = note
                else:
                    notes[pid] = (notes[pid] or "") + "[STALE: notebook manually edited after proposal]"
            elif action == "reject" and now == "proposed":
                result = status[pid] = "rejected"
                notes[pid] = note
            elif action == "rollback" and now == "applied" and undoable.get(pid):
                result, status[pid] = "rolled_back", "rejected"
                changed.add(path)
                texts[path] = texts[found[pid]]
                notes[pid] = (notes[pid] or "") + "\n[ROLLBACK] "
        out.append(result)
    scripts = {rows[p][2]: texts[rows[p][2]] for p, r in zip([d[0] for d in decisions], out)
               if r in ("applied", "rolled_back")}
    return out, status, notes, scripts, saved


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_batch_equals_one_by_one(spark, seed):
    texts, state, applied, decisions = world(seed)
    want, final, notes, changed, saved = one_by_one(texts, state, applied, decisions)
    scripts = spark.createDataFrame(sorted(texts.items()), "path string, source string")
    state_df = spark.createDataFrame(state, STATE)
    got = ledger.apply_decisions(
        spark.createDataFrame(decisions, DECISIONS).repartition(4), state_df, scripts,
        spark.createDataFrame(applied, APPLIED),
    ).collect()
    result = {(r.proposal_id, r.action, r.decided_ts): r for r in got}
    assert len(got) == len(decisions)
    for d, w in zip(decisions, want):
        r = result[(d[0], d[1], d[3])]
        assert r.result == w, (d, r)
        assert (r.reason == "") == (w != "refused")

    # replaying all events gives the same final states
    first = state_df.select("proposal_id", F.lit(T0).cast("timestamp_ntz").alias("event_ts"),
                            F.lit(0).alias("seq"), "status", F.lit("a").alias("actor"), "notes")
    made = decide(spark.createDataFrame(decisions, DECISIONS), first, state_df, scripts,
                  spark.createDataFrame(applied, APPLIED))
    current = ledger.ledger_current(first.unionByName(made.events)).collect()
    assert {r.proposal_id: r.status for r in current} == final
    touched = {d[0] for d, w in zip(decisions, want) if w != "refused"}
    assert {r.proposal_id: r.notes for r in current if r.proposal_id in touched} == {
        p: notes[p] for p in touched
    }
    assert {r.path: r.source for r in made.scripts.collect()} == changed
    assert {r.path: r.source for r in made.backups.collect()} == saved
    assert made.applied.count() == sum(w == "applied" for w in want)
    assert {r.action for r in made.audit.select(F.lit("x").alias("action")).collect()} <= {"x"}


def test_events_of_stale_and_rolled_back_keep_old_notes(spark):
    outcome = spark.createDataFrame(
        [("p1", T0, "u", "n", "old. ", "stale"), ("p2", T0, "u", "n", None, "rolled_back"),
         ("p3", T0, "u", "n", "old", "applied"), ("p4", T0, "u", "n", "old", "refused")],
        "proposal_id string, decided_ts timestamp_ntz, actor string, notes string, "
        "old_notes string, result string",
    )
    got = {r.proposal_id: (r.status, r.notes) for r in ledger.decision_events(outcome).collect()}
    assert got == {
        "p1": ("stale", "old. [STALE: notebook manually edited after proposal]"),
        "p2": ("rejected", "\n[ROLLBACK] "), "p3": ("applied", "n"),
    }


def test_mark_reported_only_what_was_sent(spark):
    applied = spark.createDataFrame(
        [("p1", T0, None), ("p2", T0, T0), ("p3", T0, None)],
        "proposal_id string, applied_ts timestamp_ntz, first_reported_ts timestamp_ntz",
    )
    gains = spark.createDataFrame([("p1",), ("p2",)], "proposal_id string")
    got = ledger.mark_reported(applied, gains, "1998-07-01 00:00:00").collect()
    assert [r.proposal_id for r in got] == ["p1"]
    assert ledger.mark_reported(applied, gains, "1998-07-01 00:00:00", sent=False).count() == 0


def test_history_is_bounded_and_skips_bad_json(spark):
    rows = [
        (f"p{i}", 1, "t", T0 + dt.timedelta(days=i), "rejected",
         "{bad" if i == 8 else '{"changes_applied":[{"description":" d%d "},{"description":""}]}' % i)
        for i in range(10)
    ] + [("q", 1, "u", T0, "applied", "{}"), ("r", 1, "v", T0, "rejected", None)]
    df = spark.createDataFrame(
        rows, "proposal_id string, job_id int, task_key string, created_ts timestamp_ntz, "
        "status string, analysis string",
    )
    got = ledger.rejected_history(df).collect()
    assert [r.task_key for r in got] == ["t"]
    assert got[0].rejected_history.split("\n")[1:] == ["- d9", "- d7", "- d6", "- d5", ""]


def test_event_log_is_appended_by_month(spark):
    place = new_path(spark, "ledger")
    for day in (1, 40):
        rows = [("p", T0 + dt.timedelta(days=day), 0, "proposed", "a", None)]
        ledger_store.append(
            spark.createDataFrame(
                rows, "proposal_id string, event_ts timestamp_ntz, seq int, status string, "
                "actor string, notes string",
            ),
            place,
            "events",
        )
    back = ledger_store.read(spark, place, "events")
    assert back.count() == 2
    february = back.where("month = DATE '1998-02-01'")
    assert february.count() == 1
    plan = february._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(month" in plan


def test_clustered_copy_and_empty_copy(spark):
    df = spark.range(1000).selectExpr("id % 10 AS k", "id")
    path = new_path(spark, "clustered")
    ledger_store.write_clustered(df, path, ["k", "id"], files=4)
    assert spark.read.parquet(path).count() == 1000
    empty = ledger_store.empty_copy(df)
    assert empty.schema == df.schema and empty.count() == 0
