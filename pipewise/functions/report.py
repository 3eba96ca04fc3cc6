"""Report text, one expression per line or block."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pipewise.functions.fixed_values import (
    ACTION_MARKS,
    BROADCAST_LIMIT_MB,
    BULLET_CHARS,
    CARD_CHANGES,
    ERROR_CHARS,
    SAVINGS_MARKS,
    TIER_MARKS,
    UNKNOWN_MARK,
    VALIDATION_MARKS,
)
from pipewise.functions.text import lookup, places


def size_line(name: Column, size_mb: Column, safe: Column, derived_from: Column,
              limit_mb: int = BROADCAST_LIMIT_MB) -> Column:
    """One input with its size and whether it may be broadcast."""
    tag = (
        F.when(safe, "✓ broadcast OK")
        .when(size_mb < 0, "✗ NO broadcast (large source — size not estimable)")
        .otherwise(
            F.concat(F.lit("✗ NO broadcast ("), places(size_mb, 0), F.lit(" MB > threshold)"))
        )
    )
    origin = F.coalesce(
        F.concat(F.lit("  [derived from: "), derived_from, F.lit("]")), F.lit("")
    )
    return F.concat(
        F.lit("  "), name, F.lit(": "), places(size_mb, 1), F.lit(" MB  — "), tag, origin
    )


def size_heading(limit_mb: int = BROADCAST_LIMIT_MB) -> str:
    return f"TABLE SIZES ON DISK (broadcast threshold: {limit_mb} MB):"


def change_bullet(description: Column, savings: Column) -> Column:
    short = F.when(
        F.length(description) > BULLET_CHARS,
        F.concat(F.substring(description, 1, BULLET_CHARS - 3), F.lit("…")),
    ).otherwise(description)
    mark = lookup(SAVINGS_MARKS, savings, "")
    return F.rtrim(F.concat(F.lit("• "), short, F.lit("  "), mark))


def validation_line(tier: Column, status: Column, run_id: Column | None = None,
                    missing: Column | None = None, added: Column | None = None,
                    changed: Column | None = None, url: str = "") -> Column:
    """One line on how far the checks came.

    ``missing``, ``added`` and ``changed`` are arrays of column names of the
    first table whose schema differs.
    """
    smoke = F.lit("smoke")
    if run_id is not None and url:
        smoke = F.when(
            run_id.isNotNull(),
            F.concat(F.lit(f"<{url}/jobs/runs/"), run_id.cast("string"), F.lit("|smoke>")),
        ).otherwise(smoke)
    detail = F.lit("")
    if missing is not None and added is not None and changed is not None:
        cols = F.concat(missing, added)
        more = F.when(
            F.size(cols) > 1,
            F.concat(F.lit(" +"), (F.size(cols) - 1).cast("string"), F.lit(" more")),
        ).otherwise("")
        detail = F.coalesce(
            F.when(
                F.size(cols) > 0,
                F.concat(F.lit(" — `"), F.get(cols, F.lit(0)), F.lit("`"), more),
            ).when(
                F.size(changed) > 0,
                F.concat(F.lit(" — type `"), F.get(changed, F.lit(0)), F.lit("` changed")),
            ),
            F.lit(""),
        )
    ok = F.concat(F.lit("✅ "), smoke)
    bad = F.concat(F.lit("❌ "), smoke)
    yellow = (
        F.when(status == "smoke_passed", ok)
        .when(status == "smoke_failed", bad)
        .otherwise("⏭ skipped")
    )
    other = (
        F.when(status == "smoke_failed", bad)
        .when(status == "schema_mismatch", F.concat(ok, F.lit("  ❌ schema"), detail))
        .when(status == "data_mismatch", F.concat(ok, F.lit("  ✅ schema  ❌ data")))
        .when(status == "passed", F.concat(ok, F.lit("  ✅ schema  ✅ data")))
        .otherwise(F.concat(ok, F.lit("  ✅ schema")))
    )
    body = (
        F.when(status == "skipped", "⏭ skipped")
        .when(status == "failed", "❌ error")
        .when(tier == "yellow", yellow)
        .otherwise(other)
    )
    return F.concat(F.lit("Validation: "), body)


def gain_line(task: Column, status: Column, original_min: Column, current_min: Column,
              pct: Column, user: Column) -> Column:
    key = F.concat(F.lit("`"), task, F.lit("`"))
    span = F.concat(
        key, F.lit(": *"), places(original_min, 1), F.lit(" min* → *"),
        places(current_min, 1), F.lit(" min* "),
    )
    size = places(F.abs(pct), 0)
    by = F.concat(F.lit("  approved by "), user)
    return (
        F.when(
            status == "no_ran",
            F.concat(F.lit("⏭️  "), key,
                     F.lit(" — did not run in this execution _(approved by "), user, F.lit(")_")),
        )
        .when(status == "improved",
              F.concat(F.lit("✅  "), span, F.lit("_(−"), size, F.lit("%)_"), by))
        .when(status == "regressed",
              F.concat(F.lit("🔴  "), span, F.lit("_(+"), size,
                       F.lit("% — please review)_"), by))
        .otherwise(F.concat(F.lit("➡️  "), span, F.lit("_(no significant change)_"), by))
    )


def card_heading(number: Column, task: Column, tier: Column, status: Column,
                 minutes: Column, weight: Column) -> Column:
    heavier = F.when(
        F.coalesce(weight, F.lit(1.0)) != 1.0,
        F.concat(F.lit("  ·  *"), places(weight, 1), F.lit("×*")),
    ).otherwise("")
    return F.concat(
        F.lit("*"), number.cast("string"), F.lit(". `"), task, F.lit("`*  "),
        lookup(TIER_MARKS, tier, UNKNOWN_MARK), F.lit(" "),
        lookup(VALIDATION_MARKS, status, UNKNOWN_MARK),
        F.lit("\n*"), places(minutes, 1), F.lit(" min*"), heavier,
    )


def card_body(status: Column, error: Column, changes: Column) -> Column:
    """No change, an error, or the first few changes; NULL if nothing to say."""
    bullets = F.transform(
        F.slice(changes, 1, CARD_CHANGES),
        lambda c: change_bullet(c["description"], c["savings"]),
    )
    return (
        F.when(status == "no_changes",
               "💤 _No changes — LLM found no worthwhile optimizations._")
        .when(
            status.isin("llm_error", "export_error"),
            F.concat(
                F.lit("_"), lookup(VALIDATION_MARKS, status, UNKNOWN_MARK), F.lit(" Error: "),
                F.substring(F.coalesce(error, F.lit("see the proposals table")), 1, ERROR_CHARS),
                F.lit("_"),
            ),
        )
        .when(F.size(changes) > 0,
              F.concat(F.lit("*Proposed changes:*\n"), F.array_join(bullets, "\n")))
    )


def card_footer(validation: Column, v2_path: Column, proposal_id: Column) -> Column:
    return F.concat_ws(
        "\n",
        validation,
        F.concat(F.lit("v2: `"), v2_path, F.lit("`")),
        F.when(
            v2_path.isNotNull(),
            F.concat(F.lit("Approve with proposal_id `"), proposal_id, F.lit("`")),
        ),
    )


def run_label(run_ids: Column) -> Column:
    """No run, one run, or the first two."""
    def tick(i: int) -> Column:
        return F.concat(F.lit("`"), F.get(run_ids, F.lit(i)).cast("string"), F.lit("`"))

    n = F.size(F.coalesce(run_ids, F.array().cast("array<bigint>")))
    return (
        F.when(n == 0, "No runs recorded")
        .when(n > 1, F.concat(F.lit("Runs "), tick(0), F.lit(" + "), tick(1), F.lit(" (avg 2)")))
        .otherwise(F.concat(F.lit("Run "), tick(0)))
    )


def rank_label(weighted: Column) -> Column:
    return F.when(weighted, "by cost score").otherwise("slowest")


def ranking_line(rank: Column, task: Column, duration_s: Column, weight: Column,
                 score: Column, weighted: Column) -> Column:
    """One line of the ranking, with the weight only where weights are in play."""
    base = F.concat(
        F.lit("  "), rank.cast("string"), F.lit(". "),
        F.when(F.length(task) < 50, F.rpad(task, 50, " ")).otherwise(task), F.lit(" "),
        F.format_string("%6.1f", F.round(duration_s / 60.0, 1)), F.lit(" min"),
    )
    cost = F.concat(
        F.lit("  ×"), places(weight, 1), F.lit("  →  "), places(score / 60.0, 1), F.lit(" score")
    )
    return F.when(weighted, F.concat(base, cost)).otherwise(base)


def result_line(action: Column, task: Column, proposal_id: Column, notes: Column) -> Column:
    note = F.when(
        F.coalesce(notes, F.lit("")) != "", F.concat(F.lit("\n_"), notes, F.lit("_"))
    ).otherwise("")
    return F.concat(
        lookup(ACTION_MARKS, action, UNKNOWN_MARK), F.lit(" *"), F.initcap(action),
        F.lit("* — `"), task, F.lit("`\nproposal `"), F.substring(proposal_id, 1, 8),
        F.lit("`"), note,
    )
