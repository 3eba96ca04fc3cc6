"""Carrying out a batch of decisions: one evaluation, all its outputs."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from pipewise.operators import ledger, reporting
from pipewise.sources.scratch import materialize


@dataclass(frozen=True)
class Decided:
    """What a batch of decisions leads to. ``backups`` are written before ``scripts``."""

    outcome: DataFrame
    events: DataFrame
    applied: DataFrame
    rollbacks: DataFrame
    scripts: DataFrame
    backups: DataFrame
    audit: DataFrame


def decide(decisions: DataFrame, events: DataFrame, proposals: DataFrame, scripts: DataFrame,
           applied: DataFrame) -> Decided:
    """Judge the decisions against the ledger and derive every output from the
    one written result. Eager: the outcome is written once and read by all."""
    current = ledger.ledger_current(events).select("proposal_id", "status", "notes")
    state = proposals.drop("status", "notes").join(current, "proposal_id")
    outcome = materialize(
        ledger.apply_decisions(decisions, state, scripts, applied), "decisions"
    )
    return Decided(
        outcome=outcome,
        events=ledger.decision_events(outcome),
        applied=ledger.applied_rows(outcome),
        rollbacks=ledger.rollback_rows(outcome),
        scripts=ledger.script_updates(outcome, scripts),
        backups=ledger.script_backups(outcome, scripts),
        audit=reporting.result_lines(outcome),
    )
