"""Importing this module registers every query."""

from checks import corpus_queries, ledger_queries, run_queries, size_queries  # noqa: F401
