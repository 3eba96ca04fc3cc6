"""Scanning a whole corpus of scripts: one pass, no shuffle.

scripts   script_id, path, source (other columns pass through)
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pipewise.functions import scan, text
from pipewise.functions.fixed_values import (
    READ_PATH_PATTERNS,
    READ_PATTERNS,
    STRICT_READ_PATTERNS,
    TARGET_PATTERNS,
)

_WORDS = {w for w, _ in TARGET_PATTERNS + STRICT_READ_PATTERNS}
_SIZING_WORDS = {w for w, _ in READ_PATTERNS + READ_PATH_PATTERNS}


def _any_word(words: set[str]):
    present = F.lit(False)
    for word in sorted(words):
        present = present | F.col("_folded").contains(word)
    return present


def _prepared(scripts: DataFrame, strip, words: set[str]) -> DataFrame:
    """Folded text, and the code without comments where any pattern could hit.

    Both are used many times over, so Catalyst keeps them as columns of their
    own and works each out once per script.
    """
    return scripts.withColumn("_folded", text.fold(F.col("source"))).withColumn(
        "_code", F.when(_any_word(words), strip(F.col("source"))).otherwise(F.lit(""))
    )


def scan_scripts(scripts: DataFrame, cap: int | None = None,
                 extra_targets: list[tuple[str, str]] | None = None) -> DataFrame:
    """Targets, reads, side effects, tier and reason of every script.

    ``extra_targets`` adds (word, pattern) pairs to the target patterns.
    """
    code, folded = F.col("_code"), F.col("_folded")
    targets = TARGET_PATTERNS + (extra_targets or [])
    words = _WORDS | {w for w, _ in targets}
    found = _prepared(scripts, text.strip_comments, words).select(
        *scripts.columns,
        scan.sorted_names(scan.dotted(scan.names_found(code, folded, targets)))
        .alias("target_tables"),
        scan.sorted_names(
            scan.dotted(scan.names_found(code, folded, STRICT_READ_PATTERNS)), lower=True
        ).alias("read_tables"),
        scan.side_effects(F.col("source"), folded).alias("side_effects"),
        F.length("source").alias("n_chars"),
    )
    found = found.withColumn(
        "self_reference", scan.self_reference(F.col("target_tables"), F.col("read_tables"))
    )
    parts = [F.col(c) for c in ("n_chars", "side_effects", "target_tables", "self_reference")]
    return found.withColumn("tier", scan.tier(*parts, cap=cap)).withColumn(
        "reason", scan.tier_reason(*parts, cap=cap)
    )


def read_inputs(scripts: DataFrame) -> DataFrame:
    """Tables and parquet paths every script reads, for sizing."""
    code, folded = F.col("_code"), F.col("_folded")
    return _prepared(scripts, text.strip_comments_and_imports, _SIZING_WORDS).select(
        *scripts.columns,
        scan.sorted_names(
            scan.dotted(scan.names_found(code, folded, READ_PATTERNS)), lower=True
        ).alias("read_tables"),
        scan.sorted_names(scan.names_found(code, folded, READ_PATH_PATTERNS)).alias("read_paths"),
    )


def with_hash(scripts: DataFrame) -> DataFrame:
    """SHA-256 of every script's text, for telling later edits."""
    return scripts.withColumn("source_hash", F.sha2("source", 256))
