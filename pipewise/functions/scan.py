"""What a script writes, reads and touches outside, as column expressions.

Each pattern runs only on rows whose folded text holds the word the pattern
cannot match without; the word test is a byte search, so scripts that do not
use a construct cost next to nothing for it.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from pipewise.functions.fixed_values import (
    SIDE_EFFECTS,
)
from pipewise.functions.text import let, thousands

_NO_NAMES = "array<string>"


def names_found(
    code: Column, folded: Column, patterns: list[tuple[str, str]]
) -> Column:
    """All first-group matches of all patterns, in pattern order, repeats kept."""
    found = [
        F.when(
            folded.contains(word),
            F.regexp_extract_all(code, F.lit(f"(?iu){pattern}"), F.lit(1)),
        ).otherwise(F.array().cast(_NO_NAMES))
        for word, pattern in patterns
    ]
    return F.concat(*found) if len(found) > 1 else found[0]


def sorted_names(names: Column, lower: bool = False) -> Column:
    if lower:
        names = F.transform(names, F.lower)
    return F.array_sort(F.array_distinct(names))


def dotted(names: Column) -> Column:
    """Only names with a dot are tables."""
    return F.filter(names, lambda n: n.contains("."))


def side_effects(source: Column, folded: Column) -> Column:
    """Labels of the outside effects, in reporting order, comments included."""
    hits = []
    for label, words, pattern in SIDE_EFFECTS:
        present = folded.contains(words[0])
        for word in words[1:]:
            present = present | folded.contains(word)
        hits.append(
            F.when(present & source.rlike(f"(?iu){pattern}"), F.lit(label))
        )
    return F.filter(F.array(*hits), lambda label: label.isNotNull())


def self_reference(targets: Column, reads: Column) -> Column:
    """Targets that the script also reads (``reads`` is lower case)."""
    return let(
        reads, lambda r: F.filter(targets, lambda t: F.array_contains(r, F.lower(t)))
    )


def _too_large(n_chars: Column, cap: int | None) -> Column:
    return F.lit(False) if cap is None else n_chars > cap


def tier(n_chars: Column, effects: Column, targets: Column, own: Column,
         cap: int | None = None) -> Column:
    """``cap``: characters above which a script is never green; none by default."""
    safe = (
        ~_too_large(n_chars, cap)
        & (F.size(effects) == 0)
        & (F.size(targets) > 0)
        & (F.size(own) == 0)
    )
    return F.when(safe, "green").otherwise("yellow")


def tier_reason(n_chars: Column, effects: Column, targets: Column, own: Column,
                cap: int | None = None) -> Column:
    """Why a script has its tier; the first rule that holds speaks."""
    return (
        F.when(
            _too_large(n_chars, cap),
            F.concat(
                F.lit("notebook too large ("), thousands(n_chars),
                F.lit(" chars > "), thousands(F.lit(cap or 0)),
                F.lit("). Generates proposal without automatic validation."),
            ),
        )
        .when(
            F.size(effects) > 0,
            F.concat(
                F.lit("has side effects: "), F.array_join(effects, ", "),
                F.lit(". Generates proposal but does NOT validate automatically."),
            ),
        )
        .when(
            F.size(targets) == 0,
            F.lit("no output tables detected. "
                  "Generates proposal without automatic validation."),
        )
        .when(
            F.size(own) > 0,
            F.concat(
                F.lit("self-reference detected: notebook reads AND writes "),
                F.array_join(own, ", "),
                F.lit(". Automatic validation cannot run correctly on this pattern."),
            ),
        )
        .otherwise(
            F.concat(
                F.lit("Automatically validatable over "),
                F.size(targets).cast("string"),
                F.lit(" Delta table(s)."),
            )
        )
    )


def scratch_name(table: Column, suffix: str | Column, schema: str) -> Column:
    """Scratch table for a target: everything after the first dot, suffixed."""
    rest = F.regexp_replace(table, r"^[^.]*\.?", "")
    end = F.lit(suffix) if isinstance(suffix, str) else suffix
    return F.concat(F.lit(f"{schema}."), rest, F.lit("_test_"), end)


def suffix_targets(source: Column, targets: Column, suffix: str | Column,
                   schema: str = "scratch") -> Column:
    """Point a script at scratch copies of its targets, target by target.

    A suffix may be a column of plain words, one per script. Quoted names go first, so that a name ending in a dot is still caught;
    what is left is replaced as a whole word.
    """
    if isinstance(suffix, str) and not re.fullmatch(r"\w+", suffix) or not re.fullmatch(r"\w+", schema):
        raise ValueError("suffix and schema must be plain words")

    def rename(text: Column, table: Column) -> Column:
        new = scratch_name(table, suffix, schema)
        for quote in ("'", '"'):
            q = F.lit(quote)
            text = F.replace(text, F.concat(q, table, q), F.concat(q, new, q))
        whole_word = F.concat(F.lit(r"(?U)\b\Q"), table, F.lit(r"\E\b"))
        return F.regexp_replace(text, whole_word, new)

    return F.aggregate(targets, source, rename)


def rewrite_check(tier_col: Column, effects: Column, mode: str = "on") -> Column:
    """Which check a rewrite gets: ``full``, ``smoke`` or ``skip``."""
    if mode not in ("on", "auto", "off", "smoke"):
        raise ValueError(f"unknown mode {mode!r}")
    full = F.lit(mode in ("on", "auto")) & (tier_col == "green")
    smoke = F.lit(mode != "off") & (tier_col == "yellow") & (F.size(effects) == 0)
    return F.when(full, "full").when(smoke, "smoke").otherwise("skip")
