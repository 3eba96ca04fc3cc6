"""Text helpers shared by the script, cell and report expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from pipewise.functions.fixed_values import LINE_END, WHITESPACE

_BLANKS = r"[\s\x1c-\x1f]"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value worked out once, however often it is used.

    Also for a value used inside a lambda over an array: an expression there is
    worked out again for every element, and Catalyst moves a column that is
    used only there into the lambda.
    """
    return F.get(F.transform(F.array(value), use), F.lit(0))


def trim_all(text: Column) -> Column:
    """Trim every kind of white space, not only the plain space."""
    return F.btrim(text, F.lit(WHITESPACE))


def is_blank(text: Column) -> Column:
    """True for NULL, empty and all-blank text."""
    return F.coalesce(trim_all(text), F.lit("")) == ""


def normalize(text: Column) -> Column:
    """Collapse white space, trim, lower."""
    return F.lower(trim_all(F.regexp_replace(text, f"[{WHITESPACE}]+", " ")))


def fold(text: Column) -> Column:
    """Lower-case text for the cheap "does this word occur" tests.

    The letters a Unicode ignore-case match takes for s and i become those, so
    a test on the folded text never misses what the pattern itself would find.
    """
    folded = F.lower(text)
    for letter, plain in (("\u017f", "s"), ("\u0131", "i"), ("i\u0307", "i")):
        folded = F.replace(folded, F.lit(letter), F.lit(plain))
    return folded


def _drop_lines(source: Column, pattern: str) -> Column:
    lines = F.split(source, LINE_END)
    return F.array_join(F.filter(lines, lambda line: ~line.rlike(pattern)), "\n")


def strip_comments(source: Column) -> Column:
    """Drop lines whose first visible characters are ``#`` or ``--``."""
    return _drop_lines(source, rf"(?U)^{_BLANKS}*(?:#|--)")


def strip_comments_and_imports(source: Column) -> Column:
    """Drop comment lines and Python import lines."""
    return _drop_lines(
        source, rf"(?U)^{_BLANKS}*(?:#|--|from\s+\S+\s+import|import\s+)"
    )


def places(value: Column, digits: int) -> Column:
    """Fixed-point text, half up, no thousands separator."""
    return F.format_string(f"%.{digits}f", F.round(value, digits))


def thousands(value: Column) -> Column:
    """Whole number with ``,`` between thousands."""
    return F.format_number(value, 0)


def lookup(marks: dict[str, str], key: Column, default: str) -> Column:
    """Value of a small constant mapping, or a default."""
    pairs = [F.lit(x) for pair in marks.items() for x in pair]
    return F.coalesce(F.element_at(F.create_map(*pairs), key), F.lit(default))
