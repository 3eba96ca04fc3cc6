"""Scripts as arrays of cells.

A script is one string, so everything about its cells is worked out inside its
own row, on the array of cells: no explode, no shuffle of script text.
Positions count from 0.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pipewise.functions.fixed_values import (
    CELL_MARKER,
    CELL_TITLE,
    LINE_END,
    PREVIEW_CHARS,
    WORD_OVERLAP,
)
from pipewise.functions.text import is_blank, let, normalize, thousands, trim_all

# Unix line mode: a title ends at the line feed only.
_TITLE = f"(?dU){CELL_TITLE}"

CHANGES = "array<struct<cell_id:string,new_code:string>>"


def split_cells(source: Column) -> Column:
    return F.split(source, rf"\Q{CELL_MARKER}\E")


def join_cells(cells: Column) -> Column:
    return F.array_join(cells, CELL_MARKER)


def _title(cell: Column) -> Column:
    """The text after the title marker, or empty without one."""
    return F.regexp_extract(cell, _TITLE, 1)


def cell_name(cell: Column) -> Column:
    """Title line, or else a preview of the first line of code."""
    lines = F.transform(F.split(cell, LINE_END), trim_all)
    code = F.filter(lines, lambda x: (x != "") & ~x.startswith("#"))
    preview = F.substring(F.coalesce(F.get(code, F.lit(0)), F.lit("")), 1, PREVIEW_CHARS)
    unnamed = let(
        preview,
        lambda p: F.when(
            p != "", F.concat(F.lit("(unnamed — preview: "), p, F.lit(")"))
        ).otherwise("(empty cell)"),
    )
    return let(
        _title(cell),
        lambda title: F.when(
            title != "", F.concat(F.lit("# DBTITLE 1,"), trim_all(title))
        ).otherwise(unnamed),
    )


def cell_index(source: Column) -> Column:
    """One ``idx_i: name`` line per cell."""
    lines = F.transform(
        split_cells(source),
        lambda cell, i: F.concat(
            F.lit("  idx_"), i.cast("string"), F.lit(": "), cell_name(cell)
        ),
    )
    return F.array_join(lines, "\n")


def _skeleton(cell: Column) -> Column:
    name = let(
        _title(cell),
        lambda title: F.when(title != "", trim_all(title)).otherwise("(unnamed)"),
    )
    return F.concat(
        F.lit("\n# DBTITLE 1,"), name, F.lit("\n# [cell omitted by smart truncation]\n")
    )


def truncate(source: Column, max_chars: int) -> Column:
    """Keep the last cells whole as far as they fit, the others as skeletons.

    Text that fits is left alone. The skeletons of all cells, and a marker for
    each, are set aside first; whole cells are then taken from the end until
    one does not fit.
    """
    def shorten(cells: Column) -> Column:
        reserved = F.aggregate(
            F.transform(cells, _skeleton),
            F.lit(0),
            lambda total, s: total + F.length(s) + len(CELL_MARKER),
        )
        start = F.struct(
            (F.lit(max_chars) - reserved).alias("left"),
            F.lit(0).alias("kept"),
            F.lit(False).alias("closed"),
        )
        kept = F.aggregate(F.reverse(cells), start, take, lambda state: state["kept"])
        return let(kept, lambda n_kept: render(cells, F.size(cells) - n_kept, n_kept))

    def take(state: Column, cell: Column) -> Column:
        fits = ~state["closed"] & (state["left"] >= F.length(cell))
        return F.struct(
            F.when(fits, state["left"] - F.length(cell))
            .otherwise(state["left"])
            .alias("left"),
            (state["kept"] + fits.cast("int")).alias("kept"),
            (~fits).alias("closed"),
        )

    def render(cells: Column, n_cut: Column, n_kept: Column) -> Column:
        parts = F.transform(
            cells, lambda cell, i: F.when(i >= n_cut, cell).otherwise(_skeleton(cell))
        )
        return F.concat(
            join_cells(parts),
            F.lit("\n# [SMART TRUNCATION: "), n_kept.cast("string"), F.lit("/"),
            F.size(cells).cast("string"), F.lit(" cells full (last ones), "),
            n_cut.cast("string"), F.lit(" summarized. Total original: "),
            thousands(F.length(source)), F.lit(" chars]"),
        )

    return F.when(F.length(source) <= max_chars, source).otherwise(
        let(split_cells(source), shorten)
    )


def match_cell(norm_cells: Column, cell_id: Column) -> Column:
    """``struct(level, pos)`` of the cell an id means; NULL if none.

    Level 0: the id starts with ``idx_N`` and N exists. Level 1: the normalized
    id occurs in a normalized cell. Level 2: at least 60 % of the id's distinct
    words occur in a cell. Within a level the first cell wins.
    """

    def found(level: int, pos: Column) -> Column:
        return F.struct(F.lit(level).alias("level"), pos.cast("int").alias("pos"))

    def first(test) -> Column:
        return F.array_position(F.transform(norm_cells, test), True)

    def by_words(words: Column) -> Column:
        needed = F.lit(WORD_OVERLAP) * F.size(words)
        hit = first(
            lambda cell: F.size(F.filter(words, lambda w: cell.contains(w))) >= needed
        )
        return let(hit, lambda at: F.when(at > 0, found(2, at - 1)))

    def by_text(norm_id: Column) -> Column:
        words = F.array_distinct(F.split(norm_id, " "))
        return let(
            first(lambda cell: cell.contains(norm_id)),
            lambda at: F.when(at > 0, found(1, at - 1)).otherwise(let(words, by_words)),
        )

    number = F.regexp_extract(trim_all(cell_id), r"(?i)^idx_(\d+)", 1).try_cast("bigint")
    return let(
        number,
        lambda n: F.when(n < F.size(norm_cells), found(0, n)).otherwise(
            let(normalize(cell_id), by_text)
        ),
    )


def matched_changes(norm_cells: Column, changes: Column) -> Column:
    """Changes with the level and cell each one meets, in their order.

    ``changes`` is ``array<struct<cell_id, new_code>>``. Changes with a blank
    id or blank code are left out. Matching is always against the cells as
    they were, normalized.
    """
    numbered = F.transform(
        F.coalesce(changes, F.array().cast(CHANGES)),
        lambda c, i: F.struct(i.cast("int").alias("i"), c.alias("c")),
    )
    usable = F.filter(
        numbered, lambda x: ~is_blank(x["c"]["cell_id"]) & ~is_blank(x["c"]["new_code"])
    )

    def placed(norm: Column, x: Column) -> Column:
        return let(
            match_cell(norm, x["c"]["cell_id"]),
            lambda hit: F.struct(
                x["i"].alias("change_pos"),
                x["c"]["cell_id"].alias("cell_id"),
                x["c"]["new_code"].alias("new_code"),
                hit["level"].alias("match_level"),
                hit["pos"].alias("cell_pos"),
            ),
        )

    return let(norm_cells, lambda norm: F.transform(usable, lambda x: placed(norm, x)))


def rebuild(cells: Column, matched: Column) -> Column:
    """Put the changes into the cells; the last change to a cell wins."""

    def renewed(changes: Column) -> Column:
        def final(cell: Column, i: Column) -> Column:
            mine = F.filter(changes, lambda c: c["cell_pos"] == i)
            code = trim_all(F.try_element_at(mine, F.lit(-1))["new_code"])
            return F.coalesce(F.concat(F.lit("\n\n"), code, F.lit("\n\n")), cell)

        return join_cells(F.transform(cells, final))

    return let(matched, renewed)


def is_no_change(source: Column, rewrite: Column) -> Column:
    """A rewrite that is blank, or equal to the original but for outer blanks."""
    return is_blank(rewrite) | (trim_all(rewrite) == trim_all(source))
