"""Cell-level changes: matching them to cells and rebuilding scripts.

scripts    script_id, path, source
responses  response_id, script_id, raw
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pipewise.functions import cells, responses
from pipewise.functions.fixed_values import (
    NO_SIZE_CONTEXT_TEXT,
    NO_TARGETS_TEXT,
)
from pipewise.functions.text import normalize, places

TEMPLATE = (
    "SCRIPT: {script_path}\n"
    "MINUTES IN THE LATEST RUNS: {minutes}\n"
    "OUTPUT TABLES: {target_tables}\n"
    "{table_sizes}\n"
    "CELLS:\n{cell_index}\n"
    "{rejected_history}\n"
    "SOURCE:\n{source}\n"
)


def script_cells(scripts: DataFrame) -> DataFrame:
    """One row per cell, numbered from 0, with the name it goes by."""
    return scripts.select(
        "script_id", F.posexplode(cells.split_cells(F.col("source"))).alias("cell_pos", "cell")
    ).withColumn("cell_name", cells.cell_name(F.col("cell")))


def cell_index(scripts: DataFrame) -> DataFrame:
    return scripts.select("script_id", cells.cell_index(F.col("source")).alias("cell_index"))


def truncate_scripts(scripts: DataFrame, max_chars: int) -> DataFrame:
    return scripts.select(
        "script_id", cells.truncate(F.col("source"), max_chars).alias("source")
    )


def parse_responses(raw_responses: DataFrame) -> DataFrame:
    """Parsed document of each response (NULL if none) and how it was found.

    ``method`` is 1 to 4, or 0 where nothing parses; a document that is no
    object is an error too. Of repeated keys the last counts; NaN and the
    infinities are read as strings.
    """
    with responses.repeated_keys(raw_responses.sparkSession):
        parsed = raw_responses.withColumn("_p", responses.parsed_response(F.col("raw")))
    return parsed.select(
        *raw_responses.columns,
        F.coalesce(F.col("_p.method"), F.lit(0)).alias("method"),
        F.coalesce(F.col("_p.is_object"), F.lit(False)).alias("parsed"),
        F.when(F.col("_p.is_object"), F.col("_p.doc")).alias("doc"),
    )


def choose_rewrite(parsed: DataFrame) -> DataFrame:
    """Cell changes if there are any, else a whole script, else nothing."""
    return (
        parsed.withColumn("changes", responses.changes_of(F.col("doc")))
        .withColumn("whole_script", responses.whole_script_of(F.col("doc")))
        .withColumn("analysis", responses.analysis_of(F.col("doc")))
        .withColumn("kind", responses.rewrite_kind(F.col("changes"), F.col("whole_script")))
    )


def _with_script(chosen: DataFrame, scripts: DataFrame) -> DataFrame:
    """Each response next to the cells of its script.

    Equi join on the script; everything after it stays inside the row. Where
    one script has very many responses, adaptive execution splits them.
    """
    return (
        chosen.join(scripts.select("script_id", "source"), "script_id")
        # only for responses with changes; the others leave the text alone
        .withColumn(
            "_cells", F.when(F.size("changes") > 0, cells.split_cells(F.col("source")))
        )
        .withColumn("_norm", F.transform("_cells", normalize))
        .withColumn("_matched", cells.matched_changes(F.col("_norm"), F.col("changes")))
    )


def match_changes(chosen: DataFrame, scripts: DataFrame) -> DataFrame:
    """One row per usable change: the cell it meets and at which level."""
    # Outer, because for a plain explode Spark infers a filter on the array,
    # and would match all changes twice, once for the filter.
    return (
        _with_script(chosen, scripts)
        .select("response_id", "script_id", F.explode_outer("_matched").alias("m"))
        .select("response_id", "script_id", "m.*")
        .where(F.col("change_pos").isNotNull())
    )


def unmatched_changes(chosen: DataFrame, scripts: DataFrame) -> DataFrame:
    """Changes whose cell was not found."""
    return match_changes(chosen, scripts).where(F.col("cell_pos").isNull()).select(
        "response_id", "script_id", "change_pos", "cell_id"
    )


def rebuild_scripts(chosen: DataFrame, scripts: DataFrame) -> DataFrame:
    """The new text of the script each response is about, empty if it has none."""
    rewrite = (
        F.when(F.col("kind") == "changes", cells.rebuild(F.col("_cells"), F.col("_matched")))
        .when(F.col("kind") == "whole_script", F.col("whole_script"))
        .otherwise("")
    )
    return (
        _with_script(chosen, scripts)
        .withColumn("rewrite", rewrite)
        .select(
            "response_id", "script_id", "kind", "analysis", "rewrite",
            cells.is_no_change(F.col("source"), F.col("rewrite")).alias("no_change"),
        )
    )


def prompt_rows(scripts: DataFrame, template: str = TEMPLATE,
                max_chars: int | None = None) -> DataFrame:
    """The template filled for each script; the script's text goes in last, whole
    unless the caller names a limit.

    ``scripts`` has script_id, path, source, duration_s, target_tables,
    size_context and rejected_history.
    """
    targets = F.array_join("target_tables", ", ")
    filled = F.lit(template)
    for slot, value in [
        ("script_path", F.col("path")),
        ("minutes", places(F.col("duration_s") / 60.0, 1)),
        ("target_tables", F.when(targets != "", targets).otherwise(NO_TARGETS_TEXT)),
        (
            "table_sizes",
            F.when(F.col("size_context") != "", F.col("size_context")).otherwise(
                NO_SIZE_CONTEXT_TEXT
            ),
        ),
        ("cell_index", cells.cell_index(F.col("source"))),
        ("rejected_history", F.coalesce("rejected_history", F.lit(""))),
        (
            "source",
            F.col("source") if max_chars is None else cells.truncate(F.col("source"), max_chars),
        ),
    ]:
        filled = F.replace(filled, F.lit("{" + slot + "}"), value)
    return scripts.select("script_id", filled.alias("prompt"))
