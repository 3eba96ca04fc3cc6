"""How large the inputs of each script are, and which may be broadcast.

table sizes   name (lower case, dotted), size_bytes (-1: unknown)
path sizes    path, size_bytes (-1: unknown or too many files)
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pipewise.functions import cost, report
from pipewise.functions.fixed_values import BROADCAST_LIMIT_MB, NO_SIZES_TEXT
from pipewise.functions.text import let
from pipewise.operators.corpus import read_inputs
from pipewise.operators.lineage import closure_in_scripts, lineage_edges, lookup_names
from pipewise.sources.scratch import materialize

COLUMNS = [
    "script_id", "name", "size_bytes", "size_mb", "broadcast_safe", "source_type", "derived_from",
]


def basename(path: Column) -> Column:
    return F.element_at(F.split(F.regexp_replace(path, "/+$", ""), "/"), -1)


def _reference() -> Column:
    """The table or path behind a size record's name."""
    path = F.regexp_extract("name", r"^[^(]* \((.*)\)$", 1)
    return F.when((F.col("source_type") == "parquet") & (path != ""), path).otherwise(F.col("name"))


def direct_sizes(scripts: DataFrame, table_sizes: DataFrame, path_sizes: DataFrame,
                 limit_mb: float = BROADCAST_LIMIT_MB) -> DataFrame:
    """Tables and parquet paths each script reads, where their size is known.

    One pass over the scripts and one join, on the kind of input and its name.
    """
    inputs = read_inputs(scripts.select("script_id", "source"))

    def reads(column: str, kind: str) -> Column:
        return F.transform(
            column, lambda name: F.struct(F.lit(kind).alias("source_type"), name.alias("ref"))
        )

    wanted = inputs.select(
        "script_id",
        F.explode_outer(
            F.concat(reads("read_tables", "delta"), reads("read_paths", "parquet"))
        ).alias("r"),
    ).select("script_id", "r.*")
    tables = table_sizes.select(F.lit("delta").alias("source_type"), F.col("name").alias("ref"), "size_bytes")
    paths = path_sizes.select(F.lit("parquet").alias("source_type"), F.col("path").alias("ref"), "size_bytes")
    known = tables.unionByName(paths).where(F.col("size_bytes") >= 0)
    name = F.when(
        F.col("source_type") == "parquet",
        F.concat(basename(F.col("ref")), F.lit(" ("), F.col("ref"), F.lit(")")),
    ).otherwise(F.col("ref"))
    return wanted.join(known, ["source_type", "ref"]).select(
        "script_id",
        name.alias("name"),
        "size_bytes",
        F.round(cost.size_mb(F.col("size_bytes")), 1).alias("size_mb"),
        cost.broadcast_safe(F.col("size_bytes"), limit_mb).alias("broadcast_safe"),
        "source_type",
        F.lit(None).cast("string").alias("derived_from"),
    )


def parquet_var_sizes(edges: DataFrame, sizes: DataFrame) -> DataFrame:
    """The size record each parquet variable goes back to; NULLs if there is none.

    A record fits if the whole path is inside its name, or the last part of the
    path is inside its lower-case name; tables come before parquet paths, tables
    by name and paths by path. The records of a script come as one array, bounded by what the
    script itself reads, so no pairs are formed.
    """
    records = sizes.groupBy("script_id").agg(
        F.array_sort(
            F.collect_list(
                F.struct(
                    "source_type", _reference().alias("ref"), "name", "size_bytes", "size_mb",
                    "broadcast_safe",
                )
            )
        ).alias("records")
    )
    path = F.col("path")
    fitting = let(
        F.lower(basename(path)),
        lambda last: F.filter(
            "records",
            lambda r: r["name"].contains(path) | F.lower(r["name"]).contains(last),
        ),
    )
    return (
        edges.where(F.col("kind") == "parquet")
        .select("script_id", F.col("dst").alias("var"), F.col("src").alias("path"))
        .join(records, "script_id", "left")
        .withColumn("hit", F.get(fitting, F.lit(0)))
        .select(
            "script_id", "var", "path",
            F.col("hit.name").alias("size_name"), F.col("hit.size_bytes").alias("size_bytes"),
            F.col("hit.size_mb").alias("size_mb"),
            F.col("hit.broadcast_safe").alias("broadcast_safe"),
        )
    )


def derived_sizes(edges: DataFrame, sizes: DataFrame) -> DataFrame:
    """Variables and views that come from something too large or of unknown size.

    ``edges`` and ``sizes`` are read several times and should be written tables.
    """
    variables = parquet_var_sizes(edges, sizes)
    sized = variables.where(~F.col("broadcast_safe")).select(
        "script_id", F.col("var").alias("name"), "size_bytes", "size_mb",
        F.lit(False).alias("broadcast_safe"), F.lit("parquet_var").alias("source_type"),
        F.col("size_name").alias("derived_from"),
    )
    unsized = variables.where(F.col("size_name").isNull()).select(
        "script_id", F.col("var").alias("name"),
        F.concat(
            F.lit("parquet "), F.lower(basename(F.col("path"))),
            F.lit(" (size not estimated → conservative)"),
        ).alias("derived_from"),
    )
    inputs = sizes.where(~F.col("broadcast_safe")).select(
        "script_id", F.explode(lookup_names(F.col("name"))).alias("name")
    )
    seeds = inputs.unionByName(sized.select("script_id", "name")).unionByName(
        unsized.select("script_id", "name")
    )
    spread = (
        closure_in_scripts(
            edges.where(F.col("kind") != "parquet").select("script_id", "dst", "src"), seeds
        )
        .where(F.col("hops") > 0)
        .select("script_id", "name", "derived_from")
    )
    inherited = unsized.unionByName(spread).select(
        "script_id", "name", F.lit(-1).cast("bigint").alias("size_bytes"),
        F.lit(-1.0).alias("size_mb"), F.lit(False).alias("broadcast_safe"),
        F.lit("derived_view").alias("source_type"), "derived_from",
    )
    return _one_each(sized.unionByName(inherited))


def _one_each(records: DataFrame) -> DataFrame:
    """One record per script and name: a sized one before an inherited one."""
    order = F.struct(
        (F.col("size_bytes") < 0).alias("o1"), F.col("derived_from").alias("o2"),
        *[F.col(c).alias(f"v_{c}") for c in COLUMNS[2:]],
    )
    return (
        records.groupBy("script_id", "name")
        .agg(F.min(order).alias("r"))
        .select("script_id", "name", *[F.col(f"r.v_{c}").alias(c) for c in COLUMNS[2:]])
    )


def script_input_sizes(scripts: DataFrame, table_sizes: DataFrame, path_sizes: DataFrame,
                       limit_mb: float = BROADCAST_LIMIT_MB) -> DataFrame:
    """All sized inputs of every script with what is derived from them.

    Inputs of unknown size are left out; a derived record stands in for a
    direct one of the same name. Eager: sizes and edges are written once.
    """
    # Both come from scanning all scripts and are used several times over.
    sizes = materialize(direct_sizes(scripts, table_sizes, path_sizes, limit_mb), "sizes")
    edges = materialize(lineage_edges(scripts), "lineage")
    derived = materialize(derived_sizes(edges, sizes), "derived")
    kept = sizes.join(derived.select("script_id", "name"), ["script_id", "name"], "left_anti")
    return kept.select(*COLUMNS).unionByName(derived.select(*COLUMNS))


def size_context(scripts: DataFrame, input_sizes: DataFrame,
                 limit_mb: int = BROADCAST_LIMIT_MB) -> DataFrame:
    """One text per script: its inputs, largest first, unknown sizes last."""
    line = report.size_line(
        F.col("name"), F.col("size_mb"), F.col("broadcast_safe"), F.col("derived_from"), limit_mb
    )
    by_size = F.struct(
        (F.col("size_mb") < 0).alias("unknown"),
        F.when(F.col("size_mb") >= 0, -F.col("size_mb")).otherwise(0.0).alias("size"),
        F.col("name"),
        line.alias("line"),
    )
    texts = input_sizes.groupBy("script_id").agg(
        F.array_join(
            F.concat(
                F.array(F.lit(report.size_heading(limit_mb))),
                F.transform(F.array_sort(F.collect_list(by_size)), lambda r: r["line"]),
            ),
            "\n",
        ).alias("size_context")
    )
    return scripts.select("script_id").join(texts, "script_id", "left").select(
        "script_id", F.coalesce("size_context", F.lit(NO_SIZES_TEXT)).alias("size_context")
    )
