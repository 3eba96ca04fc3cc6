"""Sizes of directories and tables, from file listings alone."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.errors import AnalysisException, ParseException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UNKNOWN = -1
_PLACE = r"^([A-Za-z][A-Za-z0-9+.-]*:(?://[^/]*)?)?(.*)$"


def _place(path: Column) -> tuple[Column, Column]:
    """File system (scheme and authority, empty if not named) and path within it.
    ``file:///x`` and ``file:/x`` are the same place."""
    system = F.regexp_replace(F.lower(F.regexp_extract(path, _PLACE, 1)), "//$", "")
    inside = F.regexp_replace(F.regexp_extract(path, _PLACE, 2), "/+", "/")
    return system, F.regexp_replace(inside, "(?<=.)/$", "")


_ODD = r"[*?\[\]{}\\,^]"
"""Characters that mean something in a pattern of paths."""


def _glob(paths: list[str]) -> str:
    """One pattern for the paths of one file system; an odd character may be any."""
    return "/{" + ",".join(re.sub(_ODD, "?", p.strip("/")) for p in paths) + "}"


def _below(paths: list[str]) -> Column:
    """Files at or below one of the paths."""
    inside = _place(F.col("path"))[1]
    trimmed = ["/" + p.strip("/") for p in paths]
    return reduce(Column.__or__, [(inside == p) | inside.startswith(p.rstrip("/") + "/") for p in trimmed])


def list_files(spark: SparkSession, roots: list[str]) -> DataFrame:
    """(path, length) of every file below the roots that exist; names as they are.

    Only file metadata is read. The roots of a file system are one pattern, so
    they are looked up and listed once, in parallel, whether some are missing or
    not: a missing root matches nothing.
    """
    systems: dict[str, list[str]] = {}
    for root in dict.fromkeys(roots):
        system, inside = re.match(_PLACE, root, re.S).groups()
        if not inside.startswith("/"):
            raise ValueError(f"not an absolute path: {root}")
        systems.setdefault(system or "", []).append(inside)
    listed = [spark.createDataFrame([], "path string, length bigint")]
    for system, paths in systems.items():
        reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
        try:
            found = reader.load(system + _glob(paths)).select("path", "length")
            odd = any(re.search(_ODD, p) for p in paths)
            listed.append(found.where(_below(paths)) if odd else found)
        except AnalysisException as found_nothing:
            if found_nothing.getCondition() != "PATH_NOT_FOUND":
                raise
    return reduce(DataFrame.unionByName, listed).distinct()


def dir_sizes(files: DataFrame, roots: DataFrame, default_system: str | None = None) -> DataFrame:
    """(root, size_bytes): bytes of the files below each root, or -1.

    ``files`` has path and length, one row per file; ``roots`` has root. A root
    may be a file, lie in another, and name its file system or not; one that no
    file lies below is of unknown size. Paths and roots that name none are on the
    ``default_system`` (``hdfs://host:8020``); without one, a root that names none
    may be on any, so files of several systems should not be mixed then. Every
    file is counted for each of its parent directories, so roots are found by an
    equi join.
    """
    home = _place(F.lit(f"{default_system or ''}/"))[0]

    def place(path: Column) -> tuple[Column, Column]:
        system, inside = _place(path)
        return F.when(system == "", home).otherwise(system), inside

    anywhere = F.array() if default_system else F.array(F.lit(""))
    system, inside = place(F.col("path"))
    placed = files.select(system.alias("system"), inside.alias("file"), "length")
    parts = F.split("file", "/")
    above = F.transform(
        F.sequence(F.lit(1), F.size(parts)),
        lambda n: F.array_join(F.slice(parts, 1, n), "/"),
    )
    level = placed.select("system", "length", F.explode(above).alias("dir"))
    level = level.select(
        "length",
        F.explode(F.array_distinct(F.concat(F.array("system"), anywhere))).alias("system"),
        F.when(F.col("dir") == "", "/").otherwise(F.col("dir")).alias("dir"),
    )
    system, inside = place(F.col("root"))
    wanted = roots.select("root").distinct().select(
        "root", system.alias("system"), inside.alias("dir")
    )
    totals = level.join(wanted.select("system", "dir").distinct(), ["system", "dir"]).groupBy(
        "system", "dir"
    ).agg(F.sum("length").alias("bytes"))
    return wanted.join(totals, ["system", "dir"], "left").select(
        "root", F.coalesce("bytes", F.lit(UNKNOWN).cast("bigint")).alias("size_bytes")
    )


def table_sizes(files: DataFrame, tables: DataFrame) -> DataFrame:
    """(name, size_bytes): size on disk of named tables (name, root); the name in
    lower case."""
    sizes = dir_sizes(files, tables)
    return tables.join(sizes, "root").select(F.lower("name").alias("name"), "size_bytes")


def path_sizes(spark: SparkSession, roots: list[str]) -> DataFrame:
    """``dir_sizes`` of paths, listed now; a root that names no file system is on
    the one Spark finds it on."""
    asked = spark.createDataFrame([(r,) for r in roots], "root string")
    home = spark.sparkContext._jsc.hadoopConfiguration().get("fs.defaultFS") or "file:///"
    return dir_sizes(list_files(spark, roots), asked, re.sub("/+$", "", home) or None)


def _table_files(spark: SparkSession, name: str) -> DataFrame | None:
    """(name, path, length) of a named table's files, a row for every row of
    data; no column is read. None if there is no such table, or no file is."""
    try:
        rows = spark.table(name).select("_metadata.file_path", "_metadata.file_size")
    except (AnalysisException, ParseException):
        return None
    return rows.select(
        F.lit(name).alias("name"), F.col("file_path").alias("path"), F.col("file_size").alias("length")
    )


def named_table_files(spark: SparkSession, names: list[str]) -> DataFrame:
    """(name, path, length): the files that hold rows of the named tables, each
    once, wherever their partitions lie; names that are no tables of files have
    none. One plan for all names."""
    found = [f for f in (_table_files(spark, n) for n in dict.fromkeys(names)) if f is not None]
    none = spark.createDataFrame([], "name string, path string, length bigint")
    return reduce(DataFrame.unionByName, found, none).distinct()


def named_table_sizes(spark: SparkSession, names: list[str]) -> DataFrame:
    """(name, size_bytes): bytes on disk of tables by their name in the catalog.

    The name comes back in lower case, once for all spellings. A name that is no
    table, or a table or view that is not made of files, is of unknown size
    (-1); a table without rows has none (0). Files come from the table's own
    metadata, so a partition outside the table's folder counts too.
    """
    resolved = [n for n in dict.fromkeys(n.lower() for n in names)]
    known = {n: _table_files(spark, n) is not None for n in resolved}
    asked = spark.createDataFrame([(n, known[n]) for n in resolved], "name string, known boolean")
    totals = named_table_files(spark, [n for n in resolved if known[n]]).groupBy("name").agg(
        F.sum("length").alias("bytes")
    )
    size = F.when(F.col("known"), F.coalesce("bytes", F.lit(0).cast("bigint"))).otherwise(F.lit(UNKNOWN))
    return asked.join(totals, "name", "left").select("name", size.cast("bigint").alias("size_bytes"))
