"""Named queries, their oracle SQL, and the resolution of shared texts.

A text (fixture or oracle part) is used by writing its name where a table would
stand. Spark gets fixtures as temp views; DuckDB gets all texts a query needs
as common table expressions.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from checks.fixtures import FIXTURES

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
PARTS: dict[str, str] = {}
"""Oracle-side texts shared by several oracles; names start with ``oq_``."""

_NAME = re.compile(r"\b(?:fx|oq)_\w+")


def query(name: str, oracle: str | None = None):
    """Register a query; ``oracle`` is a SELECT over tables and shared texts."""

    def add(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return add


def _text(name: str, engine: str) -> str:
    sql = FIXTURES[name] if name in FIXTURES else PARTS[name]
    hashed = r"sha2(\1, 256)" if engine == "spark" else r"sha256(\1)"
    return re.sub(r"@SHA256\((.*?)\)@", hashed, sql.replace("@Q3@", '"""')).strip()


def _needed(sql: str, seen: list[str], engine: str, within: tuple[str, ...] = ()) -> list[str]:
    """Names used, directly or not, in the order they must be defined; a
    recursive text uses itself."""
    for name in dict.fromkeys(_NAME.findall(sql)):
        if name not in seen and name not in within and (name in FIXTURES or name in PARTS):
            _needed(_text(name, engine), seen, engine, (*within, name))
            seen.append(name)
    return seen


def oracle_sql(name: str) -> str:
    """The oracle as one self-contained DuckDB statement."""
    sql = ORACLES[name].strip()
    shared = [f"{n} AS ({_text(n, 'duckdb')})" for n in _needed(sql, [], "duckdb")]
    head = re.match(r"WITH\s+(RECURSIVE\s+)?", sql)
    if head:
        word = "WITH RECURSIVE " if head.group(1) else "WITH "
        return word + ",\n".join([*shared, sql[head.end():]])
    return ("WITH " + ",\n".join(shared) + "\n" if shared else "") + sql


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _dealt(rows: DataFrame) -> DataFrame:
    """The rows dealt to all cores. A file of few bytes or row groups is read by one
    or two tasks, however many scripts are made of its rows; only the columns
    used are moved."""
    return rows.repartition(4 * rows.sparkSession.sparkContext.defaultParallelism)


PART_ROWS = 100_000
"""Rows of the largest table read that a shuffle has a partition for."""
INITIAL = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
_rows: dict[str, int] = {}


def _size_shuffles(spark: SparkSession, sf_dir: str, names: list[str]) -> None:
    """Let shuffles begin with partitions in proportion to the tables, at least those
    the session has; adaptive execution joins small ones."""
    for t in names:
        path = f"{sf_dir}/{t}.parquet"
        if path not in _rows:
            _rows[path] = table(spark, sf_dir, t).count()
    most = max((_rows[f"{sf_dir}/{t}.parquet"] for t in names), default=0)
    now = spark.conf.get(INITIAL, None) or spark.conf.get("spark.sql.shuffle.partitions")
    if most // PART_ROWS > int(now):
        spark.conf.set(INITIAL, str(most // PART_ROWS))


def fx(spark: SparkSession, sf_dir: str, name: str, dealt: bool = False) -> DataFrame:
    """A fixture as a DataFrame over the tables of ``sf_dir``, their rows ``dealt`` to
    all cores where much is made of each."""
    sql = _text(name, "spark")
    wanted = _needed(sql, [], "spark")
    texts = [_text(n, "spark") for n in wanted] + [sql]
    used = [t for t in TABLES if any(re.search(rf"\b{t}\b", text) for text in texts)]
    _size_shuffles(spark, sf_dir, used)
    for t in used:
        rows = table(spark, sf_dir, t)
        (_dealt(rows) if dealt else rows).createOrReplaceTempView(t)
    for n in wanted:
        spark.sql(_text(n, "spark")).createOrReplaceTempView(n)
    return spark.sql(sql)
