"""Sizes, lineage and table equivalence."""

from __future__ import annotations

import re
import zlib

from pyspark.sql import functions as F

from checks.registry import PARTS, TABLES, fx, query, table
from pipewise.operators import equivalence, lineage, sizes
from pipewise.operators.equivalence import Pair
from pipewise.operators.corpus import scan_scripts
from pipewise.plans.validation import data_checks, validate_scripts, validate_tables
from pipewise.sources import files
from pipewise.sources.scratch import new_path

LIMIT = 200 * 1024 * 1024

# --- oracle parts -----------------------------------------------------------

PARTS["oq_sizing"] = r"""
SELECT script_id, array_to_string(list_filter(string_split(source, chr(10)),
  lambda l: NOT regexp_matches(l, '^\s*(?:#|--|from\s+\S+\s+import|import\s+)')), chr(10)) AS code
FROM fx_lineage_scripts UNION ALL
SELECT 1000000000 + script_id, array_to_string(list_filter(string_split(source, chr(10)),
  lambda l: NOT regexp_matches(l, '^\s*(?:#|--|from\s+\S+\s+import|import\s+)')), chr(10)) AS code
FROM fx_scripts
"""
_PAIRS = "list_distinct(list_zip(regexp_extract_all(code, '{p}', 1, '{o}'), regexp_extract_all(code, '{p}', 2, '{o}')))"
PARTS["oq_edges"] = f"""
SELECT DISTINCT script_id, 'parquet' AS kind, lower(e[1]) AS dst, e[2] AS src FROM (
  SELECT script_id, unnest({_PAIRS.format(p="(\\w+)\\s*=\\s*spark\\.read(?:\\.[a-z]+)*\\.parquet\\(\\s*[''\"]([^''\"]+)[''\"]\\s*\\)", o="i")}) AS e FROM oq_sizing)
UNION ALL
SELECT DISTINCT script_id, 'sql', lower(dst), lower(unnest(regexp_extract_all(body, '\\b(?:FROM|JOIN)\\s+(\\w+(?:\\.\\w+)*)', 1, 'i'))) FROM (
  SELECT script_id, e[1] AS dst, e[2] AS body FROM (
    SELECT script_id, unnest({_PAIRS.format(p='(\\w+)\\s*=\\s*spark\\.sql\\(\\s*(?:f?\"\"\")((?:[^\"]|\\n)*?)(?:\"\"\")\\s*\\)', o="is")}) AS e FROM oq_sizing))
UNION ALL
SELECT DISTINCT script_id, 'view', lower(e[2]), lower(e[1]) FROM (
  SELECT script_id, unnest({_PAIRS.format(p="(\\w+)\\.createOrReplaceTempView\\(\\s*[''\"](\\w+)[''\"]\\s*\\)", o="i")}) AS e FROM oq_sizing)
"""
PARTS["oq_direct"] = rf"""
SELECT script_id, name, size_bytes, round(size_bytes / 1048576.0::DOUBLE, 1) AS size_mb, size_bytes < {LIMIT} AS broadcast_safe, source_type
FROM (
  SELECT r.script_id, t.name, t.size_bytes, 'delta' AS source_type FROM (
    SELECT DISTINCT script_id, lower(unnest(list_concat(
      regexp_extract_all(code, 'spark\.read\.table\(\s*[''"]([a-zA-Z0-9_.]+)[''"]', 1, 'i'),
      regexp_extract_all(code, 'spark\.table\(\s*[''"]([a-zA-Z0-9_.]+)[''"]', 1, 'i'),
      regexp_extract_all(code, '\bFROM\s+([a-zA-Z0-9_]+\.[a-zA-Z0-9_]+)\b', 1, 'i'),
      regexp_extract_all(code, '\bJOIN\s+([a-zA-Z0-9_]+\.[a-zA-Z0-9_]+)\b', 1, 'i')))) AS name FROM oq_sizing) r
  JOIN fx_table_sizes t ON r.name = t.name
  UNION ALL
  SELECT r.script_id, regexp_extract(r.path, '([^/]*)/*$', 1) || ' (' || r.path || ')', p.size_bytes, 'parquet' FROM (
    SELECT DISTINCT script_id, unnest(regexp_extract_all(code, 'spark\.read(?:\.[a-z]+)*\.parquet\(\s*[''"]([^''"]+)[''"]', 1, 'i')) AS path FROM oq_sizing) r
  JOIN fx_path_sizes p ON r.path = p.path)
WHERE size_bytes >= 0
"""
PARTS["oq_vars"] = r"""
SELECT script_id, var, path, arg_min(name, ord) AS size_name, arg_min(size_bytes, ord) AS size_bytes, arg_min(size_mb, ord) AS size_mb, arg_min(broadcast_safe, ord) AS broadcast_safe
FROM (
  SELECT e.script_id, e.dst AS var, e.src AS path, d.name, d.size_bytes, d.size_mb, d.broadcast_safe, d.source_type || ' ' || CASE WHEN d.source_type = 'parquet' THEN regexp_extract(d.name, '^[^(]* \((.*)\)$', 1) ELSE d.name END AS ord
  FROM oq_edges e LEFT JOIN oq_direct d ON d.script_id = e.script_id
    AND (contains(d.name, e.src) OR contains(lower(d.name), lower(regexp_extract(e.src, '([^/]*)/*$', 1))))
  WHERE e.kind = 'parquet')
GROUP BY script_id, var, path
"""
PARTS["oq_spread"] = """
SELECT script_id, name, CAST(NULL AS VARCHAR) AS derived_from, 0 AS hops FROM (
  SELECT script_id, lower(trim(split_part(name, '(', 1))) AS name FROM oq_direct WHERE NOT broadcast_safe
  UNION SELECT script_id, split_part(lower(trim(split_part(name, '(', 1))), '.', -1) FROM oq_direct WHERE NOT broadcast_safe
  UNION SELECT script_id, var FROM oq_vars WHERE size_name IS NULL OR NOT broadcast_safe)
UNION
SELECT s.script_id, e.dst, e.src, s.hops + 1 FROM oq_spread s JOIN oq_edges e ON e.script_id = s.script_id AND e.src = s.name AND e.kind <> 'parquet'
WHERE s.hops < 1000
"""
PARTS["oq_derived"] = r"""
SELECT script_id, var AS name, size_bytes, size_mb, FALSE AS broadcast_safe, 'parquet_var' AS source_type, size_name AS derived_from FROM oq_vars WHERE NOT broadcast_safe
UNION ALL
SELECT script_id, var, -1, -1.0, FALSE, 'derived_view', 'parquet ' || lower(regexp_extract(path, '([^/]*)/*$', 1)) || ' (size not estimated → conservative)' FROM oq_vars WHERE size_name IS NULL
UNION ALL
SELECT script_id, name, -1, -1.0, FALSE, 'derived_view', min(derived_from) FROM (
  SELECT *, min(hops) OVER (PARTITION BY script_id, name) AS first FROM oq_spread) WHERE hops = first AND hops > 0 GROUP BY script_id, name
"""
PARTS["oq_inputs"] = """
SELECT script_id, name, size_bytes, size_mb, broadcast_safe, source_type, CAST(NULL AS VARCHAR) AS derived_from FROM oq_direct d
WHERE NOT EXISTS (SELECT 1 FROM oq_derived x WHERE x.script_id = d.script_id AND x.name = d.name)
UNION ALL SELECT * FROM oq_derived
"""
PARTS["oq_unsafe"] = f"""
SELECT name, CAST(NULL AS VARCHAR) AS derived_from, 0 AS hops FROM fx_sizes WHERE size_bytes < 0 OR size_bytes >= {LIMIT}
UNION SELECT e.dst, e.src, u.hops + 1 FROM oq_unsafe u JOIN fx_edges e ON e.src = u.name WHERE u.hops < 1000
"""
_CANDIDATES = {
    "cand_same": "SELECT * FROM lineitem",
    "cand_rows": "SELECT * FROM lineitem WHERE l_linenumber <> 7",
    "cand_value": "SELECT * REPLACE (CASE WHEN l_orderkey = 10 THEN l_quantity + 1 ELSE l_quantity END AS l_quantity) FROM lineitem",
    "cand_schema": "SELECT * EXCLUDE (l_tax) REPLACE (CAST(l_linenumber AS BIGINT) AS l_linenumber), 0 AS l_extra FROM lineitem",
}


def _profile(source: str, columns: list[str]) -> str:
    each = [f"SELECT NULL AS \"column\", CAST(count(*) AS DOUBLE) AS total FROM ({source})"]
    for c in columns:
        kind = "DECIMAL(38,0)" if c in ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber") else "DECIMAL(38,6)"
        each.append(f"SELECT '{c}', CAST(sum(CAST({c} AS {kind})) AS DOUBLE) FROM ({source})")
    return "\nUNION ALL ".join(each)


NUMERIC = "l_orderkey l_partkey l_suppkey l_linenumber l_quantity l_extendedprice l_discount l_tax".split()


def _diff(name: str) -> str:
    columns = [c for c in NUMERIC if not (name == "cand_schema" and c == "l_tax")]
    return f"""SELECT '{name}' AS proposal, r."column", r.total AS ref_sum, c.total AS cand_sum,
  r.total IS NOT DISTINCT FROM c.total AS match
FROM ({_profile("SELECT * FROM lineitem", columns)}) r JOIN ({_profile(_CANDIDATES[name], columns)}) c ON r."column" IS NOT DISTINCT FROM c."column" """


# --- inputs -----------------------------------------------------------------


def _scripts(spark, sf):
    """Both kinds of scripts under numbers of their own."""
    rich = fx(spark, sf, "fx_lineage_scripts", dealt=True).select("script_id", "source")
    plain = fx(spark, sf, "fx_scripts", dealt=True).select(
        (F.col("script_id") + 1000000000).alias("script_id"), "source"
    )
    return rich.unionByName(plain)


def _direct(spark, sf):
    return sizes.direct_sizes(
        _scripts(spark, sf), fx(spark, sf, "fx_table_sizes"), fx(spark, sf, "fx_path_sizes")
    )


def _inputs(spark, sf):
    return sizes.script_input_sizes(
        _scripts(spark, sf), fx(spark, sf, "fx_table_sizes"), fx(spark, sf, "fx_path_sizes")
    )


def _pairs(spark, sf):
    line = table(spark, sf, "lineitem")
    raised = F.when(F.col("l_orderkey") == 10, F.col("l_quantity") + 1).otherwise(F.col("l_quantity"))
    candidates = {
        "cand_same": table(spark, sf, "lineitem"),
        "cand_rows": line.where("l_linenumber <> 7"),
        "cand_value": line.withColumn("l_quantity", raised),
        "cand_schema": line.drop("l_tax")
        .withColumn("l_extra", F.lit(0))
        .withColumn("l_linenumber", F.col("l_linenumber").cast("bigint")),
    }
    return [Pair(name, "lineitem", line, df) for name, df in candidates.items()]


# --- queries ----------------------------------------------------------------


def _listing(spark, sf):
    """Files as a listing names them, with their file system."""
    return fx(spark, sf, "fx_files").select(
        F.concat(F.lit("hdfs://host:8020"), "path").alias("path"), "length"
    )


PARTS["oq_levels"] = """
SELECT length, path, array_to_string(list_slice(parts, 1, n), '/') AS dir FROM (
  SELECT length, path, string_split(path, '/') AS parts, unnest(generate_series(1, len(string_split(path, '/')))) AS n FROM fx_files)
"""


@query(
    "dir_sizes",
    """SELECT r.root, coalesce(CAST(sum(l.length) AS BIGINT), -1) AS size_bytes
FROM (SELECT DISTINCT root FROM fx_roots) r LEFT JOIN oq_levels l
  ON l.dir = rtrim(replace(r.root, 'hdfs://host:8020', ''), '/') GROUP BY r.root""",
)
def dir_sizes(spark, sf):
    return files.dir_sizes(_listing(spark, sf), fx(spark, sf, "fx_roots"))


@query(
    "table_sizes",
    """SELECT lower(r.name) AS name, coalesce(CAST(sum(l.length) AS BIGINT), -1) AS size_bytes
FROM fx_roots r LEFT JOIN oq_levels l ON l.dir = rtrim(replace(r.root, 'hdfs://host:8020', ''), '/') GROUP BY r.name""",
)
def table_sizes(spark, sf):
    return files.table_sizes(_listing(spark, sf), fx(spark, sf, "fx_roots"))


@query("lineage_edges", "SELECT script_id, kind, dst, src FROM oq_edges")
def lineage_edges(spark, sf):
    return lineage.lineage_edges(_scripts(spark, sf))


@query(
    "parquet_var_sizes",
    "SELECT script_id, var, path, size_name, size_bytes, size_mb, broadcast_safe FROM oq_vars",
)
def parquet_var_sizes(spark, sf):
    return sizes.parquet_var_sizes(
        lineage.lineage_edges(_scripts(spark, sf)), _direct(spark, sf)
    )


@query(
    "unsafe_closure",
    """WITH RECURSIVE first_seen AS (SELECT name, derived_from, hops, min(hops) OVER (PARTITION BY name) AS first FROM oq_unsafe)
SELECT name, min(derived_from) AS derived_from, CAST(min(hops) AS INTEGER) AS hops FROM first_seen WHERE hops = first GROUP BY name""",
)
def unsafe_closure(spark, sf):
    seeds = fx(spark, sf, "fx_sizes").where(
        (F.col("size_bytes") < 0) | (F.col("size_bytes") >= LIMIT)
    )
    return lineage.unsafe_closure(fx(spark, sf, "fx_edges"), seeds)


@query(
    "script_input_sizes",
    """WITH RECURSIVE result AS (SELECT * FROM oq_inputs)
SELECT script_id, name, size_bytes, size_mb, broadcast_safe, source_type, derived_from FROM result""",
)
def script_input_sizes(spark, sf):
    return _inputs(spark, sf)


@query(
    "size_context",
    """WITH RECURSIVE lines AS (
  SELECT script_id, name, size_mb, '  ' || name || ': ' || CAST(CAST(size_mb AS DECIMAL(18,1)) AS VARCHAR) || ' MB  — '
    || CASE WHEN broadcast_safe THEN '✓ broadcast OK' WHEN size_mb < 0 THEN '✗ NO broadcast (large source — size not estimable)'
       ELSE '✗ NO broadcast (' || CAST(round(size_mb) AS BIGINT) || ' MB > threshold)' END
    || CASE WHEN derived_from IS NOT NULL THEN '  [derived from: ' || derived_from || ']' ELSE '' END AS line FROM oq_inputs)
SELECT s.script_id, coalesce('TABLE SIZES ON DISK (broadcast threshold: 200 MB):' || chr(10) || l.lines,
  '(sizes could not be estimated — use conservative broadcast criteria)') AS size_context
FROM oq_sizing s LEFT JOIN (
  SELECT script_id, string_agg(line, chr(10) ORDER BY size_mb < 0, CASE WHEN size_mb >= 0 THEN -size_mb ELSE 0 END, name) AS lines
  FROM lines GROUP BY script_id) l ON s.script_id = l.script_id""",
)
def size_context(spark, sf):
    return sizes.size_context(_scripts(spark, sf), _inputs(spark, sf))


_KIND = """CASE column_type WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int' WHEN 'DOUBLE' THEN 'double'
  WHEN 'VARCHAR' THEN 'string' WHEN 'TIMESTAMP' THEN 'timestamp_ntz' ELSE lower(column_type) END"""


@query(
    "schema_diff",
    "\nUNION ALL ".join(
        f"""SELECT '{name}' AS proposal, 'lineitem' AS "table", coalesce(r.column_name, c.column_name) AS "column", r.t AS ref_type, c.t AS cand_type,
  CASE WHEN c.t IS NULL THEN 'missing' WHEN r.t IS NULL THEN 'added' WHEN r.t <> c.t THEN 'changed' ELSE 'same' END AS status
FROM (SELECT column_name, {_KIND} AS t FROM (DESCRIBE SELECT * FROM lineitem)) r
FULL JOIN (SELECT column_name, {_KIND} AS t FROM (DESCRIBE {sql})) c ON r.column_name = c.column_name"""
        for name, sql in _CANDIDATES.items()
    ),
)
def schema_diff(spark, sf):
    return equivalence.schema_diff(spark, _pairs(spark, sf))


@query("table_profile", _profile("SELECT * FROM lineitem", NUMERIC))
def table_profile(spark, sf):
    return equivalence.table_profile(table(spark, sf, "lineitem")).select("column", "total")


@query("table_diff", "\nUNION ALL ".join(_diff(name) for name in _CANDIDATES))
def table_diff(spark, sf):
    return data_checks(_pairs(spark, sf)).drop("table")


@query(
    "validate_tables",
    "SELECT proposal, CAST(1 AS BIGINT) AS n_pairs, CASE WHEN bool_and(match) THEN 'passed' ELSE 'data_mismatch' END AS validation_status FROM (\n"
    + "\nUNION ALL ".join(_diff(n) for n in _CANDIDATES if n != "cand_schema")
    + "\n) GROUP BY proposal UNION ALL SELECT 'cand_schema', 1, 'schema_mismatch'",
)
def validate_all(spark, sf):
    return validate_tables(spark, _pairs(spark, sf))


def _catalog(spark, sf, kind):
    """A schema of the catalog for this folder of tables."""
    name = f"{kind}_{zlib.crc32(sf.encode()):08x}"
    if not spark.catalog.databaseExists(name):
        spark.sql(f"CREATE SCHEMA {name} LOCATION '{new_path(spark, name)}'")
    return name


@query("named_table_sizes")
def named_table_sizes(spark, sf):
    """Sizes of the given tables by their name in the catalog, and of names that
    are none; DuckDB cannot see files, so the tests compare with the disk."""
    schema = _catalog(spark, sf, "given")
    for t in TABLES:
        if not spark.catalog.tableExists(f"{schema}.{t}"):
            spark.sql(f"CREATE TABLE {schema}.{t} USING parquet LOCATION '{sf}/{t}.parquet'")
    names = [f"{schema}.{t}" for t in (*TABLES, "no_table")]
    return files.named_table_sizes(spark, names).withColumn("name", F.split_part("name", F.lit("."), F.lit(2)))


def _rewrites(schema, sf):
    """Scripts that fill a copy of orders, in ways that lead to every status."""
    write = f"INSERT INTO {schema}.orders SELECT * FROM parquet.`{sf}/orders.parquet`"
    value = "o_totalprice + CASE WHEN o_orderkey = 1 THEN 1 ELSE 0 END AS o_totalprice"
    shape = f"CREATE TABLE {schema}.orders USING parquet AS SELECT *, 1 AS extra FROM parquet.`{sf}/orders.parquet`"
    scripts = {
        "same": [write],
        "fewer rows": [f"{write} WHERE o_orderkey % 7 <> 0"],
        "other sum": [write.replace("SELECT *", f"BY NAME SELECT * EXCEPT (o_totalprice), {value}")],
        "other shape": [f"DROP TABLE {schema}.orders", shape],
        "crash": [f"{write} WHERE no_such_column = 1"],
        "no target": [f"SELECT count(*) FROM parquet.`{sf}/orders.parquet`"],
        "mails": [write, "SELECT 1 -- requests.post(url)"],
        "one scratch name": [f"INSERT INTO {schema}.orders SELECT 1", f"INSERT INTO {schema}_b.orders SELECT 1"],
    }
    return {p: "\n".join(f'spark.sql("{x}")' for x in own) for p, own in scripts.items()}


@query(
    "validate_scripts",
    """SELECT 'same' AS proposal, CAST(1 AS BIGINT) AS n_pairs, 'passed' AS validation_status
UNION ALL SELECT 'fewer rows', 1, CASE WHEN count(*) FILTER (o_orderkey % 7 = 0) = 0 THEN 'passed' ELSE 'data_mismatch' END FROM orders
UNION ALL SELECT 'other sum', 1, CASE WHEN count(*) FILTER (o_orderkey = 1) = 0 THEN 'passed' ELSE 'data_mismatch' END FROM orders
UNION ALL SELECT 'other shape', 1, 'schema_mismatch'
UNION ALL SELECT 'crash', 0, 'smoke_failed'
UNION ALL SELECT 'no target', 0, 'smoke_passed'
UNION ALL SELECT 'mails', 0, 'skipped'
UNION ALL SELECT 'one scratch name', 0, 'failed'""",
)
def validate_all_scripts(spark, sf):
    schema = _catalog(spark, sf, "checked")
    if not spark.catalog.tableExists(f"{schema}.orders"):
        table(spark, sf, "orders").write.saveAsTable(f"{schema}.orders")
    scripts = spark.createDataFrame(list(_rewrites(schema, sf).items()), "proposal_id string, source string")

    def run(spark, proposal, source):
        for statement in re.findall(r'spark\.sql\("(.*?)"\)', source, re.S):
            spark.sql(statement).collect()

    return validate_scripts(spark, scan_scripts(scripts), run)
