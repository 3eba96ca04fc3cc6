"""Input tables derived from the driver's tables, as SQL that Spark and DuckDB both run.

A query and its oracle start from the same text, so both see the same input,
and every input grows with the tables it is made from. A text may use other
texts here by name.
"""

# The moment all queries look from.
AS_OF = "1998-07-01 00:00:00"

FIXTURES: dict[str, str] = {}

FIXTURES["fx_runs"] = """
SELECT CAST(floor(o_custkey / 30) AS BIGINT) AS job_id, o_orderkey AS run_id,
       o_orderkey * 86400000 AS start_ms, o_orderkey % 997 = 0 AS is_active
FROM orders
"""

FIXTURES["fx_task_runs"] = """
SELECT CAST(floor(o_custkey / 30) AS BIGINT) AS job_id, o_orderkey AS run_id,
       'task_' || CAST(l_partkey % 40 AS STRING) AS task_key,
       CASE WHEN min(l_returnflag) = 'R' THEN 'FAILED' ELSE 'SUCCESS' END AS result_state,
       o_orderkey * 86400000 AS start_ms,
       CASE WHEN max(l_linenumber) = 7 AND o_orderkey % 11 = 0 THEN NULL
            ELSE o_orderkey * 86400000 + CAST(sum(l_quantity) AS BIGINT) * 60000 END AS end_ms
FROM lineitem JOIN orders ON l_orderkey = o_orderkey
GROUP BY o_custkey, o_orderkey, l_partkey % 40
"""

FIXTURES["fx_job_tasks"] = """
SELECT CAST(floor(p_partkey / 40) AS BIGINT) AS job_id,
       'task_' || CAST(p_partkey % 40 AS STRING) AS task_key,
       CASE WHEN p_partkey % 40 % 13 = 12 THEN NULL
            ELSE '/jobs/' || CAST(CAST(floor(p_partkey / 40) AS BIGINT) AS STRING) || '/task_' || CAST(p_partkey % 40 AS STRING) END AS script_path,
       CASE WHEN p_partkey % 40 % 3 = 0 THEN 'jc_' || CAST(p_partkey % 40 % 4 AS STRING) END AS job_cluster_key,
       CASE WHEN p_partkey % 40 % 3 = 1 THEN 'ec_' || CAST(p_partkey % 40 % 7 AS STRING) END AS existing_cluster_id,
       CASE WHEN p_partkey % 40 % 5 <> 0 THEN 'task_' || CAST((p_partkey % 40) - 1 AS STRING) END AS depends_on
FROM part
"""

FIXTURES["fx_clusters"] = """
SELECT * FROM (VALUES
  ('jc_0', 'Standard_DS3_v2', 1, NULL, 'STANDARD'),
  ('jc_1', 'Standard_E8d_v4', 4, NULL, 'STANDARD'),
  ('jc_2', 'Unknown_Xyz_v99', 2, NULL, NULL),
  ('jc_3', 'Standard_DS3_v2', NULL, 8, 'photon'),
  ('ec_0', 'Standard_DS3_v2', 0, NULL, NULL),
  ('ec_1', 'Standard_E16d_v4', 16, NULL, 'PHOTON'),
  ('ec_2', 'Standard_DS5_v2', NULL, NULL, NULL),
  ('ec_3', 'Standard_E4d_v4', 3, NULL, NULL),
  ('ec_4', 'Standard_D8s_v3', 2, 6, NULL)
) AS t(cluster_key, node_type_id, num_workers, max_workers, runtime_engine)
"""

FIXTURES["fx_node_weights"] = """
SELECT * FROM (VALUES
  ('Standard_DS3_v2', CAST(1.0 AS DOUBLE)), ('Standard_DS5_v2', CAST(4.0 AS DOUBLE)),
  ('Standard_D8s_v3', CAST(2.0 AS DOUBLE)), ('Standard_E4d_v4', CAST(1.5 AS DOUBLE)),
  ('Standard_E8d_v4', CAST(3.0 AS DOUBLE)), ('Standard_E16d_v4', CAST(6.0 AS DOUBLE))
) AS t(node_type_id, node_weight)
"""

FIXTURES["fx_scripts"] = """
SELECT CAST(p_partkey AS BIGINT) AS script_id,
  '/jobs/' || CAST(CAST(floor(p_partkey / 40) AS BIGINT) AS STRING) || '/task_' || CAST(p_partkey % 40 AS STRING) AS path,
  '# Notebook' || chr(10) || '# COMMAND ----------' || chr(10) || '# DBTITLE 1,Load ' || p_name || chr(10) ||
  CASE p_partkey % 8
    WHEN 0 THEN 'df = spark.read.table("wh.src_' || CAST(p_size AS STRING) || '")' || chr(10) || 'df.write.saveAsTable("wh.out_' || CAST(p_size AS STRING) || '")'
    WHEN 1 THEN 'spark.sql("INSERT INTO wh.t' || CAST(p_size AS STRING) || ' SELECT * FROM wh.t' || CAST(p_size AS STRING) || ' ")'
    WHEN 2 THEN 'requests.post(url)' || chr(10) || 'df.write.saveAsTable("wh.api")'
    WHEN 3 THEN '# df.write.saveAsTable("wh.commented")' || chr(10) || 'x = 1'
    WHEN 4 THEN 'spark.sql("CREATE TABLE IF NOT EXISTS wh.ine (a INT)")'
    WHEN 5 THEN 'spark.sql("MERGE INTO wh.Dim USING u ON 1=1")' || chr(10) || 'q.writeStream.start()'
    WHEN 6 THEN 'p = spark.read.option("a","b").parquet("/data/big_' || CAST(p_size AS STRING) || '/")' || chr(10) || 'p.createOrReplaceTempView("v")'
    ELSE 'spark.sql("INSERT OVERWRITE TABLE wh.o1 SELECT * FROM wh.a JOIN wh.b ON 1=1")' END ||
  chr(10) || '# COMMAND ----------' || chr(10) || 'print(1)' AS source
FROM part
"""

FIXTURES["fx_edges"] = """
SELECT 'v' || CAST(p_partkey AS STRING) AS dst,
       CASE WHEN p_partkey % 8 = 0 THEN 'root_' || CAST(p_size AS STRING) ELSE 'v' || CAST(p_partkey - 1 AS STRING) END AS src
FROM part
"""

FIXTURES["fx_sizes"] = """
SELECT 'v' || CAST(p_partkey AS STRING) AS name,
       CASE WHEN p_partkey % 48 = 0 THEN CAST(-1 AS BIGINT) WHEN p_partkey % 40 = 3 THEN CAST(p_partkey AS BIGINT) * 1048576
            ELSE CAST(p_size AS BIGINT) * 1048576 END AS size_bytes
FROM part
UNION ALL
SELECT DISTINCT 'root_' || CAST(p_size AS STRING), CASE WHEN p_size % 3 = 0 THEN CAST(-1 AS BIGINT) ELSE CAST(p_size AS BIGINT) * 8388608 END FROM part
"""

FIXTURES["fx_proposals"] = """
SELECT 'p' || CAST(o_orderkey AS STRING) AS proposal_id, CAST(floor(o_custkey / 30) AS BIGINT) AS job_id,
       'task_' || CAST(o_orderkey % 40 AS STRING) AS task_key, o_orderdate AS created_ts,
       CAST((o_orderkey * 37) % 7200 AS DOUBLE) AS duration_original_s,
       CASE WHEN o_orderkey % 23 = 0 THEN NULL ELSE '/proposals/p' || CAST(o_orderkey AS STRING) END AS v2_path,
       CASE WHEN o_orderkey % 31 = 0 THEN 'stale-hash' ELSE 'hash' END AS original_source_hash,
       CASE o_orderstatus WHEN 'P' THEN 'proposed' WHEN 'F' THEN 'rejected' ELSE 'applied' END AS status,
       CASE WHEN o_orderkey % 17 = 0 THEN '{bad'
            WHEN o_orderkey % 19 = 0 THEN NULL
            ELSE '{"changes_applied":[{"description":"opt ' || CAST(o_orderkey % 9 AS STRING) || '","estimated_savings":"high"},{"description":" "}]}' END AS analysis
FROM orders
"""

FIXTURES["fx_applied"] = """
SELECT 'p' || CAST(o_orderkey AS STRING) AS proposal_id, o_orderdate + INTERVAL '1' DAY AS applied_ts,
       'user' || CAST(o_orderkey % 5 AS STRING) || '@example.com' AS applied_by,
       CASE WHEN o_orderstatus = 'F' THEN o_orderdate + INTERVAL '2' DAY END AS rollback_ts,
       CASE WHEN o_orderkey % 4 = 0 THEN o_orderdate + INTERVAL '3' DAY END AS first_reported_ts
FROM orders WHERE o_orderstatus <> 'P'
"""

FIXTURES["fx_decisions"] = """
SELECT 'p' || CAST(o_orderkey AS STRING) AS proposal_id,
       CASE o_orderkey % 3 WHEN 0 THEN 'approve' WHEN 1 THEN 'reject' ELSE 'rollback' END AS action,
       'user' || CAST(o_orderkey % 5 AS STRING) || '@example.com' AS actor,
       o_orderdate + INTERVAL '5' DAY AS decided_ts, 'n' AS notes
FROM orders
"""

FIXTURES["fx_outcomes"] = """
SELECT CAST(floor(o_custkey / 30) AS BIGINT) AS job_id, o_orderkey AS rank_pos,
  CASE o_orderkey % 7 WHEN 0 THEN 'export_error' WHEN 1 THEN 'llm_error' WHEN 2 THEN 'no_changes'
    WHEN 3 THEN 'schema_mismatch' WHEN 4 THEN 'data_mismatch' WHEN 5 THEN 'passed' ELSE 'skipped' END AS outcome
FROM orders
"""

FIXTURES["fx_responses"] = """
SELECT o_orderkey AS response_id,
  CASE o_orderkey % 12
    WHEN 0 THEN '{"changes":[{"cell_id":"idx_1","new_code":"x = ' || CAST(o_orderkey AS STRING) || '"}]}'
    WHEN 1 THEN '```json' || chr(10) || '{"changes":[{"cell_id":"idx_99","new_code":"y = 1"}]}' || chr(10) || '```'
    WHEN 2 THEN 'Sure:' || chr(10) || '```json' || chr(10) || '{"changes":[]}' || chr(10) || '```' || chr(10) || 'Done.'
    WHEN 3 THEN 'Preamble {"optimized_code":"z = 1"} postamble'
    WHEN 4 THEN 'no json here'
    WHEN 5 THEN '2 changes proposed:' || chr(10) || '```json' || chr(10) || '{"changes":[{"cell_id":"idx_1","new_code":"n = 2"}]}' || chr(10) || '```'
    WHEN 6 THEN 'null: see below {"changes":[{"cell_id":"idx_1","new_code":"n = 3"},{"cell_id":"idx_1","new_code":"n = 4"}]}'
    WHEN 7 THEN '"ok" here: {"optimized_code":"z = 2"}'
    WHEN 8 THEN '{"changes":[{"cell_id":"idx_0","new_code":"t = 1"}]} and that is all of it'
    WHEN 9 THEN '[{"changes":[]}]'
    WHEN 10 THEN '12'
    ELSE '{"changes":[{"cell_id":"Load","new_code":"a = 1"},{"cell_id":"print(1)","new_code":"b = 2"}]}' END AS raw
FROM orders
"""

# Clusters, one per line item: every node type, unknown and missing sizes.
FIXTURES["fx_line_clusters"] = """
SELECT CAST(l_orderkey AS STRING) || '-' || CAST(l_linenumber AS STRING) || '-' || CAST(l_partkey AS STRING) AS cluster_key,
  CASE l_partkey % 7 WHEN 0 THEN 'Standard_DS3_v2' WHEN 1 THEN 'Standard_DS5_v2' WHEN 2 THEN 'Standard_D8s_v3'
    WHEN 3 THEN 'Standard_E4d_v4' WHEN 4 THEN 'Standard_E8d_v4' WHEN 5 THEN 'Standard_E16d_v4' ELSE 'Unknown_Xyz_v99' END AS node_type_id,
  CASE WHEN l_linenumber = 3 THEN NULL ELSE CAST(l_suppkey % 9 AS INT) END AS num_workers,
  CASE WHEN l_suppkey % 2 = 0 THEN CAST(l_suppkey % 17 AS INT) END AS max_workers,
  CASE l_returnflag WHEN 'R' THEN 'photon' WHEN 'A' THEN 'STANDARD' END AS runtime_engine
FROM lineitem
"""

# Scripts, prose and web pages together: the corpus for the scans.
FIXTURES["fx_corpus"] = """
SELECT 's' || CAST(script_id AS STRING) AS script_id, path, source FROM fx_scripts
UNION ALL
SELECT 'l' || CAST(script_id AS STRING), path, source FROM fx_lineage_scripts
UNION ALL
SELECT 'd' || CAST(doc_id AS STRING), '/docs/' || CAST(doc_id AS STRING), text FROM documents
UNION ALL
SELECT 'p' || CAST(page_id AS STRING), url, html FROM pages
"""

# Scripts with paths, views over views, imports and comments.
FIXTURES["fx_lineage_scripts"] = """
SELECT CAST(p_partkey AS BIGINT) AS script_id, '/lineage/task_' || CAST(p_partkey AS STRING) AS path,
  'from wh.sub import tools' || chr(10) || 'import os' || chr(10) ||
  'raw = spark.read.parquet("/data/p_' || CAST(p_size AS STRING) || '/")' || chr(10) ||
  'raw.createOrReplaceTempView("v_raw")' || chr(10) ||
  '# COMMAND ----------' || chr(10) || '# DBTITLE 1, Step ' || p_name || ' ' || chr(10) ||
  'A = spark.sql(@Q3@SELECT * FROM wh.t' || CAST(p_size AS STRING) || ' JOIN v_raw ON 1=1@Q3@)' || chr(10) ||
  'A.createOrReplaceTempView("v_a")' || chr(10) ||
  '# COMMAND ----------' || chr(10) || '  -- note' || chr(10) ||
  'b = spark.sql(f@Q3@SELECT * FROM v_a' || chr(10) || '-- FROM wh.hidden' || chr(10) || 'JOIN wh.dim d ON 1=1@Q3@)' || chr(10) ||
  'b.createOrReplaceTempView("v_b")' || chr(10) ||
  CASE p_partkey % 4
    WHEN 0 THEN 'DeltaTable.forName(spark, "wh.h_' || CAST(p_size AS STRING) || '").merge()'
    WHEN 1 THEN 'small = spark.table("WH.dim")' || chr(10) || 'small.createOrReplaceTempView("v_small")'
    WHEN 2 THEN 'x = spark.read.parquet(''/data/none_' || CAST(p_size AS STRING) || ''')' || chr(10) || 'spark.sql("CREATE OR REPLACE TABLE wh.made AS SELECT * FROM x")'
    ELSE 'smtplib.SMTP("h")' || chr(10) || 'subprocess.run(["ls"])' || chr(10) || 'b.write.saveAsTable(''wh.t' || CAST(p_size AS STRING) || ''')' END AS source
FROM part
"""

# Sizes of what those scripts read.
FIXTURES["fx_table_sizes"] = """
SELECT DISTINCT 'wh.t' || CAST(p_size AS STRING) AS name, CAST(p_size AS BIGINT) * 12345678 AS size_bytes FROM part
UNION ALL
SELECT DISTINCT 'wh.src_' || CAST(p_size AS STRING), CASE WHEN p_size % 7 = 0 THEN CAST(-1 AS BIGINT) ELSE CAST(p_size AS BIGINT) * 7654321 END FROM part
UNION ALL
SELECT 'wh.dim', count(*) * 1234 FROM part
"""

FIXTURES["fx_path_sizes"] = """
SELECT DISTINCT '/data/p_' || CAST(p_size AS STRING) || '/' AS path,
  CASE WHEN p_size % 5 = 0 THEN CAST(-1 AS BIGINT) ELSE CAST(p_size AS BIGINT) * 9876543 END AS size_bytes
FROM part
"""

# Proposals with the script they are about; @SHA256(x)@ is each engine's hash.
FIXTURES["fx_state"] = """
SELECT p.proposal_id, p.job_id, p.task_key, p.created_ts, p.duration_original_s, p.v2_path, p.status, p.analysis,
  '/jobs/' || CAST(p.job_id AS STRING) || '/' || p.task_key AS original_path,
  CASE WHEN p.original_source_hash = 'stale-hash' THEN p.original_source_hash
       WHEN length(p.proposal_id) % 3 = 0 AND p.proposal_id LIKE '%7' THEN ''
       ELSE @SHA256(s.source)@ END AS stored_hash,
  CASE WHEN p.proposal_id LIKE '%0' OR p.proposal_id LIKE '%4' THEN 'green' ELSE 'yellow' END AS tier,
  CASE WHEN p.proposal_id LIKE '%2_' THEN 'smoke_failed' WHEN p.proposal_id LIKE '%3_' THEN 'smoke_passed'
       WHEN p.proposal_id LIKE '%4_' THEN 'failed' WHEN p.proposal_id LIKE '%5_' THEN 'skipped'
       WHEN p.proposal_id LIKE '%6_' THEN 'schema_mismatch' WHEN p.proposal_id LIKE '%7_' THEN 'data_mismatch'
       ELSE 'passed' END AS validation_status,
  CASE WHEN p.proposal_id LIKE '%8' THEN 'old note' END AS notes
FROM fx_proposals p LEFT JOIN fx_scripts s
  ON s.path = '/jobs/' || CAST(p.job_id AS STRING) || '/' || p.task_key
"""

# What happened to each proposal so far.
FIXTURES["fx_events"] = """
SELECT proposal_id, created_ts AS event_ts, 0 AS seq, 'proposed' AS status, 'agent' AS actor, CAST(NULL AS STRING) AS notes FROM fx_state
UNION ALL
SELECT proposal_id, created_ts, 1, status, 'user1@example.com', notes FROM fx_state WHERE status <> 'proposed'
"""

# Several decisions on one proposal: each decision, and for some a second and
# a third one after it.
FIXTURES["fx_decision_log"] = """
SELECT proposal_id, action, actor, decided_ts, notes FROM fx_decisions
UNION ALL
SELECT proposal_id, 'rollback', 'user9@example.com', decided_ts + INTERVAL '1' DAY, CAST(NULL AS STRING) FROM fx_decisions WHERE proposal_id LIKE '%2' OR proposal_id LIKE '%6'
UNION ALL
SELECT proposal_id, 'approve', 'user8@example.com', decided_ts + INTERVAL '2' DAY, 'again' FROM fx_decisions WHERE proposal_id LIKE '%6' OR proposal_id LIKE '%8'
UNION ALL
SELECT proposal_id || 'x', action, actor, decided_ts, notes FROM fx_decisions WHERE proposal_id LIKE '%44'
"""

# A response for a script each, spread over all scripts.
FIXTURES["fx_script_responses"] = """
SELECT CAST(response_id AS BIGINT) AS response_id, CAST(response_id % (SELECT count(*) FROM part) AS BIGINT) AS script_id, raw FROM fx_responses
"""

# Both kinds of scripts, and prose as scripts of one cell.
FIXTURES["fx_all_scripts"] = """
SELECT 's' || CAST(script_id AS STRING) AS script_id, path, source FROM fx_scripts
UNION ALL
SELECT 'l' || CAST(script_id AS STRING), path, source FROM fx_lineage_scripts
UNION ALL
SELECT 'd' || CAST(doc_id AS STRING), '/docs/' || CAST(doc_id AS STRING), text FROM documents
UNION ALL
SELECT 'p' || CAST(page_id AS STRING), url, html FROM pages
"""

# A listing of files, and tables that lie in its folders or nowhere.
FIXTURES["fx_files"] = """
SELECT '/data/' || source || '/' || lang || '+x/a%41 ' || CAST(doc_id AS STRING) || '.bin' AS path, n_chars AS length FROM documents
UNION ALL
SELECT '/wh/t' || CAST(p_size AS STRING) || '/jobs/wh/part-' || CAST(p_partkey AS STRING), CAST(p_partkey AS BIGINT) FROM part
"""

FIXTURES["fx_roots"] = """
SELECT DISTINCT 'Docs.' || source AS name, '/data/' || source AS root FROM documents
UNION ALL
SELECT DISTINCT 'docs.' || source || '_' || lang, 'hdfs://host:8020/data/' || source || '/' || lang || '+x/' FROM documents
UNION ALL
SELECT 'wh.t' || CAST(p_size AS STRING) || '_' || CAST(p_partkey AS STRING),
  CASE p_partkey % 3 WHEN 0 THEN '/wh/t' || CAST(p_size AS STRING) WHEN 1 THEN '/wh/t' || CAST(p_size AS STRING) || '/jobs/' ELSE '/wh/t' || CAST(p_partkey AS STRING) || 'x' END FROM part
"""

# All texts a batch of decisions may need: scripts, new scripts, and backups but
# for a few that got lost.
FIXTURES["fx_texts"] = """
SELECT path, source FROM fx_scripts
UNION ALL
SELECT v2_path, 'new text of ' || proposal_id FROM fx_proposals WHERE v2_path IS NOT NULL
UNION ALL
SELECT 'b/' || proposal_id, 'old text of ' || proposal_id FROM fx_applied WHERE proposal_id NOT LIKE '%71'
"""
