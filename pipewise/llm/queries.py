"""The registered queries of the text operators, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from pipewise.llm import (
    cross_polytope,
    decontamination,
    fill_in_middle,
    fingerprints,
    html_text,
    importance_resampling,
    line_dedup,
    packing,
    quality,
    simhash,
    substring_dedup,
    suffix_dedup,
    toxicity,
)
from pipewise.llm.shared import read, tokenizer_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return add


@query("op1_simhash_near_dedup")
def op1(spark, sf_dir):
    found = simhash.near_duplicates(read(spark, sf_dir, "documents"), simhash.EXACT64)
    return found.select(
        F.col("id").alias("doc_id"),
        F.lower(F.lpad(F.hex("w0"), 16, "0")).alias("fingerprint"),
        F.col("component").alias("component_id"),
    )


@query("op2_benchmark_decontamination")
def op2(spark, sf_dir):
    docs, items = read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")
    return decontamination.contaminated(docs, items)


@query("op3_document_fingerprints")
def op3(spark, sf_dir):
    found = fingerprints.compare_versions(read(spark, sf_dir, "documents"))
    return found.withColumn("edited_sha256", F.sha2("edited", 256)).drop("edited")


@query("op4_html_extraction")
def op4(spark, sf_dir):
    return html_text.extract_main_text(read(spark, sf_dir, "pages"))


def _scored(scores: DataFrame, held_out, threshold: float) -> DataFrame:
    return scores.select(
        F.col("id").alias("doc_id"),
        held_out(F.col("id")).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )


@query("op5_toxicity")
def op5(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    model = toxicity.fit(docs, read(spark, sf_dir, "labels"))
    scores = toxicity.score_toxicity(docs, model)
    return _scored(scores, toxicity.held_out, toxicity.THRESHOLD)


@query("op9_quality_classifier")
def op9(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    model = quality.fit(docs, read(spark, sf_dir, "labels"))
    scores = quality.score_quality(docs, model)
    return _scored(scores, quality.held_out, quality.THRESHOLD)


@query("op6_suffix_array_dedup")
def op6(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    return suffix_dedup.remove_repeated_bytes(docs).select(
        "doc_id",
        F.col("n_tokens").alias("n_bytes"),
        "n_removed",
        "n_spans",
        F.sha2("kept", 256).alias("kept_sha256"),
    )


LINES_SQL = """
WITH split AS (
  SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS a FROM documents
), lines AS (
  SELECT doc_id, unnest(range(len(a))) AS pos, unnest(a) AS line FROM split
), keyed AS (
  SELECT doc_id, pos, line,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS line_key
  FROM lines
), frequent AS (
  SELECT line_key FROM keyed WHERE length(line_key) >= 1
  GROUP BY line_key HAVING count(DISTINCT doc_id) >= 10
), marked AS (
  SELECT k.*, f.line_key IS NOT NULL AS dropped
  FROM keyed k LEFT JOIN frequent f ON k.line_key = f.line_key
)
SELECT doc_id, count(*) AS n_lines,
       CAST(sum(CASE WHEN dropped THEN 1 ELSE 0 END) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), ''))
         AS kept_sha256
FROM marked GROUP BY doc_id
"""


@query("op7_line_dedup", LINES_SQL)
def op7(spark, sf_dir):
    return line_dedup.line_verdicts(read(spark, sf_dir, "documents")).select(
        F.col("row.doc_id").alias("doc_id"),
        "n_lines",
        "n_dropped",
        F.sha2("kept", 256).alias("kept_sha256"),
    )


@query("op8_packing")
def op8(spark, sf_dir):
    return packing.pack_documents(read(spark, sf_dir, "documents"), tokenizer_path())


@query("op10_substring_dedup")
def op10(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    return substring_dedup.remove_repeated_passages(docs).select(
        "doc_id",
        F.col("n_tokens").alias("n_words"),
        "n_removed",
        F.sha2("kept", 256).alias("kept_sha256"),
    )


@query("op11_approximate_nearest_neighbours")
def op11(spark, sf_dir):
    return cross_polytope.nearest_neighbours(read(spark, sf_dir, "embeddings"))


MIDDLE_SQL = r"""
WITH cut AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || doc_id) AS digest,
         regexp_extract_all(coalesce(text, ''),
           '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS units
  FROM documents
), drawn AS (
  SELECT *, CAST(len(units) AS BIGINT) AS n,
         CAST('0x' || substr(digest, 1, 8) AS BIGINT) AS h1,
         CAST('0x' || substr(digest, 9, 8) AS BIGINT) AS h2,
         CAST('0x' || substr(digest, 17, 8) AS BIGINT) AS h3,
         CAST('0x' || substr(digest, 25, 8) AS BIGINT) AS h4
  FROM cut
), placed AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>')
                OR contains(text, '<M>') OR h3 % 100 >= 50 THEN 'plain'
              WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
  FROM drawn
), parts AS (
  SELECT *, coalesce(array_to_string(units[1:a], ''), '') AS p,
         coalesce(array_to_string(units[a + 1:b], ''), '') AS m,
         coalesce(array_to_string(units[b + 1:n], ''), '') AS s
  FROM placed
)
SELECT doc_id, n, form,
       CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text
                        WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
                        ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM parts
"""


@query("op12_fill_in_middle", MIDDLE_SQL)
def op12(spark, sf_dir):
    return fill_in_middle.round_trip(read(spark, sf_dir, "documents"))


@query("op13_importance_resampling")
def op13(spark, sf_dir):
    docs, target = read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")
    return importance_resampling.resample(docs, target)


@query("pipeline")
def pipeline(spark, sf_dir):
    return corpus_pipeline.run(spark, sf_dir)
