import hashlib
import re

import pytest
from pyspark.sql import functions as F

from pipewise.llm import fingerprints as fp


def pieces(text):
    return set(re.findall(r"[^\n]{1,160}", text))


def alike(a, b):
    a, b = pieces(a), pieces(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def brute(pairs):
    """Rows of (id, text), ids distinct."""
    rows = sorted(((i, t or "") for i, t in pairs), reverse=True)
    out = {}
    for (i, text), (_, after) in zip(rows, rows[1:] + rows[:1]):
        k = len(text) // 3
        edited = text[: len(text) - k] + after[:k]
        sha = hashlib.sha256(edited.encode()).hexdigest()
        out[i] = (len(text), sha, alike(text, edited), alike(text, after), text, edited)
    return out


def same(rows, want):
    for r in rows:
        n, sha, near_edited, near_next, text, edited = want[r.doc_id]
        assert r.n_chars == n and hashlib.sha256(r.edited.encode()).hexdigest() == sha
        assert r.near_edited == pytest.approx(near_edited)
        assert r.near_next == pytest.approx(near_next)
        assert (r.fingerprint == r.edited_fingerprint) == (text == edited)


def test_whole_table(table):
    docs = table("documents").limit(120)
    want = brute([(r.doc_id, r.text) for r in docs.collect()])
    rows = fp.compare_versions(docs).collect()
    assert len(rows) == len(want)
    same(rows, want)


def test_awkward_rows(docs_of):
    pairs = [(1, None), (2, ""), (9, "a"), (40, "ab"), (41, "abc"), (10**12, "é𝄞\n" * 50)]
    pairs += [(-5, "".join(f"line {k}\n" for k in range(3000))), (-6, "x" * 50000), (7, "same"), (8, "same")]
    docs = docs_of(pairs)
    rows = fp.compare_versions(docs).collect()
    assert len(rows) == len(pairs)
    same(rows, brute(pairs))
    prints = {r.doc_id: r.fingerprint for r in rows}
    assert prints[7] == prints[8] and prints[1] == prints[2]


def test_repeated_rows_and_rows_without_id(docs_of):
    pairs = [(1, "one\ntwo"), (1, "one\ntwo"), (2, "three"), (None, "four five six"), (None, None)]
    rows = fp.compare_versions(docs_of(pairs)).collect()
    assert sorted((r.doc_id or 0, r.n_chars) for r in rows) == [(0, 0), (0, 13), (1, 7), (1, 7), (2, 5)]
    assert {r.edited for r in rows if r.doc_id is None} == {"", "four five"}
    assert {r.edited for r in rows if r.doc_id == 1} == {"one\ntth"}
    assert fp.compare_versions(docs_of([])).collect() == []
    (only,) = fp.compare_versions(docs_of([(3, "abcdef")])).collect()
    assert only.edited == "abcdab" and only.near_next == 1


def test_peeling_recovers_or_says_stuck(spark):
    rows = [(list(range(100, 100 + n)), list(range(100 + n // 3, 100 + n + n // 3))) for n in (0, 3, 12, 60)]
    df = spark.createDataFrame(rows, "a array<bigint>, b array<bigint>")
    cells = F.lit(24)
    found = fp.peel(fp.subtract(fp.sketch(F.col("a"), cells), fp.sketch(F.col("b"), cells)), cells)
    got = [r.d for r in df.select(found.alias("d")).collect()]
    assert [tuple(x) if x else None for x in got] == [(0, 0), (1, 1), (4, 4), None]
    exact = df.select(fp._in_sections(F.col("a"), F.col("b")).alias("d")).collect()
    assert [tuple(r.d) for r in exact] == [(0, 0), (1, 1), (4, 4), (20, 20)]
