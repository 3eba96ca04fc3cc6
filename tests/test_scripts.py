"""Script operators against plain Python on small, awkward texts."""

import random
import re

import pytest
from pyspark.sql import functions as F

from pipewise.functions import cells, responses, scan, text
from pipewise.functions import fixed_values as fixed
from pipewise.operators import changes, corpus

PIECES = [
    "df = spark.read.table('wh.a')", 'spark.table("WH.b")', "spark.sql('SELECT 1 FROM wh.a')",
    "FROM wh.c JOIN wh.d", "from os import path", "import re", "# FROM wh.hidden", "   -- x",
    "INSERT INTO wh.t", "INSERT OVERWRITE TABLE wh.t2 SELECT", "merge into Wh.T3", "MERGE\nINTO a.b.c",
    "CREATE OR REPLACE TABLE wh.e", "create table if not exists wh.f", "x.saveAsTable( 'wh.t' )",
    "DeltaTable.forName(spark, 'wh.g')", "requests.post (u)", "smtp", "hooks.slack", "q.start()",
    "\t# tab", "\x1f# unit", " # nbsp", "é = 1", "ſpark.table('wh.s')", "",
    "insert into nodot", "spark.read.parquet('/a/b/')", "spark.read.x.parquet(\"/c\")",
]


def corpus_rows(n=300):
    rng = random.Random(7)
    ends = ["\n", "\n", "\n", "\r\n", "\r", "\x0b", " "]
    return [
        (i, f"/p{i}", "".join(rng.choice(PIECES) + rng.choice(ends) for _ in range(rng.randrange(6))))
        for i in range(n)
    ]


def code_of(source, imports=False):
    keep = []
    for line in source.splitlines():
        body = line.lstrip()
        if body.startswith(("#", "--")):
            continue
        if imports and re.match(r"\s*(from\s+\S+\s+import|import\s+)", line):
            continue
        keep.append(line)
    return "\n".join(keep)


def found(patterns, code):
    return {m for _, p in patterns for m in re.findall(p, code, re.IGNORECASE)}


def test_scans_equal_python(spark):
    rows = corpus_rows()
    df = spark.createDataFrame(rows, "script_id int, path string, source string")
    scanned = {r.script_id: r for r in corpus.scan_scripts(df).collect()}
    inputs = {r.script_id: r for r in corpus.read_inputs(df).collect()}
    for i, _, source in rows:
        code, sizing = code_of(source), code_of(source, imports=True)
        targets = sorted(t for t in found(fixed.TARGET_PATTERNS, code) if "." in t)
        reads = {t.lower() for t in found(fixed.STRICT_READ_PATTERNS, code) if "." in t}
        effects = [x for x, _, p in fixed.SIDE_EFFECTS if re.search(p, source, re.IGNORECASE)]
        own = [t for t in targets if t.lower() in reads]
        got = scanned[i]
        assert got.target_tables == targets, source
        assert set(got.read_tables) == reads, source
        assert got.side_effects == effects, source
        assert got.self_reference == own, source
        assert (got.tier == "green") == (bool(targets) and not effects and not own)
        assert inputs[i].read_tables == sorted(
            {t.lower() for t in found(fixed.READ_PATTERNS, sizing) if "." in t}
        ), source
        assert inputs[i].read_paths == sorted(found(fixed.READ_PATH_PATTERNS, sizing)), source


def test_size_rule_comes_first(spark):
    df = spark.createDataFrame(
        [(1, "/a", "requests.post(x)" + " " * 1200)], "script_id int, path string, source string"
    )
    row = corpus.scan_scripts(df, cap=1000).first()
    assert row.tier == "yellow"
    assert row.reason.startswith("notebook too large (1,216 chars > 1,000)")


def test_extra_target_patterns(spark):
    df = spark.createDataFrame(
        [(1, "/a", "CREATE TABLE IF NOT EXISTS wh.e (a INT)")],
        "script_id int, path string, source string",
    )
    extra = [("exists", r"IF\s+NOT\s+EXISTS\s+([a-zA-Z0-9_.]+)")]
    assert corpus.scan_scripts(df).first().target_tables == []
    assert corpus.scan_scripts(df, extra_targets=extra).first().target_tables == ["wh.e"]


def test_suffix_goes_target_by_target(spark):
    source = "a('wh.t'); wh.t2 wh.t\nx(\"wh.t.\") s.wh.t c.s.t"
    df = spark.createDataFrame([(source, ["wh.t", "wh.t.", "c.s.t"])], "s string, t array<string>")
    got = df.select(scan.suffix_targets(F.col("s"), F.col("t"), "9").alias("x")).first().x
    want = source
    for t in ["wh.t", "wh.t.", "c.s.t"]:
        new = "scratch." + t.partition(".")[2] + "_test_9"
        for q in "'\"":
            want = want.replace(q + t + q, q + new + q)
        want = re.sub(r"\b" + re.escape(t) + r"\b", new, want)
    assert got == want
    with pytest.raises(ValueError):
        scan.suffix_targets(F.col("s"), F.col("t"), "9$1")


MARK = fixed.CELL_MARKER
CELLS = ["# DBTITLE 1, Load  \nx = 1\n", "\n", "\n# note\n  y = 2  \n", "#  DBTITLE  2 ,A b\n", "z" * 80,
         "# DBTITLE 1,   \n", "print(1)\n", "", "# DBTITLE 1,\nnext line"]


def scripts(n=120):
    rng = random.Random(3)
    return [(i, MARK.join(rng.choice(CELLS) for _ in range(rng.randrange(1, 6)))) for i in range(n)]


def title(cell):
    m = re.search(fixed.CELL_TITLE, cell)
    return m and m.group(1).strip()


def name_of(cell):
    if title(cell) is not None:
        return "# DBTITLE 1," + title(cell)
    code = [x.strip() for x in cell.splitlines() if x.strip() and not x.strip().startswith("#")]
    return f"(unnamed — preview: {code[0][:50]})" if code else "(empty cell)"


def shortened(source, cap):
    if len(source) <= cap:
        return source
    parts = source.split(MARK)
    bones = [
        f"\n# DBTITLE 1,{'(unnamed)' if title(c) is None else title(c)}\n"
        "# [cell omitted by smart truncation]\n"
        for c in parts
    ]
    left = cap - sum(len(b) + len(MARK) for b in bones)
    first = len(parts)
    while first > 0 and left >= len(parts[first - 1]):
        first -= 1
        left -= len(parts[first])
    n = len(parts) - first
    return MARK.join(bones[:first] + parts[first:]) + (
        f"\n# [SMART TRUNCATION: {n}/{len(parts)} cells full (last ones), "
        f"{first} summarized. Total original: {len(source):,} chars]"
    )


def test_cells_equal_python(spark):
    rows = scripts()
    df = spark.createDataFrame(rows, "script_id int, source string")
    index = {r.script_id: r.cell_index for r in changes.cell_index(df).collect()}
    back = {r.script_id: r.s for r in df.select(
        "script_id", cells.join_cells(cells.split_cells(F.col("source"))).alias("s")).collect()}
    for i, source in rows:
        parts = source.split(MARK)
        assert index[i] == "\n".join(f"  idx_{k}: {name_of(c)}" for k, c in enumerate(parts))
        assert back[i] == source
    for cap in (0, 150, 260, 400, 10000):
        got = {r.script_id: r.source for r in changes.truncate_scripts(df, cap).collect()}
        for i, source in rows:
            assert got[i] == shortened(source, cap), (cap, source)


def norm(s):
    return re.sub(r"\s+", " ", s).strip().lower()


def where(parts, cell_id):
    m = re.match(r"idx_(\d+)", cell_id.strip(), re.IGNORECASE)
    if m and int(m.group(1)) < len(parts):
        return 0, int(m.group(1))
    for i, c in enumerate(parts):
        if norm(cell_id) in norm(c):
            return 1, i
    words = set(norm(cell_id).split())
    for i, c in enumerate(parts):
        if sum(w in norm(c) for w in words) / len(words) >= 0.6:
            return 2, i
    return None, None


def test_changes_equal_python(spark):
    rng = random.Random(5)
    ids = ["idx_0", "IDX_2: x", "idx_99", "idx_99999999999999999999", "load", "  Load   x", "print(1)",
           "a b q", "y w v u z", "nothing here", " ", None, "x = 1 or so", "idx_"]
    codes = ["new 1", " new 2\n", "", None, "new 3"]
    rows = []
    for i, source in scripts(200):
        asked = [(rng.choice(ids), rng.choice(codes)) for _ in range(rng.randrange(5))]
        rows.append((i, i, source, asked))
    schema = "response_id int, script_id int, source string, changes array<struct<cell_id:string,new_code:string>>"
    df = spark.createDataFrame(rows, schema)
    chosen = df.select("response_id", "script_id", "changes", F.lit("changes").alias("kind"),
                       F.lit("").alias("whole_script"), F.lit("{}").alias("analysis"))
    texts = df.select("script_id", "source")
    matched = {}
    for r in changes.match_changes(chosen, texts).collect():
        matched[(r.response_id, r.change_pos)] = (r.match_level, r.cell_pos)
    rebuilt = {r.response_id: r for r in changes.rebuild_scripts(chosen, texts).collect()}
    for i, _, source, asked in rows:
        parts = source.split(MARK)
        result = list(parts)
        for k, (cell_id, code) in enumerate(asked):
            if not (cell_id or "").strip() or not (code or "").strip():
                assert (i, k) not in matched
                continue
            level, pos = where(parts, cell_id)
            assert matched[(i, k)] == (level, pos), (source, cell_id)
            if pos is not None:
                result[pos] = "\n\n" + code.strip() + "\n\n"
        if asked:
            assert rebuilt[i].rewrite == MARK.join(result)
            assert rebuilt[i].no_change == (
                not rebuilt[i].rewrite.strip() or rebuilt[i].rewrite.strip() == source.strip()
            )


RESPONSES = [
    ('{"changes": [{"cell_id": "a", "new_code": "b"}]}', 1, "changes"),
    ('{"cambios": [{"celda_id": "a", "codigo_nuevo": "b"}]}', 1, "changes"),
    ('\n```json\n{"changes": []}\n```  ', 2, "none"),
    ('```\n{"optimized_code": " x "}\n```', 2, "whole_script"),
    ('Sure.\n```json\n{"codigo_optimizado": "x"}\n```\nBye', 3, "whole_script"),
    ('Well {"optimized_code": "  "} bye', 4, "none"),
    ("no json", 0, "none"), ("", 0, "none"), (None, 0, "none"), ("{bad", 0, "none"),
    ("[1, 2]", 1, "none"), ('"text {} "', 1, "none"), ("null", 1, "none"), ("12", 1, "none"),
]


def test_responses(spark):
    df = spark.createDataFrame(
        [(i, i, raw) for i, (raw, _, _) in enumerate(RESPONSES)],
        "response_id int, script_id int, raw string",
    )
    got = {r.response_id: r for r in changes.choose_rewrite(changes.parse_responses(df)).select(
        "response_id", "method", "parsed", "kind", "changes").collect()}
    for i, (raw, method, kind) in enumerate(RESPONSES):
        assert (got[i].method, got[i].kind) == (method, kind), raw
        assert got[i].parsed == ("{" in (raw or "") and method > 0 and not raw.startswith('"')), raw
    assert got[0].changes[0].cell_id == got[1].changes[0].cell_id == "a"


def test_analysis_keys_in_two_languages(spark):
    rows = [
        ('{"changes_applied":[{"description":"x","estimated_savings":"HIGH"}]}',),
        ('{"cambios_aplicados":[{"descripcion":"x","ahorro_estimado":"Alto"}]}',), ("{bad",), (None,),
        ("{}",),
    ]
    df = spark.createDataFrame(rows, "a string")
    got = [r.c for r in df.select(responses.applied_changes_of(F.col("a")).alias("c")).collect()]
    assert [[tuple(c) for c in cs] for cs in got] == [[("x", "high")], [("x", "alto")], [], [], []]


def test_blank_and_fold(spark):
    blank = "".join(chr(c) for c in range(0x110000) if chr(c).isspace())
    row = spark.createDataFrame([(blank, "İSKıſ")], "a string, b string").select(
        text.is_blank(F.col("a")), text.fold(F.col("b")).contains("isk")
    ).first()
    assert tuple(row) == (True, True)


def test_repeated_keys_and_loose_numbers(spark):
    import json

    texts = [
        '{"optimized_code": "first", "optimized_code": "last"}',
        '{"a": {"b": 1, "b": 2, "b": 3}, "optimized_code": "x"}',
        '{"analysis": {"x": NaN, "y": [Infinity, -Infinity, -1], "z": "NaN \\" Infinity"}, "optimized_code": "N"}',
        'text {"optimized_code": "Infinity -Infinity NaN", "n": NaN} more',
        '{"optimized_code": "open, NaN}',
        '{"n": NaNs}',
        '{"n": -Infinity, "optimized_code": "' + "a \\\\ b" * 20000 + '"}',
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "response_id int, raw string")
    rows = changes.choose_rewrite(changes.parse_responses(df)).select(
        "response_id", "method", "parsed", "whole_script", "analysis", F.col("doc").cast("string").alias("doc")
    )
    got = {r.response_id: r for r in rows.collect()}
    assert got[0].whole_script == "last" and got[1].whole_script == "x"
    assert json.loads(got[2].analysis) == {"x": "NaN", "y": ["Infinity", "-Infinity", -1], "z": 'NaN " Infinity'}
    assert got[3].whole_script == "Infinity -Infinity NaN" and got[3].method == 4
    assert not got[4].parsed and not got[5].parsed
    assert got[6].whole_script == json.loads(texts[6].replace("-Infinity", "0"))["optimized_code"]
    assert spark.conf.get("spark.sql.variant.allowDuplicateKeys") == "false"
