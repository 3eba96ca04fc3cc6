import hashlib
from collections import defaultdict

from pipewise.llm import line_dedup

WHITE = " \t\n\x0b\x0c\r"


def key_of(line):
    line = line.strip(WHITE)
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line)


def brute(pairs, min_docs, min_chars=1):
    holders = defaultdict(set)
    for i, t in pairs:
        for line in (t or "").split("\n"):
            holders[key_of(line)].add(i)
    out = []
    for i, t in pairs:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(key_of(x)) < min_chars or len(holders[key_of(x)]) < min_docs]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


def got(docs, min_docs):
    rows = line_dedup.line_verdicts(docs, min_docs).collect()
    return sorted([(r["row"]["doc_id"], r.n_lines, r.n_dropped, r.kept) for r in rows], key=str)


def test_equals_brute_force(docs_of, table):
    pairs = [(r.doc_id, r.text) for r in table("documents").collect()]
    assert got(docs_of(pairs), 3) == brute(pairs, 3)


def test_awkward_rows(docs_of):
    pairs = [(k, f"Same line \nown {k}\n\n\tsame LINE") for k in range(4)]
    pairs += [(10, None), (11, ""), (12, "same line"), (13, " same line"), (14, "É\né")]
    pairs += [(15, "\n".join(["same line", "x"] * 3000)), (0, pairs[0][1]), (0, "other\nsame line")]
    pairs += [(None, "same line\nz"), (None, "z")]
    assert got(docs_of(pairs), 3) == brute(pairs, 3)
    assert got(docs_of([]), 3) == []


def test_same_columns_and_new_lengths(docs_of):
    docs = docs_of([(k, f"head\nbody {k}") for k in range(12)])
    out = line_dedup.drop_repeated_lines(docs)
    assert out.columns == docs.columns
    assert {(r.text, r.n_chars, r["id"]) for r in out.collect()} == {
        (f"body {k}", len(f"body {k}"), "x") for k in range(12)
    }


def test_query_digest(spark, sf):
    from pipewise.llm.queries import QUERIES

    rows = QUERIES["op7_line_dedup"](spark, sf).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    want = {i: hashlib.sha256(t.encode()).hexdigest() for i, _, _, t in brute(texts.items(), 10)}
    assert {r.doc_id: r.kept_sha256 for r in rows} == want
