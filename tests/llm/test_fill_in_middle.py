import hashlib
import re

import pytest

from pipewise.llm import fill_in_middle

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def brute(doc_id, text, seed=42):
    text = text or ""
    units = UNIT.findall(text)
    assert "".join(units) == text
    digits = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digits[k : k + 8], 16) for k in range(0, 32, 8))
    n = len(units)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or re.search("<[PSM]>", text) or h3 % 100 >= 50:
        return doc_id, n, "plain", None, None, text
    if h4 % 100 < 80:
        return doc_id, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return doc_id, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


AWKWARD = [
    (0, None), (1, ""), (2, " "), (3, "one"), (4, " \n\ta b  c \r\n"), (5, "a<P>b c d"),
    (6, "x <S"), (7, "> <M y"), (8, "é ü \U0001f600 ñ"), (9, "x" * 5000), (10, "w x " * 5000),
    (11, "same text"), (11, "same text"), (11, "other text of one id"), (None, "no id at all"),
    (None, "no id at all"), (None, None), (-5, "below zero is an id"), (2**62, "a large id < > <<P"),
]


@pytest.mark.parametrize("size", [3, 64, 1 << 16])
def test_awkward_rows(docs_of, size):
    rows = [*AWKWARD, *[(k, f"t{k} <{'P' * (k % 3)} u >v\n w{k}") for k in range(100, 160)]]
    want = sorted([brute(i, t) for i, t in rows], key=str)
    docs = docs_of(rows)
    texts = fill_in_middle.examples(docs, size=size)
    assert sorted([tuple(r) for r in texts.collect()], key=str) == want
    assert {r[2] for r in want} == {"plain", "spm", "psm"}
    back = fill_in_middle.restore(texts, size=size).collect()
    assert sorted([tuple(r) for r in back], key=str) == sorted([(i, t or "") for i, t in rows], key=str)
    digests = [(*r[:5], sha(r[5])) for r in want]
    found = [tuple(r) for r in fill_in_middle.round_trip(docs, size=size).collect()]
    assert sorted([r[:6] for r in found], key=str) == sorted(digests, key=str)
    restored = sorted([(r[0], r[6]) for r in found], key=str)
    assert restored == sorted([(i, sha(t or "")) for i, t in rows], key=str)


def test_whole_table(table):
    rows = [(r.doc_id, r.text) for r in table("documents").collect()]
    found = {r.doc_id: r for r in fill_in_middle.round_trip(table("documents")).collect()}
    assert len(found) == len(rows)
    for i, text in rows:
        *want, output = brute(i, text)
        assert tuple(found[i]) == (*want, sha(output), sha(text or ""))


def test_no_rows(docs_of):
    empty = docs_of([])
    assert fill_in_middle.round_trip(empty).count() == 0
    assert fill_in_middle.restore(fill_in_middle.examples(empty)).count() == 0


def test_one_hot_row_spreads(docs_of):
    """Rows of one id, even wholly equal ones, are dealt to many tasks."""
    docs = docs_of([(1, "the same row")] * 400).repartition(4)
    dealt = fill_in_middle._sorted(fill_in_middle._pieces(docs, 42, 64), 8).glom().map(len).collect()
    assert max(dealt) < 2 * sum(dealt) / len(dealt)


def test_pieces_are_whole_units():
    text = b"aa bb cc dd " * 40 + b"x" * 500 + b" tail"
    ends = fill_in_middle.unit_ends(text)
    pieces = list(fill_in_middle._chunks(text, ends, 0, len(text), 64))
    assert b"".join(pieces) == text and max(map(len, pieces)) <= 64
    cuts = {sum(map(len, pieces[:k])) for k in range(1, len(pieces))}
    within = {c for c in cuts if c not in set(ends.tolist())}
    assert all(text[c - 1 : c + 1] == b"xx" for c in within)
