import random
from collections import Counter
from itertools import accumulate

import pytest
from tokenizers import Tokenizer

from pipewise.llm import packing
from pipewise.llm.shared import tokenizer_path


@pytest.fixture(scope="module")
def plain():
    tokenizer = Tokenizer.from_file(tokenizer_path())
    tokenizer.encode_special_tokens = True
    return lambda text: tokenizer.encode(text or "", add_special_tokens=False).ids


ODD = ["", "  ", " a", "a ", "a  b", "...", "a...b", "***. foo", "\n\nfoo", ",,", "a b", "\x1f ,",
       "it's, 5.4\n- x_.y", "é́.", "½.", "a\tb", "foo.\n", "<|endoftext|> a", "日本。本, 語.", " ."]


def test_ids_equal_those_of_the_whole_text(plain, table):
    texts = ODD + [r.text for r in table("documents").select("text").collect()]
    tokens = packing.PieceTokenizer(tokenizer_path())
    for _ in range(2):
        assert [x.tolist() for x in tokens.encode(texts)] == [plain(t) for t in texts]


def test_counts_come_closest():
    rng = random.Random(5)
    for _ in range(100):
        counts = {rng.randrange(1, 60): rng.randrange(1, 4) for _ in range(rng.randrange(1, 6))}
        space = rng.randrange(1, 100)
        sums = {0}
        for length, count in counts.items():
            sums = {s + length * k for s in sums for k in range(count + 1) if s + length * k <= space}
        picked = packing.closest_counts(counts, space)
        assert sum(length * k for length, k in picked.items()) == max(sums)
        assert all(k <= counts[length] for length, k in picked.items())


def check(rows, texts, plain):
    import zlib

    import numpy as np

    want = {i: plain(t) + [1] for i, t in texts.items()}
    own, windows = {}, {}
    for r in rows:
        own.setdefault(r.doc_id, []).append(r)
        windows.setdefault(r.sequence_id, []).append(r)
    assert set(own) == set(want)
    for i, pieces in own.items():
        at = 0
        for r in sorted(pieces, key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(want[i])
            ids = np.array(want[i][at : at + r.length], "<u4")
            assert len(ids) == r.length and zlib.crc32(ids.tobytes()) == r.ids_crc32
            at += r.length
        assert at == len(want[i])
    for pieces in windows.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at == 2048 or (at < 2048 and at & (at - 1) == 0)


def test_whole_table(spark, table, plain):
    docs = table("documents")
    texts = {r.doc_id: r.text for r in docs.collect()}
    check(packing.pack_documents(docs.repartition(3), tokenizer_path()).collect(), texts, plain)
    check(packing.pack_documents(docs, tokenizer_path(), pool=4).collect(), texts, plain)


def test_awkward_rows(docs_of, plain):
    texts = {1: None, 2: "", 3: "long words " * 50000, 4: "a", 5: "b", 6: "x" * 3000}
    check(packing.pack_documents(docs_of(list(texts.items())), tokenizer_path()).collect(), texts, plain)
    assert packing.pack_documents(docs_of([]), tokenizer_path()).collect() == []
    again = packing.pack_documents(docs_of([(7, "a b"), (7, "a b"), (None, "c")]), tokenizer_path())
    rows = again.collect()
    # cut anywhere: the two rows under one id hold every one of their ids, each in one piece
    assert sum(r.length for r in rows if r.doc_id is None) == 2
    taken = Counter(k for r in rows if r.doc_id == 7 for k in range(r.start, r.start + r.length))
    assert taken == {0: 2, 1: 2, 2: 2}
    windows = {}
    for r in rows:
        windows.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in windows.values():
        assert [o for o, _ in sorted(pieces)] == [*accumulate([0, *[n for _, n in sorted(pieces)]])][:-1]
        total = sum(n for _, n in pieces)
        assert total & (total - 1) == 0
