import hashlib
import random

import numpy as np
import pytest

from pipewise.llm import grams, substring_dedup, suffix_dedup


def brute(pairs, window, by_word, within):
    """Earliest place of every window, then the tokens that later places cover."""
    first = {}
    tokens = [((t or "").encode().split() if by_word else (t or "").encode()) for _, t in pairs]

    def name(ts, s):
        return tuple(ts[s : s + window]) if by_word else ts[s : s + window]

    for (i, _), ts in zip(pairs, tokens):
        if i is None:
            continue
        for s in range(len(ts) - window + 1):
            place = (i, s) if within else (i,)
            n = name(ts, s)
            if n not in first or place < first[n]:
                first[n] = place
    out = []
    for (i, _), ts in zip(pairs, tokens):
        gone = [False] * len(ts)
        if i is not None:
            for s in range(len(ts) - window + 1):
                if first[name(ts, s)] < ((i, s) if within else (i,)):
                    gone[s : s + window] = [True] * window
        kept = [t for t, g in zip(ts, gone) if not g]
        kept = b" ".join(kept) if by_word else bytes(kept)
        spans = sum(g and not p for g, p in zip(gone, [False, *gone]))
        out.append((i, len(ts), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def got(df):
    rows = df.collect()
    found = [
        (r.doc_id, r.n_tokens, r.n_removed, r.n_spans, hashlib.sha256(bytes(r.kept)).hexdigest())
        for r in rows
    ]
    return sorted(found, key=str)


def mosaic(rng, count):
    """Texts put together from shared and own stretches of words, some periodic."""
    words = ["a", "be", "cat", "dove", "eagle", "é", " x", "Fox,"]
    shared = [[rng.choice(words) + str(rng.randrange(40)) for _ in range(rng.randrange(5, 90))] for _ in range(8)]
    out = []
    for k in range(count):
        parts = []
        for _ in range(rng.randrange(1, 6)):
            kind = rng.randrange(4)
            if kind == 0:
                parts += [rng.choice(words)] * rng.randrange(1, 130)
            elif kind == 1:
                parts += [rng.choice(words) + str(rng.randrange(10**6)) for _ in range(rng.randrange(60))]
            else:
                whole = rng.choice(shared)
                parts += whole[rng.randrange(4) : len(whole) - rng.randrange(4)]
        out.append((k, rng.choice([" ", "\n", " \t "]).join(parts)))
    return out


def test_picks_depend_on_the_window_only():
    rng = np.random.default_rng(3)
    codes = rng.integers(0, 4, 400).astype(np.uint64)
    hashes = grams.rolling(codes, 5)
    place = grams.picked(hashes, 16)
    for s in range(len(place)):
        part = hashes[s : s + 16]
        assert place[s] == s + int(np.argmin(part))
    again = grams.rolling(codes[37:90], 5)
    assert (again == hashes[37 : 37 + len(again)]).all()


def test_word_codes_tell_words_apart():
    text = "The the a aa b c\x1cd é \t\x0b\x0c\r\n z".encode()
    buffer = np.frombuffer(text, np.uint8)
    starts, ends = grams.word_bounds(buffer)
    assert [text[a:b] for a, b in zip(starts, ends)] == text.split()
    assert len(set(grams.word_codes(buffer, starts, ends).tolist())) == len(text.split())


@pytest.mark.parametrize("seed, limit", [(1, 64), (2, 64), (3, 1), (4, 3)])
def test_words_equal_brute_force(docs_of, seed, limit):
    rng = random.Random(seed)
    pairs = mosaic(rng, 60)
    pairs += [(100 + k, pairs[k][1]) for k in range(6)]
    pairs += [(200, None), (201, ""), (202, " \n"), (5, pairs[5][1]), (None, pairs[3][1]), (203, "w " * 30000)]
    docs = docs_of(pairs).repartition(3)
    kind = substring_dedup.scheme(limit=limit)
    assert got(substring_dedup.remove_repeated_passages(docs, kind)) == brute(pairs, 50, True, False)


def test_words_whole_table(spark, sf):
    from pipewise.llm.queries import QUERIES

    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    want = brute([(r.doc_id, r.text) for r in docs], 50, True, False)
    rows = QUERIES["op10_substring_dedup"](spark, sf).collect()
    assert sorted((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in rows) == sorted(
        (i, n, m, k) for i, n, m, _, k in want
    )


def test_no_rows(docs_of):
    assert substring_dedup.remove_repeated_passages(docs_of([])).collect() == []


@pytest.mark.parametrize("seed, limit", [(5, 16384), (6, 2)])
def test_bytes_equal_brute_force(docs_of, seed, limit):
    rng = random.Random(seed)
    pairs = mosaic(rng, 40)
    pairs += [(100 + k, pairs[k][1]) for k in range(6)]
    pairs += [(200, None), (201, ""), (202, "é" * 70), (5, pairs[5][1]), (None, pairs[3][1])]
    pairs += [(203, "w " * 3000), (204, "x" * 99), (205, "x" * 100), (206, "\x00" * 150)]
    docs = docs_of(pairs).repartition(3)
    kind = suffix_dedup.scheme(limit=limit)
    assert got(suffix_dedup.remove_repeated_bytes(docs, kind)) == brute(pairs, 100, False, True)


def test_bytes_whole_table(spark, sf):
    from pipewise.llm.queries import QUERIES

    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    want = brute([(r.doc_id, r.text) for r in docs], 100, False, True)
    rows = QUERIES["op6_suffix_array_dedup"](spark, sf).collect()
    found = [(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows]
    assert sorted(found) == sorted(want)
