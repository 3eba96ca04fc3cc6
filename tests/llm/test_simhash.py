import itertools
import random

import numpy as np
import pytest
import xxhash

from pipewise.llm import simhash
from pipewise.llm.components import components


def plain_fingerprint(text, size=3):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    runs = [words[i : i + size] for i in range(max(1, len(words) - size + 1))]
    hashes = [xxhash.xxh64_intdigest(b" ".join(r), 42) for r in runs]
    bits = [sum(h >> b & 1 for h in hashes) * 2 > len(hashes) for b in range(64)]
    return sum(1 << b for b, on in enumerate(bits) if on)


def plain_components(ids, prints, distance):
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    first = {}
    for i, p in zip(ids, prints):
        first.setdefault(p, i)
        a, b = find(i), find(first[p])
        root[max(a, b)] = min(a, b)
    values = np.array(list(first), np.uint64)
    for k, value in enumerate(values):
        for j in np.flatnonzero(np.bitwise_count(values[:k] ^ value) <= distance):
            a, b = find(first[int(value)]), find(first[int(values[j])])
            root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("radius", [1, 2, 3])
def test_every_pair_within_the_radius_shares_a_table(radius):
    masks = simhash.covering_masks(list(range(24)), radius)
    for bits in itertools.combinations(range(24), radius):
        change = sum(1 << b for b in bits)
        assert any(not mask & change for mask in masks)


def test_bit_order_and_majority():
    text = "One two  THREE\tfour five"
    assert int(simhash.signature(text.encode(), simhash.EXACT64)[0]) == plain_fingerprint(text)
    assert int(simhash.signature(b" \n", simhash.EXACT64)[0]) == 0


def edited(text, rng, n):
    words = text.split(" ")
    for _ in range(n):
        words[rng.randrange(len(words))] = rng.choice(["x", "yy", "zzz"])
    return " ".join(words)


def awkward(table):
    rng = random.Random(1)
    texts = [r.text for r in table("documents").select("text").limit(40).collect()]
    pairs = [(10 * k, t) for k, t in enumerate(texts)]
    pairs += [(5000 + k, edited(texts[k % 7], rng, 1 + k % 3)) for k in range(60)]
    pairs += [(9000, None), (9001, ""), (9002, " \n"), (9003, "word"), (9004, "WORD")]
    pairs += [(9005, "long " * 60000), (10, texts[1]), (9006, "É é"), (9007, "é É")]
    return pairs


def by_id(rows):
    return {r["id"]: r for r in rows}


@pytest.mark.parametrize("limit", [4096, 3])
def test_equals_brute_force(docs_of, table, limit):
    pairs = awkward(table)
    got = simhash.near_duplicates(docs_of(pairs), simhash.EXACT64, limit).collect()
    assert len(got) == len(pairs)
    prints = [plain_fingerprint(t) for _, t in pairs]
    want = plain_components([i for i, _ in pairs], prints, 3)
    for r in got:
        assert r["w0"] % (1 << 64) in [p for (i, _), p in zip(pairs, prints) if i == r["id"]]
        assert r["component"] == want[r["id"]]


def test_without_id_and_without_rows(docs_of):
    got = simhash.near_duplicates(docs_of([(None, "a b c"), (4, "a b c"), (None, "only")])).collect()
    assert sorted((r["id"] or 0, r["component"] or 0) for r in got) == [(0, 0), (0, 4), (4, 4)]
    assert simhash.near_duplicates(docs_of([])).collect() == []


def test_components_of_a_long_chain(spark):
    chain = [(k, k + 1) for k in range(0, 200)] + [(500, 400), (400, 450), (7, 7)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert all(got[k] == 0 for k in range(1, 201)) and got[500] == got[450] == 400
    assert 0 not in got and 400 not in got
