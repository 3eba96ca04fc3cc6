import random

import numpy as np
import pytest

from pipewise.llm import near_copies


def plain_sets(pairs, size=5):
    out = {}
    for i, text in pairs:
        words = (text or "").lower().split()
        runs = [tuple(words[k : k + size]) for k in range(max(1, len(words) - size + 1))]
        out[i] = set(runs) if words else set()
    return out


def similar_pairs(pairs, similarity):
    """Pairs of ids of true Jaccard similarity."""
    sets = plain_sets(pairs)
    holders = {}
    for i in sorted(sets):
        for run in sets[i]:
            holders.setdefault(run, []).append(i)
    both = {}
    for ids in holders.values():
        for k, j in enumerate(ids):
            for i in ids[:k]:
                both[i, j] = both.get((i, j), 0) + 1
    found = {
        (i, j) for (i, j), n in both.items()
        if n >= similarity * (len(sets[i]) + len(sets[j]) - n) - 1e-9
    }
    empty = sorted(i for i in sets if not sets[i])
    return found | {(empty[0], j) for j in empty[1:]}


def groups(ids, links):
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def recall_of(found, pairs, similarity=0.8):
    """Nothing below the similarity is linked; the share of pairs above that is."""
    true = similar_pairs(pairs, similarity)
    want = groups([i for i, _ in pairs], true)
    assert set(found) == set(want)
    assert all(want[i] == want[c] for i, c in found.items())
    return sum(found[i] == found[j] for i, j in true) / len(true) if true else 1


def around(low, high, rng, ids):
    """Pairs of texts of similarities between the two."""
    out = []
    for i in ids:
        words = [f"w{rng.randrange(10**6)}" for _ in range(rng.choice([60, 150, 300]))]
        share = rng.uniform(low, high)
        n = len(words) - 4
        tail = round(n * (1 - share) / (1 + share))
        other = words[: len(words) - tail] + [f"v{rng.randrange(10**6)}" for _ in range(tail)]
        out += [(i, " ".join(words)), (i + 1, " ".join(other))]
    return out


def components(df):
    return {r["id"]: r["component"] for r in df.collect()}


@pytest.mark.parametrize("low,high,recall", [(0.8, 0.84, 0.88), (0.8, 1.0, 0.95), (0.7, 0.79, 1)])
def test_recall_at_the_similarity_and_above(docs_of, low, high, recall):
    pairs = around(low, high, random.Random(4), range(0, 1200, 2))
    assert recall_of(components(near_copies.similar_documents(docs_of(pairs))), pairs) >= recall


@pytest.mark.parametrize("limit", [4096, 3])
def test_groups_copies_and_awkward_rows(docs_of, limit):
    rng = random.Random(3)
    pairs = around(0.74, 0.9, rng, range(0, 80, 2))
    base = [f"b{k}" for k in range(200)]
    for k in range(30):  # a group of near copies of one text
        words = list(base)
        words[rng.randrange(200)] = f"x{k}"
        pairs.append((1000 + k, " ".join(words)))
    pairs += [(1500 + k, pairs[-1 - k][1]) for k in range(5)]
    pairs += [(2000, None), (2001, ""), (2002, "one"), (2003, "ONE"), (2004, "one two three four five")]
    pairs += [(2005, "long " * 50000), (2006, "long " * 60000)]
    docs = docs_of(pairs)
    found = components(near_copies.similar_documents(docs, limit=limit))
    assert recall_of(found, pairs) >= 0.9
    assert {found[1000 + k] for k in range(30)} == {1000} and found[2001] == 2000 and found[2006] == 2005
    kept = near_copies.keep_one_of_each(docs, limit=limit)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(i for i, c in found.items() if i == c)


def test_repeated_and_missing_ids(docs_of):
    texts = [f"{k} text with quite a few words of its own {k}" for k in range(3)]
    pairs = [(1, texts[0]), (1, texts[0]), (1, texts[1]), (2, texts[2]), (2, texts[2]), (None, texts[2]), (None, None)]
    runs = [
        sorted(tuple(r) for r in near_copies.keep_one_of_each(docs_of(p)).where("doc_id IS NOT NULL").collect())
        for p in (pairs, pairs[::-1])
    ]
    assert runs[0] == runs[1] and [r[0] for r in runs[0]] == [1, 2]
    assert near_copies.keep_one_of_each(docs_of(pairs)).where("doc_id IS NULL").count() == 2
    assert near_copies.keep_one_of_each(docs_of([])).count() == 0
    assert near_copies.similar_documents(docs_of([])).count() == 0


def test_nearest_smaller_is_the_nearest(monkeypatch):
    rng = np.random.default_rng(0)
    bucket = np.sort(rng.integers(0, 6, 400))
    rep = np.concatenate([np.sort(rng.permutation(1000)[: (bucket == b).sum()]) for b in range(6)])
    words = rng.integers(0, 1 << 12, (400, 1)).astype(np.uint64)
    want = set()
    for j in range(400):
        near = [
            (int(np.bitwise_count(words[i] ^ words[j]).sum()), i)
            for i in range(j) if bucket[i] == bucket[j] and rep[i] < rep[j]
        ]
        if near and min(near)[0] <= 4:
            want.add((int(rep[j]), min(near)[0]))
    for small in (512, 8):
        monkeypatch.setattr(near_copies, "SMALL", small)
        a, b, bits = near_copies.nearest_smaller(bucket, rep, words, 4)
        assert {(int(x), int(d)) for x, d in zip(a, bits)} == want and (b < a).all()


def test_stage_on_the_given_documents(spark, sf, table):
    import corpus_pipeline

    docs = table("documents")
    pairs = [(r.doc_id, r.text) for r in docs.collect()]
    kept = {r.doc_id for r in corpus_pipeline.keep_one_of_near_copies(spark, docs, sf).collect()}
    found = components(near_copies.similar_documents(docs))
    assert kept == {i for i, c in found.items() if i == c}
    assert recall_of(found, pairs) >= 0.9
