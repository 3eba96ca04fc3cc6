"""A node's nearest in a bucket must not hide the partner that is alike enough."""

import random

import numpy as np
import pytest

from pipewise.llm import near_copies


def changed(words, at, n, rng):
    return words[:at] + [f"v{rng.randrange(10**7)}" for _ in range(n)] + words[at + n :]


def clusters(rng, number, decoys):
    """(first, last, rows): texts alike by 0.82, and between their ids others that
    are nearer by few bits but alike to neither by 0.8."""
    out = []
    for k in range(number):
        base = k * 1000
        last = [f"w{rng.randrange(10**7)}" for _ in range(300)]
        rows = [(base, " ".join(changed(last, 0, 25, rng))), (base + 900, " ".join(last))]
        for d in range(decoys):
            rows.append((base + 1 + d, " ".join(changed(last, 40 + 6 * (d % 30), 30, rng))))
        out.append((base, base + 900, rows))
    return out


def test_partners_behind_nearer_ones_are_linked(docs_of):
    made = clusters(random.Random(8), 30, 60)
    pairs = [row for _, _, rows in made for row in rows]
    found = near_copies.similar_documents(docs_of(pairs), limit=64)
    found = {r["id"]: r["component"] for r in found.collect()}
    assert sum(found[a] == found[b] for a, b, _ in made) >= 0.9 * len(made)


@pytest.mark.parametrize("small", [512, 8])
def test_all_pairs_of_different_roots(monkeypatch, small):
    rng = np.random.default_rng(1)
    bucket = np.sort(rng.integers(0, 6, 300))
    rep = np.concatenate([np.sort(rng.permutation(900)[: (bucket == b).sum()]) for b in range(6)])
    root = rep // 3
    words = rng.integers(0, 1 << 12, (300, 1)).astype(np.uint64)
    want = {
        (int(bucket[i]), int(rep[j]), int(rep[i]))
        for j in range(300) for i in range(j)
        if bucket[i] == bucket[j] and root[i] != root[j]
        and np.bitwise_count(words[i] ^ words[j]).sum() <= 4
    }
    monkeypatch.setattr(near_copies, "SMALL", small)
    found = set()
    for b in range(6):
        own = bucket == b
        for x in near_copies.pairs_apart(bucket[own], rep[own], root[own], words[own], 4):
            found |= {(b, int(i), int(j)) for i, j, _ in zip(*x)}
    assert found == want
