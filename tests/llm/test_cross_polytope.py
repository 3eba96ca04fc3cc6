import itertools

import numpy as np
import pytest

from pipewise.llm import cross_polytope as ann


def brute(rows, k=10, every=100):
    """Exact neighbours of plain (id, vector) rows with distinct ids."""
    good = [
        (i, np.array(v, float)) for i, v in rows
        if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)
    ]
    out = {}
    for q, a in good:
        if q % every == 0:
            found = sorted((float(np.sqrt(((a - b) ** 2).sum())), i) for i, b in good if i != q)
            out[q] = found[:k]
    return out


def by_query(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r["rank"])):
        own = out.setdefault(r.query_id, [])
        own.append((r.score, r.vec_id))
        assert r["rank"] == len(own)
    return out


@pytest.fixture()
def vectors_of(spark):
    def make(rows):
        wide = [(i, v, "x", "y", 1.0) for i, v in rows]
        return spark.createDataFrame(
            wide, "vec_id long, embedding array<double>, id string, v string, distance double"
        )

    return make


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_recall_and_exact_scores(spark, sf):
    table = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet")
    want = brute([(r.vec_id, r.embedding) for r in table.collect()])
    found = by_query(ann.nearest_neighbours(table))
    assert set(found) == set(want)
    hits = 0
    for q, own in found.items():
        assert len(own) == 10 and own == sorted(own)
        exact = dict((i, d) for d, i in want[q])
        hits += sum(i in exact for _, i in own)
        for d, i in own:
            if i in exact:
                assert d == pytest.approx(exact[i], rel=1e-14)
    assert hits >= 0.9 * 10 * len(want)


def test_clustered_vectors_of_any_length(vectors_of):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(40, 20)) * rng.uniform(0.1, 50, (40, 1))
    rows = [(k, (centres[k % 40] * (1 + rng.normal(size=20) * 0.05)).tolist()) for k in range(2000)]
    want = brute(rows, every=50)
    found = by_query(ann.nearest_neighbours(vectors_of(rows), every=50))
    hits = sum(len({i for _, i in own} & {i for _, i in want[q]}) for q, own in found.items())
    assert hits >= 0.9 * 10 * len(want)


def test_blocks_give_the_same_rows(vectors_of):
    rng = np.random.default_rng(2)
    rows = [(k, rng.normal(size=12).tolist()) for k in range(600)]
    whole = by_query(ann.nearest_neighbours(vectors_of(rows), every=20))
    parts = by_query(ann.nearest_neighbours(vectors_of(rows), every=20, block_bytes=1 << 14))
    assert whole == parts


def test_awkward_rows(vectors_of):
    nan, inf = float("nan"), float("inf")
    rows = [(k, [1.0 + k % 3, 2.0, -1.0]) for k in range(0, 240)]  # groups of copies, ties by id
    rows += [(300, None), (400, []), (500, [0.0, 0.0, 0.0]), (600, [nan, 1.0, 1.0]), (700, [1.0, None, 2.0])]
    rows += [(800, [inf, 1.0, 1.0]), (900, [1.0, 2.0]), (None, [1.0, 2.0, 3.0]), (1000, [1e-200, 1e-200, 0.0])]
    rows += [(1100, [1e200, 0.0, 0.0])]
    found = by_query(ann.nearest_neighbours(vectors_of(rows)))
    usable = [(i, v) for i, v in rows if v is None or len(v) == 3]
    want = brute(usable)
    assert set(found) == set(want) == {0, 100, 200, 1000, 1100}
    for q in (0, 100, 200):
        assert [i for _, i in found[q]] == [i for _, i in want[q]]
        assert all(d == 0 for d, _ in found[q])


def test_repeated_ids(vectors_of):
    rows = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (0, [0.0, 3.0]), (5, [1.0, 1.0]), (5, [0.0, 2.0]), (7, [2.0, 0.1])]
    found = by_query(ann.nearest_neighbours(vectors_of(rows)))
    assert [i for _, i in found[0]] == [5, 7] and found[0][0][0] == pytest.approx(1.0)


def test_few_and_no_rows(vectors_of):
    assert by_query(ann.nearest_neighbours(vectors_of([]))) == {}
    assert by_query(ann.nearest_neighbours(vectors_of([(1, [1.0, 2.0])]))) == {}
    assert by_query(ann.nearest_neighbours(vectors_of([(100, [1.0, 2.0])]))) == {}
    two = by_query(ann.nearest_neighbours(vectors_of([(100, [1.0, 2.0]), (3, [1.0, 2.5])])))
    assert two == {100: [(0.5, 3)]}


def test_hadamard_keeps_lengths_and_is_its_own_inverse():
    x = np.random.default_rng(3).normal(size=(5, 32)).astype(np.float32)
    y = ann.hadamard(x)
    assert np.allclose(np.linalg.norm(y, axis=1), np.linalg.norm(x, axis=1), rtol=1e-5)
    assert np.allclose(ann.hadamard(y), x, atol=1e-5)


@pytest.mark.parametrize("n", [40, 3000, 200_000])
def test_probes_in_order_of_cost(n):
    """The probes are those of least cost, and as many as needed are counted."""
    rng = np.random.default_rng(4)
    index = ann.new_index(n, 6, tables=3)
    vectors = rng.normal(size=(30, 6))
    for probes in (1, 7, 60):
        own = ann.Index(index.dim, index.axes, index.signs, probes)
        (tables, keys), = ann.probe_keys(own, vectors[:1])
        costs = {}
        unit = ann._unit(vectors[:1])
        for t in range(3):
            by_axis = [c[0] for c in ann._axis_costs(own, unit, t)]
            for choice in itertools.product(*[range(len(c)) for c in by_axis]):
                key = 0
                for c, at in zip(by_axis, choice):
                    key = key * len(c) + at
                costs[t, key] = sum(c[at] for c, at in zip(by_axis, choice))
        least = sorted(costs.values())[: len(keys)]
        assert len(keys) == min(probes, len(costs))
        assert np.allclose(sorted(costs[t, k] for t, k in zip(tables, keys)), least, atol=1e-5)
        met = ann.bucket_keys(own, vectors)
        needed = ann.probes_needed(own, vectors[0], vectors)
        hit = {(t, k) for t, k in zip(tables, keys)}
        for row, count in zip(met, needed):
            if count <= len(keys):
                assert any((t, k) in hit for t, k in enumerate(row))
