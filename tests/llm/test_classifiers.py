import zlib

import numpy as np
import pytest

from pipewise.llm import nbsvm, quality, toxicity

CASES = {
    "quality": (quality, quality.score_quality, quality.word_ngrams, 0.95),
    "toxic": (toxicity, toxicity.score_toxicity, toxicity.char_ngrams, 0.9),
}


@pytest.mark.parametrize("label", CASES)
def test_held_out_rows_are_told_apart(spark, label):
    module, score, _, least = CASES[label]
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    model = module.fit(docs, labels)
    scores = {r.id: r.score for r in score(docs, model).collect()}
    assert len(scores) == docs.count()
    modulus, rest = module.HELD_OUT
    own = [
        (scores[r.doc_id], r[label])
        for r in labels.collect()
        if zlib.crc32(str(r.doc_id).encode()) % modulus == rest
    ]
    right = np.mean([(s >= module.THRESHOLD) == bool(y) for s, y in own])
    assert right >= least, right


@pytest.mark.parametrize("label", CASES)
def test_held_out_labels_change_nothing(spark, docs_of, label):
    module, score, _, _ = CASES[label]
    texts = [(k, ("good words here " if k % 2 else "bad stuff there ") + f"no {k}") for k in range(60)]
    docs = docs_of(texts)
    modulus, rest = module.HELD_OUT

    def scored(flip):
        rows = [
            (k, int(k % 2) if not (flip and zlib.crc32(str(k).encode()) % modulus == rest) else 1)
            for k in range(60)
        ]
        model = module.fit(docs, spark.createDataFrame(rows, f"doc_id long, {label} int"))
        return sorted((r.id, r.score) for r in score(docs, model).collect())

    assert scored(False) == scored(True)


@pytest.mark.parametrize("label", CASES)
def test_awkward_rows(spark, docs_of, label):
    module, score, features, _ = CASES[label]
    docs = docs_of([(1, "some text"), (1, "some text"), (None, "some text"), (2, None), (3, ""), (4, "x " * 60000)])
    none = spark.createDataFrame([], f"doc_id long, {label} int")
    odd = spark.createDataFrame([(1, 1), (1, 0), (2, None), (3, 5), (None, 1), (99, 0)], f"doc_id long, {label} int")
    for labels in (none, odd):
        model = module.fit(docs, labels)
        got = score(docs, model).collect()
        assert len(got) == 6 and all(0 <= r.score <= 1 for r in got)
        assert score(docs_of([]), model).collect() == []
    assert len(features(b"")) <= 1


def test_ratios_and_descent_on_a_small_case():
    rows = [np.array([0, 2]), np.array([0, 3]), np.array([1, 2]), np.array([1, 3])] * 10
    y = np.array([1.0, 1.0, -1.0, -1.0] * 10)
    ratios = nbsvm.log_count_ratios(rows, y, 5)
    assert ratios[0] == pytest.approx(np.log(21 / 1)) and ratios[1] == -ratios[0]
    assert ratios[2] == ratios[3] == ratios[4] == 0
    vectors = [(r, nbsvm.scaled(r, ratios)) for r in rows]
    weights, offset = quality.dual_coordinate_descent(vectors, y, 5)
    assert all(label * (v @ weights[r] + offset) >= 0.9 for (r, v), label in zip(vectors, y))


def test_distinct_ngrams():
    found = toxicity.char_ngrams(b"aaaaaaaaaa bbb")
    assert len(set(found.tolist())) == len(found)
    assert set(toxicity.char_ngrams(b"A  b\ncde")) == set(toxicity.char_ngrams(b"a B CDE"))
