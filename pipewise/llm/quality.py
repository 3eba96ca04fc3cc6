"""Quality classifier: naive Bayes support vectors over word n-grams.

Tokens are runs of word characters or of other signs, letters as written.
Single tokens and pairs are hashed to indicators, scaled by class log-count
ratios, and a linear hinge-loss model is fitted by dual coordinate descent.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pipewise.llm import labelled, nbsvm
from pipewise.llm.shared import text_of

BITS = 18
PER_CLASS = 3000
"""Bound on the labelled rows of a class used for fitting."""
HELD_OUT = (3, 1)
THRESHOLD = 0.5
PENALTY, EPOCHS = 1.0, 15

_TOKEN = re.compile(rb"[A-Za-z0-9_\x80-\xff]+|[^A-Za-z0-9_\x80-\xff\s]+")


def word_ngrams(text: bytes) -> np.ndarray:
    """Distinct numbers of the single tokens and token pairs of a text."""
    one = np.fromiter(map(zlib.crc32, _TOKEN.findall(text)), np.uint64)
    two = one[:-1] * np.uint64(0x9E3779B97F4A7C15) + one[1:] * np.uint64(0xD6E8FEB86659FD93)
    # a token that follows itself is one n-gram more, the same for all tokens
    again = one[:1][: int((one[:-1] == one[1:]).any())] * np.uint64(0)
    both = np.concatenate([one * np.uint64(0xBF58476D1CE4E5B9), two, again])
    return np.unique(both >> np.uint64(64 - BITS)).astype(np.int64)


def dual_coordinate_descent(rows, y: np.ndarray, size: int) -> tuple[np.ndarray, float]:
    """Weights and offset of min |w|^2 / 2 + C sum max(0, 1 - y w x).

    One dual variable per row in [0, C], rows in an order drawn anew in each
    epoch from a fixed seed; C is shared out so that both classes weigh the
    same. The offset is the weight of a constant feature.
    """
    weights, offset = np.zeros(size), 0.0
    ones = (y > 0).sum()
    bound = PENALTY * np.where(y > 0, len(y) / (2 * ones), len(y) / (2 * (len(y) - ones)))
    norm = np.array([v @ v + 1.0 for _, v in rows])
    alpha = np.zeros(len(rows))
    order = np.random.default_rng(7)
    for _ in range(EPOCHS):
        largest = 0.0
        for i in order.permutation(len(rows)):
            found, values = rows[i]
            slope = y[i] * (values @ weights[found] + offset) - 1
            new = min(max(alpha[i] - slope / norm[i], 0.0), bound[i])
            step = (new - alpha[i]) * y[i]
            if step:
                weights[found] += step * values
                offset += step
                largest = max(largest, abs(step))
                alpha[i] = new
        if largest < 1e-3:
            break
    return weights, offset


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learnt from; false for a row without id."""
    modulus, rest = HELD_OUT
    return F.coalesce(labelled.remainder(doc_id, modulus) == rest, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> nbsvm.Model:
    own = labelled.sample(docs, labels, "quality", per_class, ~held_out(F.col("doc_id")))
    return nbsvm.train(own, word_ngrams, 1 << BITS, dual_coordinate_descent)


def score_quality(docs: DataFrame, model: nbsvm.Model) -> DataFrame:
    """(id, score): how likely label 1 is, 0 to 1, for every row.

    Only the whole text counts. A null text is scored as an empty one, which
    has no feature and gets the score of the offset alone. Repeated rows and
    rows without a ``doc_id`` are scored like any other; an empty table gives an
    empty result; without usable labels every score is 0.5.
    """
    return nbsvm.scores(docs, model, word_ngrams, text_of(docs["text"]))


def keep_good(docs: DataFrame, model: nbsvm.Model, threshold: float = THRESHOLD) -> DataFrame:
    """The documents, same columns, that score at least ``threshold``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(texts):
        return texts.map(lambda t: shared.value.score(word_ngrams(bytes(t))))

    own = docs["text"]
    return docs.filter(score(text_of(own).cast("binary")) >= threshold)
