"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes ratios.

A text's bytes with A-Z lowered and white space as one blank give n-grams of 5
and 7 bytes (short words with the blanks around them, and stems), hashed to
indicators and scaled by class log-count ratios; an n-gram that few texts of
the sample have counts for nothing. The linear model is a logistic regression
fitted on the labelled sample.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pipewise.llm import labelled, nbsvm
from pipewise.llm.shared import text_of

BITS = 20
SIZES = (5, 7)
MIN_DOCS = 5
PER_CLASS = 3000
"""Bound on the labelled rows of a class used for fitting."""
HELD_OUT = (4, 2)
THRESHOLD = 0.3
L2, EPOCHS = 1e-4, 8

_slots = np.empty(1 << BITS, np.int32)


def char_ngrams(text: bytes) -> np.ndarray:
    """Distinct numbers of the n-grams of a text, blanks around it included."""
    plain = np.frombuffer(b" " + b" ".join(text.lower().split()) + b" ", np.uint8).astype(np.uint64)
    found, code = [], np.zeros(len(plain), np.uint64)
    for size in range(1, max(SIZES) + 1):
        if size > len(plain):
            break
        code = code[: len(plain) - size + 1] * np.uint64(257) + plain[size - 1 :] + np.uint64(1)
        if size in SIZES:
            mixed = (code ^ (code >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
            found.append((mixed >> np.uint64(64 - BITS)).astype(np.int32))
    if not found:
        return np.empty(0, np.int64)
    every = np.concatenate(found)
    # the last of equal numbers stays: one pass, no sort
    place = np.arange(len(every), dtype=np.int32)
    _slots[every] = place
    return every[_slots[every] == place].astype(np.int64)


def logistic(rows, y: np.ndarray, size: int) -> tuple[np.ndarray, float]:
    """Weights and offset of logistic loss with L2, both classes weighing the same,
    by stochastic averages of the gradient with a falling step, from a fixed seed."""
    weights, offset = np.zeros(size), 0.0
    ones = (y > 0).sum()
    share = np.where(y > 0, len(y) / (2 * ones), len(y) / (2 * (len(y) - ones)))
    order, scale = np.random.default_rng(7), 1.0
    for epoch in range(EPOCHS):
        rate = 4.0 / (1 + epoch)
        for i in order.permutation(len(rows)):
            found, values = rows[i]
            z = y[i] * (scale * (values @ weights[found]) + offset)
            pull = rate * share[i] * y[i] / (1 + np.exp(np.clip(z, -35, 35)))
            scale *= 1 - rate * L2
            weights[found] += pull / scale * values
            offset += 0.1 * pull
    return weights * scale, offset


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learnt from; false for a row without id."""
    modulus, rest = HELD_OUT
    return F.coalesce(labelled.remainder(doc_id, modulus) == rest, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> nbsvm.Model:
    own = labelled.sample(docs, labels, "toxic", per_class, ~held_out(F.col("doc_id")))
    return nbsvm.train(own, char_ngrams, 1 << BITS, logistic, MIN_DOCS)


def score_toxicity(docs: DataFrame, model: nbsvm.Model) -> DataFrame:
    """(id, score): how likely label 1 is, 0 to 1, for every row.

    Only the whole text counts. A null text is scored as an empty one. Repeated
    rows and rows without a ``doc_id`` are scored like any other; an empty table
    gives an empty result; without usable labels every score is 0.5.
    """
    return nbsvm.scores(docs, model, char_ngrams, text_of(docs["text"]))
