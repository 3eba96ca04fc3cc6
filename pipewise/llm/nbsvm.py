"""Linear models over n-gram indicators scaled by naive Bayes log-count ratios.

Features are hashed n-grams of a whole text, each present or absent. The ratio
of an n-gram is log((1 + documents of class 1 with it) / (1 + documents of class
0 with it)), both as shares; an indicator is scaled by its ratio, and a text's
vector has length 1. The ratios and the linear model are fitted on the bounded
sample in one task; scoring is a map over all documents with the weights (a
vector of fixed size) as a broadcast variable.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame

from pipewise.llm.shared import record_batch

Features = Callable[[bytes], np.ndarray]
"""From a text to the sorted or unsorted distinct numbers of its n-grams."""


def log_count_ratios(
    rows: list[np.ndarray], y: np.ndarray, size: int, min_docs: int = 1
) -> np.ndarray:
    """An n-gram that fewer than ``min_docs`` sample texts have tells nothing: 0."""
    counts = np.zeros((2, size))
    for found, label in zip(rows, y):
        counts[int(label > 0), found] += 1
    totals = np.array([(y <= 0).sum(), (y > 0).sum()])[:, None]
    shares = (counts + 1) / (totals + 2)
    return np.where(counts.sum(axis=0) >= min_docs, np.log(shares[1] / shares[0]), 0.0)


def scaled(found: np.ndarray, ratios: np.ndarray) -> np.ndarray:
    """Values of a text's features; all texts have length 1 (or no feature)."""
    values = ratios[found]
    norm = np.sqrt(values @ values)
    return values / norm if norm else values


def calibrated(margins: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic curve through margins (Newton steps on the
    smoothed targets (n1 + 1) / (n1 + 2) and 1 / (n0 + 2))."""
    ones = max(1, int((y > 0).sum()))
    target = np.where(y > 0, (ones + 1) / (ones + 2), 1 / (len(y) - ones + 2))
    x = np.column_stack([margins, np.ones(len(y))])
    w = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -35, 35)))
        step = np.linalg.solve(
            (x * (p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2), x.T @ (p - target) + 1e-6 * w
        )
        w -= step / max(1.0, np.abs(step).max() / 5)
        if np.abs(step).max() < 1e-8:
            break
    return max(float(w[0]), 1e-3), float(w[1])


@dataclass
class Model:
    """Weights per feature (ratio and linear weight), offset, and the curve to 0..1."""

    ratios: np.ndarray
    weights: np.ndarray
    offset: float
    slope: float
    shift: float

    def margin(self, found: np.ndarray) -> float:
        return float(scaled(found, self.ratios) @ self.weights[found]) + self.offset

    def score(self, found: np.ndarray) -> float:
        z = self.slope * self.margin(found) + self.shift
        return float(1 / (1 + np.exp(-np.clip(z, -35, 35))))


Fitter = Callable[[list[np.ndarray], np.ndarray, int], tuple[np.ndarray, float]]


def fit_model(
    rows: list[np.ndarray], y: np.ndarray, size: int, fitter: Fitter, min_docs: int = 1
) -> Model:
    """Ratios and weights from four fifths of the sample, the curve from the rest.

    With one class only (or no row) every score is that class's smoothed share.
    """
    ones = int((y > 0).sum())
    if ones in (0, len(y)):
        share = (ones + 1) / (len(y) + 2)
        nothing = np.zeros(size)
        return Model(nothing, nothing, 0.0, 1.0, float(np.log(share / (1 - share))))
    # every fifth row of either class
    place = np.where(y > 0, np.cumsum(y > 0), np.cumsum(y <= 0))
    own = place % 5 > 0
    ratios = log_count_ratios([r for r, o in zip(rows, own) if o], y[own], size, min_docs)
    rows = [r[ratios[r] != 0] for r in rows]
    vectors = [scaled(r, ratios) for r in rows]
    weights, offset = fitter(
        [(r, v) for r, v, o in zip(rows, vectors, own) if o], y[own], size
    )
    margins = np.array([v @ weights[r] + offset for r, v in zip(rows, vectors)])
    rest = ~own if len(set(np.sign(y[~own]))) == 2 else own
    return Model(ratios, weights, offset, *calibrated(margins[rest], y[rest]))


def train(
    sample: DataFrame, features: Features, size: int, fitter: Fitter, min_docs: int = 1
) -> Model:
    """The model of a bounded sample (rank, label, text), fitted in one task.

    The sample comes to that task in the order of (rank, label); the vectors
    that come back have a fixed size.
    """

    def fitted(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, labels = [], []
        for table in tables:
            for label, text in zip(table.column(1).to_pylist(), table.column(2)):
                rows.append(features(text.as_py()))
                labels.append(label)
        y = np.where(np.array(labels, int) > 0, 1.0, -1.0)
        model = fit_model(rows, y, size, fitter, min_docs)
        parts = [model.ratios, model.weights, np.array([model.offset, model.slope, model.shift])]
        yield record_batch([tuple(p.astype(np.float64).tobytes() for p in parts)], schema)

    schema = "ratios binary, weights binary, rest binary"
    ordered = sample.selectExpr("rank", "label", "cast(text AS binary) AS text")
    ordered = ordered.coalesce(1).sortWithinPartitions("rank", "label")
    found = ordered.mapInArrow(fitted, schema).first()
    if found is None:  # an empty sample may have no task at all
        return fit_model([], np.empty(0), size, fitter)
    ratios, weights, rest = [np.frombuffer(x, np.float64) for x in found]
    return Model(ratios, weights, *map(float, rest))


def scores(docs: DataFrame, model: Model, features: Features, text: Column) -> DataFrame:
    """(id, score) for every row's whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scored(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for table in tables:
            found = [own.score(features(t.as_py())) for t in table.column(1)]
            yield pa.RecordBatch.from_arrays(
                [table.column(0), pa.array(found, pa.float64())], names=["id", "score"]
            )

    plain = docs.select(docs["doc_id"].cast("long").alias("id"), text.cast("binary").alias("text"))
    return plain.mapInArrow(scored, "id long, score double")
