"""Resampling of documents towards a target distribution, by importance.

Runs of words are hashed into a fixed number of buckets. A bucket's gain is the
scaled log ratio of its smoothed frequencies in the target texts and in all
documents; a document's weight is the sum of the gains of its features, an
array lookup each. With Gumbel noise from a hash of the id added, the highest
scores are a sample without replacement in proportion to the weights.

The draw is a distributed quickselect. Rows are ordered by a composite key
(highest score, smallest id). Each round takes a few random rows of the range
still open as pivots, the same ones if it runs again, and counts in one
aggregation how many rows come before and how many are equal to each pivot. The
range shrinks to the gap that holds the k-th key, until a pivot is that key. No
row is moved for that; only the rows drawn are then range partitioned, sorted
and numbered.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pipewise.sources.scratch import materialize

SEED = 2024
BUCKETS = 10_000
LONGEST = 1
"""Words of the longest feature."""
MIN_WORDS = 20
PERCENT = 10
SCALE = 1000.0
PIVOTS = 12
"""Pivots of a round: a range of n rows is left after log n / log PIVOTS rounds or so."""
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_KNOWN = 1 << 19
"""Features whose bucket a task remembers, at most."""


class _Buckets(dict):
    """The bucket of a feature; forgets all when it holds too many."""

    def __init__(self, buckets: int):
        self.buckets = buckets

    def __missing__(self, feature: bytes) -> int:
        if len(self) >= _KNOWN:
            self.clear()
        self[feature] = found = zlib.crc32(feature) % self.buckets
        return found


def words_of(text: bytes | None) -> list[bytes]:
    """Runs of letters, digits and characters beyond ASCII, A-Z in lower case."""
    return _WORD.findall((text or b"").lower())


def _bucket_ids(words: list[bytes], longest: int, known: _Buckets) -> np.ndarray:
    """The bucket of every run of 1 to ``longest`` words, repeats included."""
    found = [known[w] for w in words]
    for size in range(2, longest + 1):
        runs = zip(*[words[k:] for k in range(size)])
        found += [known[b" ".join(run)] for run in runs]
    return np.array(found, np.int64)


def bucket_counts(texts: DataFrame, buckets: int = BUCKETS, longest: int = LONGEST) -> DataFrame:
    """(bucket, count) over all rows of ``text``; one row per bucket leaves a task."""

    def counted(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, total = _Buckets(buckets), np.zeros(buckets, np.int64)
        for table in tables:
            for text in table.column(0):
                own = _bucket_ids(words_of(text.as_py()), longest, known)
                total += np.bincount(own, minlength=buckets)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array(used), pa.array(total[used])], names=["bucket", "count"]
        )

    parts = texts.select(F.col("text").cast("binary")).mapInArrow(counted, "bucket long, count long")
    return parts.groupBy("bucket").agg(F.sum("count").alias("count"))


def _as_array(counts: DataFrame, buckets: int) -> np.ndarray:
    """At most ``buckets`` rows come to the driver."""
    out = np.zeros(buckets)
    for row in counts.collect():
        out[row["bucket"]] = row["count"]
    return out


def gains(target: np.ndarray, source: np.ndarray) -> np.ndarray:
    """Scaled log ratio of the smoothed frequencies of each bucket, rounded down."""
    size = len(source)
    above = (target + 1) * (source.sum() + size)
    below = (source + 1) * (target.sum() + size)
    return np.floor(SCALE * np.log(above / below)).astype(np.int64)


def _noise(seed: int) -> Column:
    """Gumbel noise from the id, scaled and rounded down; one value without an id."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    uniform = (h + 0.5) / F.lit(4294967296.0)
    return F.floor(F.lit(-SCALE) * F.log(-F.log(uniform))).cast("long")


def score_documents(docs: DataFrame, gain: np.ndarray, longest: int = LONGEST,
                    seed: int = SEED) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score) of every row."""
    buckets = len(gain)

    def weighed(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Buckets(buckets)
        for table in tables:
            rows = np.zeros((3, table.num_rows), np.int64)
            for at, text in enumerate(table.column(1)):
                words = words_of(text.as_py())
                own = _bucket_ids(words, longest, known)
                rows[:, at] = len(words), len(own), gain[own].sum()
            yield pa.RecordBatch.from_arrays(
                [table.column(0), *map(pa.array, rows)],
                names=["doc_id", "n_words", "n_features", "weight"],
            )

    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary"))
    schema = "doc_id long, n_words long, n_features long, weight long"
    return texts.mapInArrow(weighed, schema).withColumn("score", F.col("weight") + _noise(seed))


# --- the k-th row --------------------------------------------------------------

Key = tuple[int, int, int]
"""(score negated, 1 if the id is missing, id), in the order of the draw."""


def _id() -> tuple[Column, Column]:
    """1 where the id is missing, and the id."""
    return F.col("doc_id").isNull().cast("int"), F.coalesce(F.col("doc_id"), F.lit(0))


def _before(key: Key) -> Column:
    """Rows that come before the key."""
    score, lacks, number = key
    missing, own = _id()
    return (F.col("score") > -score) | (
        (F.col("score") == -score) & ((missing < lacks) | ((missing == lacks) & (own < number)))
    )


def _equals(key: Key) -> Column:
    score, lacks, number = key
    missing, own = _id()
    return (F.col("score") == -score) & (missing == lacks) & (own == number)


def kth_key(scored: DataFrame, k: int, pivots: int = PIVOTS, seed: int = SEED) -> Key:
    """The key of the k-th row, k from 1 to the number of rows.

    ``scored`` has doc_id and score, and is read twice in every round, so it
    should be a written table. The driver holds the pivots of one round.
    """
    low: Key | None = None
    high: Key | None = None
    before_low, turn = 0, 0
    while True:
        open_rows = scored
        if low is not None:
            open_rows = open_rows.where(~_before(low) & ~_equals(low))
        if high is not None:
            open_rows = open_rows.where(_before(high))
        turn += 1
        lot = F.xxhash64(F.lit(seed + turn), "score", "doc_id").alias("lot")
        missing, own = _id()
        drawn = open_rows.select(
            (-F.col("score")).alias("a"), missing.alias("b"), own.alias("c"), lot
        )
        keys = sorted({(r.a, r.b, r.c) for r in drawn.orderBy("lot").limit(pivots).collect()})
        counts = open_rows.agg(
            *[F.count(F.when(_before(key), 1)).alias(f"before_{i}") for i, key in enumerate(keys)],
            *[F.count(F.when(_equals(key), 1)).alias(f"equal_{i}") for i, key in enumerate(keys)],
        ).first()
        base = before_low
        for i, key in enumerate(keys):
            before, equal = base + counts[f"before_{i}"], counts[f"equal_{i}"]
            if k <= before:
                high = key
                break
            if k <= before + equal:
                return key
            low, before_low = key, before + equal


def _ranked(winners: DataFrame, seed: int) -> DataFrame:
    """``winners`` with their place from 1: sorted in ranges, each moved up by the
    rows of the ranges before it. Equal keys are split among ranges by lot."""
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("_lot")]
    parts = int(winners.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = winners.withColumn("_lot", F.rand(seed)).repartitionByRange(parts, *order)
    numbered = ranged.sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    numbered = materialize(
        numbered.withColumn("_range", F.shiftright("_at", 33))
        .withColumn("_at", F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)))
        .drop("_lot"),
        "winners",
    )
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = numbered.groupBy("_range").agg(F.count(F.lit(1)).alias("_rows"))
    moved = F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_moved")
    offsets = materialize(sizes.select("_range", moved), "offsets")
    return numbered.join(offsets, "_range").withColumn(
        "rank", F.col("_at") + F.col("_moved") + 1
    ).drop("_range", "_at", "_moved")


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT,
             min_words: int = MIN_WORDS, buckets: int = BUCKETS, longest: int = LONGEST,
             seed: int = SEED) -> DataFrame:
    """(doc_id, n_features, weight, score, rank): every row of ``docs``, those
    drawn numbered from 1 by descending score, ties to the smaller id.

    ``docs`` has doc_id and text, ``target`` has text; other columns play no
    part. A null text has no words, like an empty one: no features, weight 0.
    Rows repeated under one id have one noise, are scored one by one and count
    one by one. Rows without an id share one noise and come last among ties. Of
    ``percent`` per cent of the rows with ``min_words`` words or more, rounded
    down, none may be left: then no row has a rank. An empty target makes every
    gain a function of the documents alone; empty documents give no rows.
    """
    source = _as_array(bucket_counts(docs, buckets, longest), buckets)
    wanted = _as_array(bucket_counts(target, buckets, longest), buckets)
    scored = score_documents(docs, gains(wanted, source), longest, seed)
    scored = materialize(scored, "scored")
    long_enough = F.col("n_words") >= min_words
    able = scored.where(long_enough)
    k = able.count() * percent // 100
    none = F.lit(None).cast("long")
    columns = ["doc_id", "n_features", "weight", "score", "rank"]
    if not k:
        return scored.withColumn("rank", none).select(columns)
    last = kth_key(able, k, seed=seed)
    drawn = long_enough & (_before(last) | _equals(last))
    # rows equal to the last key beyond the k-th are ranked, then let go again
    ranked = _ranked(scored.where(drawn), seed).withColumn(
        "rank", F.when(F.col("rank") <= k, F.col("rank"))
    )
    return ranked.select(columns).unionByName(
        scored.where(~drawn).withColumn("rank", none).select(columns)
    )
