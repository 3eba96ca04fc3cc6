"""Near-duplicate documents by SimHash and covering locality-sensitive hashing.

A document's signature is one or more 64-bit SimHash words over its word
shingles. Signatures are cut into bands of bits. For radius r, every bit of a
band is given a vector of r + 1 bits; each non-zero vector v makes a mask of the
bits whose vector has odd parity with v, and a table keyed by the masked band.
The vectors of up to r differing bits span at most r dimensions, so some v is
orthogonal to all of them: every pair within the radius collides in some table,
without exception (2^(r+1) - 1 tables per band).

Equal signatures are one node, named by its smallest document. Nodes of a
bucket are compared in one task and linked to the smallest member they reach,
so a bucket emits at most one link per node. A bucket with more than ``limit``
nodes is keyed again: the bits that its mask left open are covered by masks of
their own, which keeps every pair within the radius together. With one band of
64 bits the second key leaves at most 15 bits open, so a bucket has at most
2^15 nodes. Whatever is still over the limit is compared as pairs of blocks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pipewise.llm.components import components
from pipewise.sources.scratch import materialize

SEED = 42
LIMIT = 4096
"""Nodes of a bucket that one task compares."""
SMALL = 512
"""Up to so many, all pairs of a bucket are compared at once."""
_HASHES_AT_ONCE = 1 << 16


@dataclass(frozen=True)
class Scheme:
    """What is hashed and what counts as near.

    shingle: words per shingle; words: 64-bit words of a signature; bands: the
    bits [low, high) of each band of a word; radius: bits in which a band may
    differ; distance: bits in which linked signatures may differ; banded: so
    many words have tables, all are compared.
    """

    shingle: int
    words: int
    bands: tuple[tuple[int, int], ...]
    radius: int
    distance: int
    banded: int


EXACT64 = Scheme(shingle=3, words=1, bands=((0, 64),), radius=3, distance=3, banded=1)
"""Fingerprints of 64 bits, linked at 3 or fewer differing bits, none missed."""


def shingle_hashes(text: bytes, size: int) -> Iterator[np.ndarray]:
    """XXH64 of all shingles of ``size`` words, repeats included, in blocks."""
    words = text.lower().split()
    if 0 < len(words) < size:
        words, size = [b" ".join(words)], 1
    digest, count = xxhash.xxh64_intdigest, len(words) - size + 1
    for at in range(0, count, _HASHES_AT_ONCE):
        until = min(at + _HASHES_AT_ONCE, count)
        runs = zip(*[words[at + k : until + k] for k in range(size)])
        yield np.array([digest(x, SEED) for x in map(b" ".join, runs)], np.uint64)


def bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many hashes have each bit, highest bit first."""
    bits = np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
    whole = len(bits) // 255 * 255
    counts = bits[whole:].sum(axis=0, dtype=np.int64)
    blocks = bits[:whole].reshape(-1, 255, 64).sum(axis=1, dtype=np.uint8)
    return counts + blocks.sum(axis=0, dtype=np.int64)


def hash_word(hashes: np.ndarray, k: int) -> np.ndarray:
    """The k-th word of hash bits of each shingle; the first is the hash itself."""
    if k == 0:
        return hashes
    mixed = hashes ^ np.uint64(0x9E3779B97F4A7C15 * k & (2**64 - 1))
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        mixed = (mixed ^ (mixed >> np.uint64(shift))) * np.uint64(factor)
    return mixed ^ (mixed >> np.uint64(31))


def signature(text: bytes, scheme: Scheme) -> np.ndarray:
    """A bit is 1 if it is set in over half of the shingle hashes; no word: zero."""
    counts = np.zeros((scheme.words, 64), np.int64)
    total = 0
    for hashes in shingle_hashes(text, scheme.shingle):
        total += len(hashes)
        for k in range(scheme.words):
            counts[k] += bit_counts(hash_word(hashes, k))
    return np.packbits(2 * counts > total, axis=1).view(">u8").ravel().astype(np.uint64)


def signatures(docs: DataFrame, scheme: Scheme) -> DataFrame:
    """(id, w0, w1, ...): the signature of every row's whole text."""
    names = [f"w{k}" for k in range(scheme.words)]

    def signed(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in tables:
            found = [signature(t.as_py() or b"", scheme) for t in table.column(1)]
            words = np.array(found, np.uint64).reshape(-1, scheme.words).view(np.int64)
            arrays = [pa.array(words[:, k]) for k in range(scheme.words)]
            yield pa.RecordBatch.from_arrays([table.column(0), *arrays], names=["id", *names])

    schema = ", ".join(["id long", *[f"{n} long" for n in names]])
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary"))
    return texts.mapInArrow(signed, schema)


def covering_masks(bits: list[int], radius: int) -> list[int]:
    """Masks over the given bit positions such that any ``radius`` of them are
    left out together by some mask."""
    size = (1 << (radius + 1)) - 1
    vector = {bit: 1 + k % size for k, bit in enumerate(bits)}
    return [
        sum(1 << bit for bit in bits if (vector[bit] & v).bit_count() & 1)
        for v in range(1, size + 1)
    ]


def _tables(scheme: Scheme) -> list[tuple[int, int, list[int]]]:
    """(word, mask, masks that refine it) of every table."""
    out = []
    for word in range(scheme.banded):
        for low, high in scheme.bands:
            for mask in covering_masks(list(range(low, high)), scheme.radius):
                rest = [b for b in range(low, high) if not mask >> b & 1]
                finer = [mask | m for m in covering_masks(rest, scheme.radius)]
                out.append((word, mask, finer))
    return out


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def _blocks(rows: DataFrame, limit: int) -> DataFrame:
    """Buckets as they are, or as pairs of blocks where they hold over ``limit`` rows."""
    large = rows.groupBy("bucket").count().filter(F.col("count") > limit)
    parts = F.ceil(F.col("count") / limit).cast("int")
    cut = rows.join(large, "bucket").withColumn(
        "own", F.pmod(F.xxhash64("rep"), parts).cast("int")
    )
    cut = cut.withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1)))
    named = F.xxhash64("bucket", F.least("own", "other"), F.greatest("own", "other"))
    cut = cut.withColumn("bucket", named)
    return rows.join(large, "bucket", "left_anti").unionByName(cut.select(rows.columns))


def bucketed(nodes: DataFrame, scheme: Scheme, limit: int, carried: list[str] | None = None,
             sampled: int = 1) -> DataFrame:
    """(bucket, columns carried): each node once per table, large buckets keyed again.

    A bucket is named by a 64-bit hash of table and key; two buckets that share
    a name are compared together, which costs time and changes no link. Large
    buckets may be told by one node in ``sampled``: that decides how pairs are
    compared, not which.
    """
    tables = _tables(scheme)
    words = [F.col(f"w{k}") for k in range(scheme.words)]
    carried = carried or nodes.columns
    keys = [
        F.xxhash64(F.lit(t), words[word].bitwiseAND(F.lit(_signed(mask))))
        for t, (word, mask, _) in enumerate(tables)
    ]
    first = nodes.select("*", F.posexplode(F.array(*keys)).alias("t", "bucket"))
    counted = first if sampled == 1 else first.where(F.pmod(F.xxhash64(F.lit("counted"), "rep"), F.lit(sampled)) == 0)
    hot = counted.groupBy("bucket").count().filter(F.col("count") > limit // sampled).select("bucket")
    hot = materialize(hot, "hot-buckets")
    plain = first.join(hot, "bucket", "left_anti").select("bucket", *carried)
    finer = F.array(*[F.array(*[F.lit(_signed(m)) for m in x[2]]) for x in tables])
    word_of = F.array(*[F.lit(x[0]) for x in tables])
    again = first.join(hot, "bucket", "left_semi").select(
        *carried,
        "t",
        F.get(F.array(*words), F.get(word_of, F.col("t"))).alias("own"),
        F.posexplode(F.get(finer, F.col("t"))).alias("n", "mask"),
    )
    again = again.select(
        F.xxhash64("t", "n", F.col("own").bitwiseAND(F.col("mask"))).alias("bucket"),
        *carried,
    )
    return plain.unionByName(_blocks(again, limit))


def _labels(size: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest index each of ``size`` rows reaches over the links a - b."""
    label = np.arange(size)
    while True:
        before = label.copy()
        np.minimum.at(label, a, label[b])
        np.minimum.at(label, b, label[a])
        label = label[label]
        if (label == before).all():
            return label


def _reach(words: np.ndarray, distance: int) -> np.ndarray:
    """As ``_labels`` for one large bucket, comparing each row with those not yet reached."""
    label = np.full(len(words), -1)
    left = np.arange(len(words))
    while len(left):
        root, frontier = left[0], [left[0]]
        left = left[1:]
        label[root] = root
        while frontier and len(left):
            row = words[frontier.pop()]
            near = np.bitwise_count(words[left] ^ row).sum(axis=1) <= distance
            found, left = left[near], left[~near]
            label[found] = root
            frontier.extend(found)
    return label


def links_of_buckets(
    bucket: np.ndarray, rep: np.ndarray, words: np.ndarray, distance: int
) -> tuple[np.ndarray, np.ndarray]:
    """Links (node, smallest node it reaches) of whole buckets, rows sorted by bucket and rep."""
    starts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
    sizes = np.diff(np.r_[starts, len(bucket)])
    label = np.arange(len(bucket))
    end = np.repeat(starts + sizes, sizes)
    rows = np.flatnonzero(np.repeat((sizes > 1) & (sizes <= SMALL), sizes))
    pairs, shift = [], 1
    while len(rows := rows[rows + shift < end[rows]]):
        near = np.bitwise_count(words[rows] ^ words[rows + shift]).sum(axis=1) <= distance
        pairs.append((rows[near], rows[near] + shift))
        shift += 1
    if pairs:
        label = _labels(len(bucket), *map(np.concatenate, zip(*pairs)))
    for start, size in zip(starts[sizes > SMALL], sizes[sizes > SMALL]):
        label[start : start + size] = start + _reach(words[start : start + size], distance)
    linked = np.flatnonzero(rep[label] != rep)
    return rep[linked], rep[label[linked]]


def _links(rows: DataFrame, scheme: Scheme) -> DataFrame:
    """(a, b): links within buckets; rows come sorted, a bucket at a time."""

    def found(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.empty((0, 2 + scheme.words), np.int64)

        def linked(rows: np.ndarray) -> pa.RecordBatch:
            a, b = links_of_buckets(
                rows[:, 0], rows[:, 1], rows[:, 2:].view(np.uint64), scheme.distance
            )
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        for table in tables:
            new = np.stack([c.to_numpy(zero_copy_only=False) for c in table.columns], axis=1)
            held = np.concatenate([held, new])
            last = np.searchsorted(held[:, 0], held[-1:, 0]) if len(held) else [0]
            if last[0]:
                yield linked(held[: last[0]])
                held = held[last[0] :]
        if len(held):
            yield linked(held)

    words = [f"w{k}" for k in range(scheme.words)]
    ordered = rows.select("bucket", "rep", *words).repartition("bucket")
    return ordered.sortWithinPartitions("bucket", "rep").mapInArrow(found, "a long, b long")


def near_duplicates(docs: DataFrame, scheme: Scheme = EXACT64, limit: int = LIMIT) -> DataFrame:
    """(id, w0.., component): signature and smallest document reachable, for every row.

    ``docs`` has doc_id and text. A null or empty text has no word: its
    signature is zero, and such documents are linked with each other. Rows
    without a ``doc_id`` get the component of an equal signature, or null if
    none has an id; they link nothing. Repeated rows get equal results. An
    empty table gives an empty result. Links are complete for the scheme: no
    bucket is capped.
    """
    words = [f"w{k}" for k in range(scheme.words)]
    signed = materialize(signatures(docs, scheme), "signatures")
    nodes = materialize(signed.groupBy(*words).agg(F.min("id").alias("rep")), "nodes")
    buckets = bucketed(nodes.filter("rep IS NOT NULL"), scheme, limit)
    roots = components(_links(buckets, scheme))
    named = nodes.join(roots, F.col("rep") == F.col("node"), "left").select(
        *words, F.coalesce("root", "rep").alias("component")
    )
    return signed.join(named, words).select("id", *words, "component")
