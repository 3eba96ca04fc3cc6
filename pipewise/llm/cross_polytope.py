"""Approximate nearest neighbours by cross-polytope hashing.

A vector, scaled to length 1, is turned by a pseudo-rotation (three times: signs
flipped at random, then a fast Hadamard transform) and assigned to the nearest
signed axis. A table's bucket is the axes of one or more such rotations; the
last rotation may keep fewer axes, so that buckets number about a quarter of the
vectors. A query probes buckets of all tables in the order of their cost, the
sum over rotations of the squared difference between the largest coordinate and
that of the bucket's axis.

How many buckets a query probes is measured, not set: the true neighbours of a
bounded sample of queries are found by one scan over all vectors, and the number
of probes is such that the wanted share of them (and a margin) is met.

Queries come in blocks of bounded size; a block and its probes, keyed by bucket,
are a broadcast variable. Tasks go through all vectors once a block, hash them
into the tables, look up which queries probe those buckets, and measure each
candidate once on the original vectors. A task keeps the nearest rows of each
query only, so candidates are never shuffled, and a bucket or a group of copies
of any size is spread over all the tasks that read its rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pipewise.sources.scratch import materialize

SEED = 11
K = 10
EVERY = 100
TABLES = 16
RECALL = 0.96
"""Share of the sample's true neighbours that the probes are to meet."""
SAMPLE = 128
"""Queries whose true neighbours are found by a scan, at most."""
PER_BUCKET = 4
"""Vectors a bucket holds on average, about."""
BLOCK_BYTES = 64 << 20
"""Queries with their probes that are broadcast at once."""
_PAIRS = 1 << 16
"""Distances a task works out at once."""


@dataclass(frozen=True)
class Index:
    """``signs[table][rotation][turn]`` are the flips; ``axes`` the axes kept of
    each rotation; ``probes`` the buckets a query looks into, over all tables."""

    dim: int
    axes: tuple[int, ...]
    signs: np.ndarray
    probes: int = 0

    @property
    def tables(self) -> int:
        return len(self.signs)


def hadamard(x: np.ndarray) -> np.ndarray:
    """The normalised Walsh-Hadamard transform of each row, by butterflies."""
    rows, n = x.shape
    half = 1
    while half < n:
        pairs = x.reshape(rows, n // (2 * half), 2, half)
        x = np.stack(
            [pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], axis=2
        ).reshape(rows, n)
        half *= 2
    return x / np.float32(np.sqrt(n))


def new_index(n: int, dim: int, tables: int = TABLES, seed: int = SEED) -> Index:
    """Tables for ``n`` vectors of ``dim`` components, with as many rotations as
    make the wanted number of buckets."""
    width = 1 << max(1, (dim - 1).bit_length())
    full = width.bit_length()  # bits of a signed axis
    bits = max(2, (n // PER_BUCKET).bit_length() - 1)
    axes = [width] * (bits // full)
    if bits % full:
        axes.append(1 << (bits % full - 1))
    signs = np.random.default_rng(seed).choice(
        np.array([-1, 1], np.float32), (tables, len(axes), 3, width)
    )
    return Index(dim, tuple(axes), signs)


def _turned(index: Index, unit: np.ndarray, table: int, rotation: int) -> np.ndarray:
    x = np.zeros((len(unit), index.signs.shape[-1]), np.float32)
    x[:, : index.dim] = unit
    for flips in index.signs[table, rotation]:
        x = hadamard(x * flips)
    return x[:, : index.axes[rotation]]


def _unit(vectors: np.ndarray) -> np.ndarray:
    largest = np.abs(vectors).max(axis=1, keepdims=True)
    scaled = vectors / largest  # so that squares neither vanish nor overflow
    return (scaled / np.linalg.norm(scaled, axis=1, keepdims=True)).astype(np.float32)


def _signed_axes(turned: np.ndarray) -> np.ndarray:
    """The nearest signed axis: twice its number, one more if it points backwards."""
    axis = np.abs(turned).argmax(axis=1)
    return 2 * axis + (turned[np.arange(len(turned)), axis] < 0)


def bucket_keys(index: Index, vectors: np.ndarray) -> np.ndarray:
    """The bucket of each vector in each table."""
    unit = _unit(vectors)
    keys = np.zeros((len(vectors), index.tables), np.int64)
    for table in range(index.tables):
        for rotation, axes in enumerate(index.axes):
            own = _signed_axes(_turned(index, unit, table, rotation))
            keys[:, table] = keys[:, table] * (2 * axes) + own
    return keys


def _axis_costs(index: Index, unit: np.ndarray, table: int) -> list[np.ndarray]:
    """Per rotation, the cost of every signed axis for every row."""
    costs = []
    for rotation in range(len(index.axes)):
        turned = _turned(index, unit, table, rotation)
        signed = np.stack([turned, -turned], axis=2).reshape(len(turned), -1)
        costs.append((signed.max(axis=1, keepdims=True) - signed) ** 2)
    return costs


def _cheapest(cost: np.ndarray, count: int) -> np.ndarray:
    if count >= len(cost):
        return np.arange(len(cost))
    return np.argpartition(cost, count)[:count]


def probe_keys(index: Index, vectors: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(table, bucket) of the ``probes`` buckets of least cost, for each vector.

    The buckets of least cost extend beginnings of least cost, so every
    rotation added needs only as many beginnings as there are probes.
    """
    unit = _unit(vectors)
    by_table = [_axis_costs(index, unit, table) for table in range(index.tables)]
    out = []
    for row in range(len(vectors)):
        costs, keys = [], []
        for rotations in by_table:
            cost, key = np.zeros(1, np.float32), np.zeros(1, np.int64)
            for axes in rotations:
                own = axes[row]
                cost = (cost[:, None] + own[None]).ravel()
                key = (key[:, None] * len(own) + np.arange(len(own))[None]).ravel()
                best = _cheapest(cost, index.probes)
                cost, key = cost[best], key[best]
            costs.append(cost)
            keys.append(key)
        table = np.repeat(np.arange(index.tables), [len(k) for k in keys])
        best = _cheapest(np.concatenate(costs), index.probes)
        out.append((table[best], np.concatenate(keys)[best]))
    return out


def probes_needed(index: Index, query: np.ndarray, neighbours: np.ndarray) -> np.ndarray:
    """How many probes it takes until the query looks into a bucket of each neighbour."""
    by_table = [_axis_costs(index, _unit(query[None]), t) for t in range(index.tables)]
    keys = bucket_keys(index, neighbours)
    least = np.full(len(neighbours), np.inf, np.float32)
    for table, rotations in enumerate(by_table):
        rest, total = keys[:, table].copy(), np.zeros(len(neighbours), np.float32)
        for axes in reversed(rotations):
            rest, own = np.divmod(rest, axes.shape[1])
            total += axes[0][own]
        least = np.minimum(least, total)
    needed = np.zeros(len(neighbours), np.int64)
    for *first, last in by_table:
        start = np.zeros(1, np.float32)
        for axes in first:
            start = (start[:, None] + axes[0][None]).ravel()
        last = np.sort(last[0])
        for at, cost in enumerate(least):
            # sums in another order differ in the last bits
            needed[at] += np.searchsorted(last, cost * (1 + 1e-5) + 1e-7 - start, "right").sum()
    return needed


# --- rows ----------------------------------------------------------------------


def usable(vectors: DataFrame, vector: str = "embedding", id_column: str = "vec_id") -> DataFrame:
    """(id, v): rows with an id and a vector that has a direction, as doubles."""
    rows = vectors.select(
        F.col(f"`{id_column}`").cast("long").alias("id"),
        F.col(f"`{vector}`").cast("array<double>").alias("v"),
    )
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.where(F.col("id").isNotNull() & finite & F.exists("v", lambda x: x != 0))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(((a - b) ** 2).sum(axis=1))


class _Nearest:
    """The ``k`` nearest rows of every query so far; rows under one id count once."""

    def __init__(self, k: int, queries: int):
        self.k = k
        self.query, self.id = np.empty(0, np.int64), np.empty(0, np.int64)
        self.distance = np.empty(0)
        self.worst = np.full(queries, np.inf)
        """No row beyond is among the nearest of a query any more."""

    def add(self, query: np.ndarray, id: np.ndarray, distance: np.ndarray) -> None:
        near = distance <= self.worst[query]
        query = np.concatenate([self.query, query[near]])
        id = np.concatenate([self.id, id[near]])
        distance = np.concatenate([self.distance, distance[near]])
        order = np.lexsort([distance, id, query])
        query, id, distance = query[order], id[order], distance[order]
        first = np.r_[True, (query[1:] != query[:-1]) | (id[1:] != id[:-1])][: len(query)]
        query, id, distance = query[first], id[first], distance[first]
        order = np.lexsort([id, distance, query])
        query, id, distance = query[order], id[order], distance[order]
        starts = np.flatnonzero(np.r_[True, query[1:] != query[:-1]][: len(query)])
        sizes = np.diff(np.r_[starts, len(query)])
        place = np.arange(len(query)) - np.repeat(starts, sizes)
        self.worst[query[place == self.k - 1]] = distance[place == self.k - 1]
        near = place < self.k
        self.query, self.id, self.distance = query[near], id[near], distance[near]


Candidates = Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]
"""From a batch of vectors to pairs (row, query), each pair once."""
Block = Callable[[], tuple[np.ndarray, np.ndarray, Candidates]]
"""Ids, vectors and candidates of a block of queries, as a task gets them."""


def _scan(rows: DataFrame, dim: int, k: int, block: Block) -> DataFrame:
    """(query_id, id, distance): the ``k`` nearest candidates of each query in
    each task."""

    def search(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, queries, candidates = block()
        nearest = _Nearest(k, len(ids))
        for table in tables:
            if not table.num_rows:
                continue
            own_ids, own = table.column(0).to_numpy(), _matrix(table.column(1), dim)
            row, query = candidates(own)
            for at in range(0, len(row), _PAIRS):
                r, q = row[at : at + _PAIRS], query[at : at + _PAIRS]
                nearest.add(q, own_ids[r], distances(own[r], queries[q]))
        yield pa.RecordBatch.from_arrays(
            [pa.array(x) for x in (ids[nearest.query], nearest.id, nearest.distance)],
            names=["query_id", "id", "distance"],
        )

    return rows.mapInArrow(search, "query_id long, id long, distance double")


def first_k(found: DataFrame, query: str, k: int) -> DataFrame:
    """The ``k`` nearest rows of each query, numbered from 1; one row an id."""
    nearest = found.groupBy(query, "id").agg(F.min("distance").alias("distance"))
    order = Window.partitionBy(query).orderBy("distance", "id")
    return nearest.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _all_pairs(own: np.ndarray, queries: int) -> tuple[np.ndarray, np.ndarray]:
    return np.repeat(np.arange(len(own)), queries), np.tile(np.arange(queries), len(own))


def fit(rows: DataFrame, queries: DataFrame, n: int, dim: int, k: int = K, tables: int = TABLES,
        recall: float = RECALL, sample: int = SAMPLE, seed: int = SEED) -> Index:
    """An index whose number of probes meets ``recall`` of the true neighbours of
    a sample of at most ``sample`` of the queries, those of the smallest hash.

    The driver holds the sample, its neighbours and their vectors: at most
    ``sample`` times ``k + 1`` rows.
    """
    index = new_index(n, dim, tables, seed)
    drawn = queries.orderBy(F.xxhash64(F.lit(seed), "id"), "id").limit(sample).collect()
    asked = np.array([r.v for r in drawn])
    numbers = np.arange(len(asked))
    found = _scan(rows, dim, k + 1, lambda: (numbers, asked, lambda own: _all_pairs(own, len(asked))))
    near = materialize(first_k(found, "query_id", k + 1), "true-neighbours")
    needed: list[int] = []
    vectors: dict[int, list] = {}
    for r in near.join(rows, "id").select("query_id", "id", "distance", "v").collect():
        if drawn[r.query_id].id != r.id:
            vectors.setdefault(r.query_id, []).append((r.distance, r.id, r.v))
    for query, own in vectors.items():
        own = np.array([v for _, _, v in sorted(own)[:k]])
        needed += probes_needed(index, asked[query], own).tolist()
    needed.sort()
    at = min(len(needed) - 1, int(np.ceil(recall * len(needed))))
    return Index(dim, index.axes, index.signs, max(1, needed[at]) if needed else 1)


def _probing(index: Index, queries: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per table, the buckets probed in ascending order, and by which query."""
    found = probe_keys(index, queries)
    table = np.concatenate([t for t, _ in found])
    key = np.concatenate([b for _, b in found])
    query = np.repeat(np.arange(len(queries), dtype=np.int32), [len(t) for t, _ in found])
    order = np.lexsort([query, key, table])
    cuts = np.searchsorted(table[order], np.arange(index.tables + 1))
    key, query = key[order].astype(np.int64), query[order]
    return [(key[a:b], query[a:b]) for a, b in zip(cuts, cuts[1:])]


def _by_tables(index: Index, probing, queries: int) -> Candidates:
    """Rows with the queries that probe one of their buckets."""

    def of(own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keys, met = bucket_keys(index, own), []
        for table, (buckets, query) in enumerate(probing):
            low = np.searchsorted(buckets, keys[:, table], "left")
            sizes = np.searchsorted(buckets, keys[:, table], "right") - low
            row = np.repeat(np.arange(len(own)), sizes)
            at = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            met.append(row * queries + query[np.repeat(low, sizes) + at])
        return np.divmod(np.unique(np.concatenate(met)), queries)

    return of


def _blocks(queries: DataFrame, count: int, size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, vectors), at most about ``size`` queries at a time, by hash of the id."""
    parts = -(-count // size)
    for part in range(parts):
        own = queries.where(F.pmod(F.xxhash64("id"), F.lit(parts)) == part).collect()
        if own:
            yield np.array([r.id for r in own]), np.array([r.v for r in own])


def nearest_neighbours(vectors: DataFrame, k: int = K, every: int = EVERY,
                       is_query: Column | None = None, vector: str = "embedding",
                       id_column: str = "vec_id", tables: int = TABLES, recall: float = RECALL,
                       sample: int = SAMPLE, block_bytes: int = BLOCK_BYTES,
                       seed: int = SEED) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest rows found for every query.

    Queries are the rows whose id ``every`` divides (or ``is_query``, over the
    column id), candidates all rows but those under the query's own id. Score is
    the Euclidean distance of the original vectors; ties go to the smaller id.
    A query with fewer candidates than ``k`` gets all it finds. Equal query
    vectors are searched once. Where ids repeat, an id counts once among the
    neighbours, at its nearest row, and a repeated query is the smallest of its
    vectors. Rows without an id, and vectors that are null, empty, zero or hold
    a null or non-finite component take no part; nor do those of another length
    than most (the longer one, if two are as common). An empty table, or one
    without queries, gives no rows. Other columns play no part.
    """
    spark = vectors.sparkSession
    schema = "query_id long, rank int, vec_id long, score double"
    rows = usable(vectors, vector, id_column)
    lengths = rows.groupBy(F.size("v").alias("dim")).count()
    common = lengths.orderBy(F.desc("count"), F.desc("dim")).first()
    if common is None:
        return spark.createDataFrame([], schema)
    n, dim = common["count"], common["dim"]
    rows = rows.where(F.size("v") == dim)
    wanted = F.col("id") % every == 0 if is_query is None else is_query
    asked = materialize(rows.where(wanted).groupBy("id").agg(F.min("v").alias("v")), "queries")
    distinct = materialize(asked.groupBy("v").agg(F.min("id").alias("id")), "distinct-queries")
    count = distinct.count()
    if not count:
        return spark.createDataFrame([], schema)
    index = fit(rows, distinct, n, dim, k, tables, recall, sample, seed)
    found = []
    for ids, own in _blocks(distinct, count, max(1, block_bytes // (8 * dim + 12 * index.probes))):
        shared = spark.sparkContext.broadcast((ids, own, _probing(index, own)))

        def block(shared=shared):
            ids, own, probing = shared.value
            return ids, own, _by_tables(index, probing, len(ids))

        # each block is written, so that a lost executor costs a block at most
        found.append(materialize(_scan(rows, dim, k + 1, block), "nearest"))
    nearest = found[0]
    for more in found[1:]:
        nearest = nearest.unionByName(more)
    nearest = first_k(nearest, "query_id", k + 1)
    members = asked.select("v", F.col("id").alias("member")).join(
        distinct.select("v", F.col("id").alias("query_id")), "v"
    )
    own = members.join(nearest, "query_id").where("member <> id")
    order = Window.partitionBy("member").orderBy("distance", "id")
    return (
        own.select("member", "id", "distance")
        .withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
        .select(F.col("member").alias("query_id"), "rank", F.col("id").alias("vec_id"),
                F.col("distance").alias("score"))
    )
