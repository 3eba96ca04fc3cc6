"""Near copies by similarity: SimHash tables propose, shingle sets decide.

Documents with one and the same set of shingle hashes are one node, named by
the smallest of them. A node's signature is several 64-bit SimHash words over
its set; the bands of each word are covered by masks (``simhash``), so nodes that
differ in at most ``radius`` bits of some band meet in a bucket. Within a bucket
every node first proposes one link, to the nearest node of smaller id, if the words
that travel with it differ by no more than near copies do. When these are checked,
all other pairs of a bucket that are as near and not yet of one component are
proposed too, so a bucket hides no partner, and a large group of near copies is
not compared pair by pair.

Links whose whole signatures differ by more than near copies do are dropped next,
so that texts that share little are not compared. A link counts only if the Jaccard similarity of the two shingle sets is reached,
so nothing below it is ever linked. The links of least distance, one per node,
are checked first: texts meet once per document. What is left then are links
between different components, checked one by one.

Signatures are an estimate: how many of the pairs at the similarity and above
are found is measured by the tests (``test_near_copies``).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pipewise.llm import simhash
from pipewise.llm.components import components
from pipewise.llm.passages import bitmap, marked
from pipewise.llm.shared import text_of, unpacked, whole_row
from pipewise.llm.simhash import LIMIT, SMALL, Scheme
from pipewise.sources.scratch import materialize


SIMILARITY = 0.8
SHINGLE = 5
RECALL = 0.93
"""Chance that a pair right at the similarity meets in some bucket, as far as
bits are independent; more alike pairs meet more surely."""
COMPARED = 1
"""Words of the signature that travel with a bucket's rows."""

HELD_BYTES = 8 << 20
"""Shingle sets that a task which checks links holds at once."""
SAMPLED = 16
"""One node in so many is counted to tell which buckets are large."""


def _expected_bits(bits: int, similarity: float) -> int:
    """Differing bits of near copies: three deviations more than on average. A
    similarity s is a cosine of 2s / (1 + s), hence a share acos(cosine) / pi."""
    share = np.arccos(2 * similarity / (1 + similarity)) / np.pi
    return int(bits * share + 3 * np.sqrt(bits * share * (1 - share)))


def scheme_for(n: int, similarity: float = SIMILARITY, shingle: int = SHINGLE,
               recall: float = RECALL) -> Scheme:
    """Tables for ``n`` documents.

    Keys have about log2(n) bits, so that buckets stay small
    whatever n; a band is half as wide again, covered for one differing bit by
    three tables. Words of three bands each are added until the recall is met:
    9 up to 2^18 documents.
    """
    share = np.arccos(2 * similarity / (1 + similarity)) / np.pi
    width = min(64, max(16, n.bit_length() - 2) * 3 // 2)
    met = (1 - share) ** width + width * share * (1 - share) ** (width - 1)
    bands = np.log(1 - recall) / np.log(1 - met)
    words = int(np.ceil(bands / 3))
    distance = _expected_bits(64 * COMPARED, similarity)
    cuts = ((0, width), ((64 - width) // 2, (64 + width) // 2), (64 - width, 64))
    return Scheme(shingle, words, cuts, 1, distance, words)


def shingle_set(text: bytes | None, size: int) -> np.ndarray:
    """The distinct shingle hashes in ascending order; empty without a word."""
    blocks = [*simhash.shingle_hashes(text or b"", size)]
    return np.unique(np.concatenate(blocks)) if blocks else np.empty(0, np.uint64)


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    either = len(a) + len(b) - both
    return both / either if either else 1.0


def _signature(found: np.ndarray, scheme: Scheme) -> np.ndarray:
    """A bit is 1 if it is set in over half of the set's hashes."""
    words = [simhash.bit_counts(simhash.hash_word(found, k)) for k in range(scheme.words)]
    return np.packbits(2 * np.array(words) > len(found), axis=1).view(">u8").ravel().astype(np.uint64)


def signed_sets(docs: DataFrame, scheme: Scheme) -> DataFrame:
    """(id, h, x, y, w0, w1, ...): hash of the text, digest and signature of the
    shingle set of every row."""
    names = ["id", "h", "x", "y", *[f"w{k}" for k in range(scheme.words)]]

    def signed(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in tables:
            rows = np.zeros((table.num_rows, len(names) - 2), np.int64)
            for at, text in enumerate(table.column(2)):
                found = shingle_set(text.as_py(), scheme.shingle)
                rows[at, :2] = np.frombuffer(xxhash.xxh3_128_digest(found.tobytes()), np.int64)
                rows[at, 2:] = _signature(found, scheme).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [*table.columns[:2], *[pa.array(c) for c in rows.T.copy()]], names=names
            )

    text = text_of("text")
    texts = docs.select(F.col("doc_id").cast("long"), F.xxhash64(text), text.cast("binary"))
    return texts.mapInArrow(signed, ", ".join(f"{n} long" for n in names))


def nearest_smaller(
    bucket: np.ndarray, rep: np.ndarray, words: np.ndarray, distance: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(node, nearest node of smaller id in its bucket, bits between them), for
    nodes that have one within ``distance``; rows sorted by bucket and rep."""
    starts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
    sizes = np.diff(np.r_[starts, len(bucket)])
    best = np.full(len(bucket), distance + 1)
    to = np.arange(len(bucket))
    end = np.repeat(starts + sizes, sizes)
    rows, shift = np.flatnonzero(np.repeat((sizes > 1) & (sizes <= SMALL), sizes)), 1
    while len(rows := rows[rows + shift < end[rows]]):
        bits = np.bitwise_count(words[rows] ^ words[rows + shift]).sum(axis=1)
        near = bits <= np.minimum(best[rows + shift], distance)
        near &= rep[rows] != rep[rows + shift]
        best[rows[near] + shift], to[rows[near] + shift] = bits[near], rows[near]
        shift += 1
    for start, size in zip(starts[sizes > SMALL], sizes[sizes > SMALL]):
        for row in range(start + 1, start + size):
            bits = np.bitwise_count(words[start:row] ^ words[row]).sum(axis=1)
            bits[rep[start:row] == rep[row]] = distance + 1
            at = int(bits.argmin())
            if bits[at] <= distance:
                best[row], to[row] = bits[at], start + at
    linked = np.flatnonzero(best <= distance)
    return rep[linked], rep[to[linked]], best[linked]


def pairs_apart(
    bucket: np.ndarray, rep: np.ndarray, root: np.ndarray, words: np.ndarray, distance: int
) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(node, node of smaller id in its bucket, bits between them), in blocks: all
    pairs within ``distance`` of different roots; rows sorted by bucket and rep."""
    starts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
    sizes = np.diff(np.r_[starts, len(bucket)])
    end = np.repeat(starts + sizes, sizes)
    rows, shift = np.flatnonzero(np.repeat((sizes > 1) & (sizes <= SMALL), sizes)), 1
    while len(rows := rows[rows + shift < end[rows]]):
        apart = rows[root[rows] != root[rows + shift]]
        bits = np.bitwise_count(words[apart] ^ words[apart + shift]).sum(axis=1)
        near = (bits <= distance) & (rep[apart] != rep[apart + shift])
        yield rep[apart[near] + shift], rep[apart[near]], bits[near]
        shift += 1
    for start, size in zip(starts[sizes > SMALL], sizes[sizes > SMALL]):
        for row in range(start + 1, start + size):
            apart = start + np.flatnonzero(root[start:row] != root[row])
            bits = np.bitwise_count(words[apart] ^ words[row]).sum(axis=1)
            near = (bits <= distance) & (rep[apart] != rep[row])
            yield np.full(near.sum(), rep[row]), rep[apart[near]], bits[near]


BLOCK = 1 << 16
"""Pairs that a task hands on at once."""


def _in_blocks(links: Iterator[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for link in links:
        held.append(link)
        size += len(link[0])
        if size > BLOCK or len(held) > BLOCK:
            yield _batch(held)
            held, size = [], 0
    if held:
        yield _batch(held)


def _batch(links: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
    columns = [pa.array(np.concatenate(c).astype(np.int64)) for c in zip(*links)]
    return pa.RecordBatch.from_arrays(columns, names=["a", "b", "bits"])


def proposed_links(nodes: DataFrame, scheme: Scheme, limit: int = LIMIT) -> DataFrame:
    """(a, b, bits): b is smaller than a; each pair once.

    Nodes without a ``root`` propose their nearest in every bucket; nodes with one
    propose all nodes of other roots.
    """
    compared = [f"w{k}" for k in range(COMPARED)]
    every = "root" in nodes.columns
    carried = ["rep", *(["root"] if every else []), *compared]
    rows = simhash.bucketed(nodes, scheme, limit, carried, min(SAMPLED, limit))

    def linked(rows: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        words = rows[:, -len(compared) :].view(np.uint64)
        if every:
            return pairs_apart(*rows[:, :3].T, words, scheme.distance)
        return iter([nearest_smaller(*rows[:, :2].T, words, scheme.distance)])

    def found(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.empty((0, 1 + len(carried)), np.int64)
        for table in tables:
            new = np.stack([c.to_numpy(zero_copy_only=False) for c in table.columns], axis=1)
            held = np.concatenate([held, new])
            last = np.searchsorted(held[:, 0], held[-1:, 0]) if len(held) else [0]
            if last[0]:
                yield from _in_blocks(linked(held[: last[0]]))
                held = held[last[0] :]
        if len(held):
            yield from _in_blocks(linked(held))

    ordered = rows.select("bucket", *carried).repartition("bucket")
    links = ordered.sortWithinPartitions("bucket", "rep").mapInArrow(
        found, "a long, b long, bits long"
    )
    return links.groupBy("a", "b").agg(F.min("bits").alias("bits"))


def _packed_texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(id, packed): the texts of the nodes (rep, h). Written: texts that take part
    in no link are mostly told by a bitmap of a fixed size and stay where they are."""

    def pack(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compress = zstandard.ZstdCompressor(level=3).compress
        for table in tables:
            texts = pa.array([compress(t.as_py()) for t in table.column(1)], pa.binary())
            yield pa.RecordBatch.from_arrays([table.column(0), texts], names=["id", "packed"])

    text = text_of("text")
    rows = docs.select(
        F.col("doc_id").cast("long").alias("id"),
        F.xxhash64(text).alias("h"),
        text.cast("binary").alias("text"),
    )
    ids = bitmap(wanted.select(F.col("rep").alias("id")))
    listed = marked(rows, ids).where("listed").select("id", "h", "text")
    once = listed.dropDuplicates(["id", "h"])
    own = once.join(wanted, (once["id"] == wanted["rep"]) & (once["h"] == wanted["h"]), "left_semi")
    packed = own.select("id", "text").mapInArrow(pack, "id long, packed binary")
    return materialize(packed, "linked-texts")


def checked(links: DataFrame, texts: DataFrame, similarity: float, shingle: int) -> DataFrame:
    """Those of the links (a, b) whose shingle sets reach the similarity. Written.

    Texts are unpacked in the tasks, a pair at a time; rows come sorted by b, so
    the set of a node that many link to is made once a task, and sets of nodes with
    many links are held up to HELD_BYTES.
    """

    def compare(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        last, target = None, None
        held, size = {}, 0
        for table in tables:
            near = []
            for a, b, own, other in zip(*(table.column(k) for k in range(4))):
                if b != last:
                    last, target = b, shingle_set(unpack(other.as_py()), shingle)
                found = held.get(a := a.as_py())
                if found is None:
                    if size > HELD_BYTES:
                        held, size = {}, 0
                    held[a] = found = shingle_set(unpack(own.as_py()), shingle)
                    size += found.nbytes
                near.append(jaccard(found, target) >= similarity - 1e-9)
            yield table.select([0, 1]).filter(pa.array(near, pa.bool_()))

    first = links.select("a", "b").join(texts.select(F.col("id").alias("a"), F.col("packed").alias("own")), "a")
    both = first.join(texts.select(F.col("id").alias("b"), F.col("packed").alias("other")), "b")
    found = both.select("a", "b", "own", "other").mapInArrow(compare, "a long, b long")
    return materialize(found, "checked-links")


def _by_signature(links: DataFrame, nodes: DataFrame, scheme: Scheme, similarity: float) -> DataFrame:
    """(a, b, bits) of the links whose whole signatures are as near as near copies
    are; bits counts over all words."""
    words = [f"w{k}" for k in range(scheme.words)]
    first = nodes.select(F.col("rep").alias("a"), F.array(*words).alias("wa"))
    second = nodes.select(F.col("rep").alias("b"), F.array(*words).alias("wb"))
    both = links.select("a", "b").join(first, "a").join(second, "b")
    bits = sum(
        (F.bit_count(F.get("wa", F.lit(k)).bitwiseXOR(F.get("wb", F.lit(k)))) for k in range(scheme.words)),
        F.lit(0),
    )
    counted = both.select("a", "b", bits.alias("bits"))
    return counted.where(F.col("bits") <= _expected_bits(64 * scheme.words, similarity))


def _apart(links: DataFrame, roots: DataFrame) -> DataFrame:
    """Links between nodes of different components."""
    root = roots.select(F.col("node").alias("a"), F.col("root").alias("root_a"))
    joined = links.join(root, "a", "left")
    joined = joined.join(root.toDF("b", "root_b"), "b", "left")
    return joined.where(F.coalesce("root_a", "a") != F.coalesce("root_b", "b")).select("a", "b")


def _nodes(docs: DataFrame, scheme: Scheme) -> tuple[DataFrame, DataFrame]:
    """(id, h, x, y) of the text that speaks for each id, and the nodes
    (x, y, rep, h, w0, ...). Both written."""
    words = [f"w{k}" for k in range(scheme.words)]
    signed = materialize(signed_sets(docs, scheme), "signed-sets")
    own = signed.where("id IS NOT NULL").groupBy("id").agg(
        F.min(F.struct("h", "x", "y", *words)).alias("s")
    )
    own = materialize(own.select("id", "s.*"), "own-sets")
    nodes = own.groupBy("x", "y").agg(F.min(F.struct("id", "h", *words)).alias("s"))
    nodes = nodes.select("x", "y", F.col("s.id").alias("rep"), "s.h", *[f"s.{w}" for w in words])
    return own.select("id", "h", "x", "y"), materialize(nodes, "set-nodes")


def _roots(docs: DataFrame, nodes: DataFrame, scheme: Scheme, similarity: float, limit: int) -> DataFrame:
    """(node, root) of the nodes that are not the smallest of their group."""
    proposed = materialize(proposed_links(nodes, scheme, limit), "proposed-links")
    links = materialize(_by_signature(proposed, nodes, scheme, similarity), "near-links")
    texts = _texts_of(links, docs, nodes)
    best = links.groupBy("a").agg(F.min(F.struct("bits", "b")).alias("s")).select("a", "s.b")
    first = checked(best, texts, similarity, scheme.shingle)
    roots = components(first)
    rest = materialize(_apart(links.select("a", "b").join(best, ["a", "b"], "left_anti"), roots), "links-apart")
    if not rest.isEmpty():
        first = first.union(checked(rest, texts, similarity, scheme.shingle))
        roots = components(first)
    more = _links_left(links, nodes, roots, scheme, similarity, limit)
    if more.isEmpty():
        return roots
    texts = _texts_of(more, docs, nodes)
    return components(first.union(checked(more, texts, similarity, scheme.shingle)))


def _texts_of(links: DataFrame, docs: DataFrame, nodes: DataFrame) -> DataFrame:
    ends = links.select(F.explode(F.array("a", "b")).alias("rep")).distinct()
    return _packed_texts(docs, materialize(nodes.join(ends, "rep", "left_semi").select("rep", "h"), "linked"))


def _links_left(links: DataFrame, nodes: DataFrame, roots: DataFrame, scheme: Scheme,
                similarity: float, limit: int) -> DataFrame:
    """(a, b) of the pairs in a bucket that no link was proposed for, as near as near
    copies are, between nodes not yet known to be of one component. Written.

    The nearest of a bucket need not be the most alike by shingles; whatever it
    hides is proposed here. Groups found by then are left out pair by pair, so
    what is handed on are few pairs, however large a group of near copies.
    """
    named = nodes.join(roots, nodes["rep"] == roots["node"], "left")
    named = named.select(nodes["*"], F.coalesce("root", "rep").alias("root"))
    apart = materialize(proposed_links(named, scheme, limit), "proposed-apart")
    near = _by_signature(apart, nodes, scheme, similarity).select("a", "b")
    return materialize(near.join(links, ["a", "b"], "left_anti"), "links-left")


def similar_documents(docs: DataFrame, similarity: float = SIMILARITY, shingle: int = SHINGLE,
                      limit: int = LIMIT) -> DataFrame:
    """(id, component): the smallest id that each id reaches over near copies.

    ``docs`` has doc_id and text; one row per distinct id that is not null. Texts
    without a word are alike. Of several texts under one id the one of the
    smallest hash speaks for it. An empty table gives no rows.
    """
    scheme = scheme_for(docs.count(), similarity, shingle)
    own, nodes = _nodes(docs, scheme)
    roots = _roots(docs, nodes, scheme, similarity, limit)
    named = nodes.join(roots, nodes["rep"] == roots["node"], "left").select(
        "x", "y", F.coalesce("root", "rep").alias("component")
    )
    return own.join(named, ["x", "y"]).select("id", "component")


def keep_one_of_each(docs: DataFrame, similarity: float = SIMILARITY, shingle: int = SHINGLE,
                     limit: int = LIMIT) -> DataFrame:
    """The documents, same columns, less all but the smallest ``doc_id`` of each
    group of near copies.

    Of rows repeated under that id one stays: the text of the smallest hash, and
    of equal texts the smallest row. Rows without an id cannot be grouped and
    stay.
    """
    scheme = scheme_for(docs.count(), similarity, shingle)
    _, nodes = _nodes(docs, scheme)
    roots = _roots(docs, nodes, scheme, similarity, limit)
    kept = materialize(
        nodes.join(roots, nodes["rep"] == roots["node"], "left_anti").select("rep", "h"), "kept"
    )
    rows = docs.select(
        F.col("doc_id").cast("long").alias("id"),
        F.xxhash64(text_of("text")).alias("h"),
        whole_row(docs).alias("row"),
    )
    lone = rows.where("id IS NULL").select("row")
    # rows repeated under one id are one before the join, combined map-side
    once = rows.where("id IS NOT NULL").groupBy("id", "h").agg(F.min("row").alias("row"))
    own = once.join(kept, (once["id"] == kept["rep"]) & (once["h"] == kept["h"]), "left_semi")
    return unpacked(own.select("row").union(lone), "row", docs)
