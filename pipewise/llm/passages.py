"""Which windows of text occur at an earlier place: the common frame of
substring dedup (words) and suffix-array dedup (bytes).

A window is a number of tokens in a row of one document. All windows of all
texts cannot be shuffled, so text that cannot repeat is sieved out first:

1. Every window picks one of its grams by content (the first with the smallest
   hash). Equal windows pick equal grams, so a window whose pick is found in no
   other place has no equal. Only picks, a few per hundred tokens, are shuffled
   and counted, combined before the shuffle.
2. What is left is cut into segments: the windows in a row that share a pick.
   Equal windows lie in segments with the same pick, at the same distance from
   it. Equal segments are one, told by a 128-bit digest; their first place is
   kept with them.
3. Distinct segments of a pick meet in one task, where the operator's own
   method finds the windows that occur earlier. A pick with over ``limit``
   distinct segments is taken apart by its earliest holder, found by a grouped
   minimum: every segment is extended from the pick against it, word by word. The
   windows both have are settled. The others reach past the first difference on
   one side; with it the anchor grows by a token or more, and segments meet again
   by the longer anchor. A round has at most two rows per segment, whatever the
   size of the group, and there are at most as many rounds as a window is
   longer than a gram; in practice two or three.
4. Windows found are joined with the places of their segments, and documents
   with the runs of windows they lose.

Whole copies of a text are settled by their digest. Documents that take part in
a step are found by a bitmap of a fixed number of bits, joined as a broadcast,
so that texts without a part in it are not shuffled; a full bitmap would only
let more texts through.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pipewise.llm.grams import picked, rolling, runs, word_bounds, word_codes
from pipewise.llm.shared import record_batch, text_of
from pipewise.sources.scratch import materialize

BITMAP_WORDS = 1 << 20
"""Words of 64 bits of a bitmap: 16 MB at most as a broadcast table."""
CHUNK_BYTES = 2 << 20
"""Bytes of segments that are matched at once."""
TEXTS = 2500
"""Texts whose segments a task holds at once, before equal ones become one row."""
SALTS = 16
"""Parts that the segments of one pick are dealt to when they meet its earliest holder."""
_SHIFT = np.uint64(1)


@dataclass(frozen=True)
class Segment:
    """Windows in a row that share a pick: ``count`` windows of one text."""

    key: int
    doc: int
    start: int
    count: int
    payload: bytes
    at: int
    """Place in the segment of the tokens that its group has in common,"""
    size: int
    """and their number."""


Matcher = Callable[[list[Segment]], list[np.ndarray]]
"""From whole groups of segments (sorted by key, document and start) to the
offsets of the windows that occur at an earlier place among them."""


@dataclass(frozen=True)
class Passages:
    """window, gram: tokens; within: an earlier place in the same document counts."""

    window: int
    gram: int
    by_word: bool
    within: bool
    limit: int
    match: Matcher

    def codes(self, text: bytes) -> np.ndarray:
        buffer = np.frombuffer(text, np.uint8)
        if not self.by_word:
            return buffer.astype(np.uint64) + np.uint64(1)
        return word_codes(buffer, *word_bounds(buffer))

    def picks(self, text: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Place of the gram each window picks, and the name of the gram (63 bits)."""
        hashes = rolling(self.codes(text), self.gram)
        place = picked(hashes, self.window - self.gram + 1)
        return place, (hashes[place] >> _SHIFT).astype(np.int64)

    def payload(self, text, start: int, count: int) -> bytes:
        part = text[start : start + count + self.window - 1]
        return b" ".join(part) if self.by_word else bytes(part)

    def tokens(self, payload: bytes) -> list[bytes] | bytes:
        return payload.split() if self.by_word else payload

    def joined(self, tokens) -> bytes:
        return b" ".join(tokens) if self.by_word else tokens


def _keyed(docs: DataFrame) -> DataFrame:
    """(id, a, b, text): a row's id, the digest of its text, its bytes."""
    text = text_of(docs["text"])
    return docs.select(
        docs["doc_id"].cast("long").alias("id"),
        F.xxhash64(text).alias("a"),
        F.xxhash64(F.lit("second"), text).alias("b"),
        text.cast("binary").alias("text"),
    )


def _anchors(docs: DataFrame, kind: Passages) -> DataFrame:
    """(id, a, picks, own): the distinct picks of a text, and whether one is found
    at two places of it."""

    def found(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in tables:
            rows = []
            for i, a, text in zip(*(table.column(k).to_pylist() for k in range(3))):
                place, names = kind.picks(text)
                if len(place):
                    names = names[np.r_[True, place[1:] != place[:-1]]]
                    distinct = np.unique(names)
                    rows.append((i, a, distinct, len(distinct) < len(names)))
            yield record_batch(rows, "id long, a long, picks array<long>, own boolean")

    rows = docs.filter("id IS NOT NULL").select("id", "a", "text")
    return rows.mapInArrow(found, "id long, a long, picks array<long>, own boolean")


def _shift(word: Column, by: Column) -> Column:
    return F.call_function("shiftleft", word, by)


def bitmap(ids: DataFrame) -> DataFrame:
    """(word, bits) of the ids: at most BITMAP_WORDS rows, whatever their number."""
    place = F.pmod(F.xxhash64("id"), F.lit(64 * BITMAP_WORDS))
    one = F.lit(1).cast("long")
    return (
        ids.select(
            F.floor(place / 64).alias("word"),
            _shift(one, (place % 64).cast("int")).alias("bit"),
        )
        .groupBy("word")
        .agg(F.bit_or("bit").alias("bits"))
    )


def marked(docs: DataFrame, bits: DataFrame) -> DataFrame:
    """The rows with a column ``listed``: false if the id is surely not in the bitmap."""
    place = F.pmod(F.xxhash64("id"), F.lit(64 * BITMAP_WORDS))
    bit = _shift(F.lit(1).cast("long"), (place % 64).cast("int"))
    joined = docs.withColumn("word", F.floor(place / 64)).join(F.broadcast(bits), "word", "left")
    listed = F.col("id").isNotNull() & (F.coalesce(F.col("bits").bitwiseAND(bit), F.lit(0)) != 0)
    return joined.withColumn("listed", listed).drop("word", "bits")


def _touching(settled: list[tuple]) -> Iterator[tuple]:
    """Runs (id, a, start, count) put together where they touch."""
    held = None
    for i, a, start, count in sorted(settled):
        if held and held[:2] == (i, a) and start <= held[2] + held[3]:
            held = (i, a, held[2], max(held[3], start + count - held[2]))
            continue
        if held:
            yield held
        held = (i, a, start, count)
    if held:
        yield held


PLACES = "key long, a long, b long, id long, text_a long, start int, count int, at int, payload binary"


def _segments(docs: DataFrame, kind: Passages) -> DataFrame:
    """Segments of the texts in ``docs`` (id, a, text, live), one row per place.

    Segments that TEXTS rows in a row hold twice give one row; of the others, those
    that surely occur earlier become rows without a key (all windows are lost),
    the rest rows without payload. Runs without a key that touch are one row.
    """

    def found(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = (t.slice(k, TEXTS) for t in tables for k in range(0, t.num_rows, TEXTS))
        for table in parts:
            held: dict[tuple[int, bytes], list[tuple]] = {}
            seen = set()
            for i, a, text, live in zip(*(table.column(k).to_pylist() for k in range(4))):
                if (i, a) in seen:
                    continue
                seen.add((i, a))
                place, names = kind.picks(text)
                first = np.r_[True, place[1:] != place[:-1]]
                wanted = np.isin(names, np.array(live or [], np.int64))
                if kind.within:
                    every, counts = np.unique(names[first], return_counts=True)
                    wanted |= np.isin(names, every[counts > 1])
                starts = np.flatnonzero(first)
                lengths = np.diff(np.r_[starts, len(place)])
                own = text.split() if kind.by_word else text
                for k in np.flatnonzero(wanted[starts]).tolist():
                    start, count = int(starts[k]), int(lengths[k])
                    payload = kind.payload(own, start, count)
                    name = (int(names[start]), payload)
                    held.setdefault(name, []).append((i, start, a, count, int(place[start]) - start))
            rows, settled = [], []
            for (key, payload), places in held.items():
                digest = xxhash.xxh3_128_intdigest(payload)
                dig = [(x & (1 << 64) - 1) - (1 << 63) for x in (digest, digest >> 64)]
                places.sort()
                i, start, a, count, at = places[0]
                rows.append((key, *dig, i, a, start, count, at, payload))
                for j, start, a, count, at in places[1:]:
                    if kind.within or j > i:
                        settled.append((j, a, start, count))
                    else:
                        rows.append((key, *dig, j, a, start, count, at, None))
            rows += [(None, None, None, *run, None, None) for run in _touching(settled)]
            yield record_batch(rows, PLACES)

    return docs.select("id", "a", "text", "live").mapInArrow(found, PLACES)


OPEN = (
    "key long, a long, b long, id long, start int, grp long, lo int, hi int, "
    "left int, right int, payload binary"
)
"""Windows lo to hi of a segment (key, a, b), still to be settled within the group
``grp``, whose members have the tokens from left to right in common."""
LOST = "key long, a long, b long, lost_at array<long>, lost_n array<long>"


def _matched(opened: DataFrame, kind: Passages) -> DataFrame:
    """Runs of windows that occur earlier, by the operator's method."""

    def segment(row: tuple) -> Segment:
        _, _, _, i, start, grp, lo, hi, left, right, payload = row
        own = kind.tokens(payload)
        if lo or hi + kind.window - 1 < len(own):
            payload = kind.payload(own, lo, hi - lo)
        return Segment(grp, i, start + lo, hi - lo, payload, left - lo, right - left)

    def found(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def lost(rows: list[tuple]) -> pa.RecordBatch:
            sizes = Counter(r[5] for r in rows)
            rows, out = [r for r in rows if sizes[r[5]] > 1], []
            if not rows:
                return record_batch(out, LOST)
            for r, offsets in zip(rows, kind.match([segment(r) for r in rows])):
                if len(offsets):
                    marked = np.zeros(r[7] - r[6], bool)
                    marked[offsets] = True
                    starts, ends = runs(marked)
                    out.append((*r[:3], starts + r[6], ends - starts))
            return record_batch(out, LOST)

        for table in tables:
            for row in zip(*(c.to_pylist() for c in table.columns)):
                if size > CHUNK_BYTES and row[5] != held[-1][5]:
                    yield lost(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[10])
        if held:
            yield lost(held)

    rows = opened.repartition("grp").sortWithinPartitions("grp", "id", "start", "a", "b")
    return rows.mapInArrow(found, LOST)


def _agree(one, other) -> int:
    """How many tokens both begin with."""
    least = min(len(one), len(other))
    return next((k for k in range(least) if one[k] != other[k]), least)


def _group_name(side: str, grp: int, anchor: bytes) -> int:
    return xxhash.xxh3_64_intdigest(f"{side} {grp} ".encode() + anchor) - (1 << 63)


def _against_first(opened: DataFrame, kind: Passages) -> DataFrame:
    """One round: every segment against the earliest holder of its group. Written.

    Rows of OPEN are still open, under the name of their new group; rows without
    a group are lost from lo to hi.
    """

    def found(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in tables:
            out = []
            for row in zip(*(c.to_pylist() for c in table.columns)):
                name, (i, start, grp, lo, hi, left, right, payload), first = row[:3], row[3:11], row[11]
                own, other = kind.tokens(payload), kind.tokens(first["payload"])
                anchor, at = own[left:right], first["left"]
                if anchor != other[at : first["right"]]:  # two anchors of one name
                    rest = _group_name("own", grp, kind.joined(anchor))
                    out.append((*name, i, start, rest, lo, hi, left, right, payload))
                    continue
                if (i, start, *name[1:]) == (first["id"], first["start"], first["a"], first["b"]):
                    continue
                low = left - _agree(own[:left][::-1], other[:at][::-1])
                high = right + _agree(own[right:], other[first["right"] :])
                some, past = max(lo, low), min(hi, high - kind.window + 1)
                later = i > first["id"] or (
                    kind.within and i == first["id"] and start + left > first["place"]
                )
                if some < past and later:
                    out.append((*name, i, start, None, some, past, None, None, None))
                if lo < min(hi, low):
                    rest = _group_name("left", grp, kind.joined(own[low - 1 : right]))
                    out.append((*name, i, start, rest, lo, min(hi, low), low - 1, right, payload))
                if max(some, past) < hi:
                    rest = _group_name("right", grp, kind.joined(own[left : high + 1]))
                    out.append((*name, i, start, rest, max(some, past), hi, left, high + 1, payload))
            yield record_batch(out, OPEN)

    place = (F.col("start") + F.col("left")).alias("place")
    names = ["id", place, "start", "a", "b", "left", "right", "payload"]
    first = opened.groupBy("grp").agg(F.min(F.struct(*names)).alias("first"))
    parts = F.explode(F.array(*[F.lit(k).cast("long") for k in range(SALTS)]))
    first = first.select("grp", "first", parts.alias("part"))
    own = opened.withColumn("part", F.pmod(F.xxhash64("a", "b"), F.lit(SALTS)))
    columns = [c.split()[0] for c in OPEN.split(", ")]
    met = own.join(first, ["grp", "part"]).select(*columns, "first")
    return materialize(met.mapInArrow(found, OPEN), "against-first")


def _by_size(opened: DataFrame, limit: int) -> tuple[DataFrame, DataFrame]:
    """The rows of groups of at most ``limit`` members, and those of larger groups
    (written). Sizes are counted without the segments' text."""
    sizes = opened.groupBy("grp").agg(F.count("*").alias("n"))
    names = materialize(sizes.filter(F.col("n") > limit).select("grp"), "large-names")
    large = materialize(opened.join(names, "grp", "left_semi").select(opened.columns), "large-groups")
    return opened.join(names, "grp", "left_anti").select(opened.columns), large


def _settled(opened: DataFrame, kind: Passages) -> DataFrame:
    """Runs of windows of the segments that occur earlier. Written."""
    small, large = _by_size(opened, kind.limit)
    lost = [_matched(small, kind)]
    while not large.isEmpty():
        done = _against_first(large, kind)
        one = done.filter("grp IS NULL").select(
            "key", "a", "b",
            F.array(F.col("lo").cast("long")).alias("lost_at"),
            F.array((F.col("hi") - F.col("lo")).cast("long")).alias("lost_n"),
        )
        small, large = _by_size(done.filter("grp IS NOT NULL"), kind.limit)
        lost += [one, _matched(small, kind)]
    return materialize(reduce(DataFrame.union, lost), "lost-windows")


def _lost_windows(places: DataFrame, kind: Passages) -> DataFrame:
    """(id, text_a, start, count): runs of windows that occur at an earlier place."""
    kept = places.filter("key IS NOT NULL")
    name = ["key", "a", "b"]
    distinct = materialize(
        kept.groupBy(*name).agg(
            F.min(F.struct("id", "start")).alias("first"),
            F.max("count").alias("count"),
            F.max("at").alias("at"),
            F.max("payload").alias("payload"),
        ),
        "segments",
        "zstd",
    )
    opened = distinct.select(
        *name, "first.id", "first.start", F.col("key").alias("grp"), F.lit(0).alias("lo"),
        F.col("count").alias("hi"), F.col("at").alias("left"),
        (F.col("at") + kind.gram).alias("right"), "payload",
    )
    lost = _settled(opened, kind)
    first = distinct.select(*name, F.col("first.id").alias("f_id"), F.col("first.start").alias("f_at"))
    later = F.col("id") > F.col("f_id")
    if kind.within:
        later = later | (F.col("start") > F.col("f_at"))
    at = kept.select(*name, "id", "text_a", "start", "count").join(first, name).withColumn("later", later)
    whole = at.filter("later").select("id", "text_a", "start", "count")
    some = at.filter("NOT later").join(lost, name)
    some = some.select("id", "text_a", "start", F.explode(F.arrays_zip("lost_at", "lost_n")).alias("run"))
    some = some.select(
        "id", "text_a", (F.col("start") + F.col("run.lost_at")).cast("int").alias("start"),
        F.col("run.lost_n").cast("int").alias("count"),
    )
    settled = places.filter("key IS NULL").select("id", "text_a", "start", "count")
    return settled.unionByName(whole).unionByName(some)


def _copies(keyed: DataFrame) -> DataFrame:
    """(id, a): rows whose whole text a document with a smaller id has."""
    own = keyed.select("id", "a", "b").filter("id IS NOT NULL")
    several = own.groupBy("a", "b").agg(F.min("id").alias("first"), F.max("id").alias("last"))
    several = several.filter("first < last").select("a", "b", "first")
    return own.join(several, ["a", "b"]).filter("id > first").select("id", "a").distinct()


RESULT = "doc_id long, n_tokens long, n_removed long, n_spans long, kept binary"


def without_repeats(docs: DataFrame, kind: Passages) -> DataFrame:
    """(doc_id, n_tokens, n_removed, n_spans, kept) for every row of ``docs``.

    A token goes if it lies in a window that also starts at an earlier place: in
    a document with a smaller id or, with ``within``, earlier in the same
    document. Windows are judged on the input; which copy of a passage is first
    depends on ids and places only. ``kept`` holds the bytes of what stays
    (words joined by one blank). Null and empty texts have no token; rows
    without an id keep everything and take nothing from others; repeated rows
    have equal results, and rows under one id with different texts are one
    document of several texts, none of them earlier. An empty table gives an
    empty result.
    """
    keyed = _keyed(docs)
    copies = materialize(_copies(keyed), "copies")
    anchors = materialize(_anchors(keyed, kind), "anchors")
    places = anchors.select("id", "a", F.explode("picks").alias("pick"))
    live = places.groupBy("pick").count().filter("count > 1").select("pick")
    shared = places.join(live, "pick").groupBy("id", "a").agg(F.collect_set("pick").alias("live"))
    if kind.within:
        alone = anchors.filter("own").select("id", "a", F.array().cast("array<long>").alias("live"))
        shared = shared.unionByName(alone).groupBy("id", "a")
        shared = shared.agg(F.flatten(F.collect_list("live")).alias("live"))
    shared = materialize(shared.join(copies, ["id", "a"], "left_anti"), "shared-picks")
    texts = marked(keyed, bitmap(shared.select("id"))).filter("listed").select("id", "a", "text")
    texts = texts.join(shared, ["id", "a"])
    found = materialize(_segments(texts, kind), "places", "zstd")
    lost = _lost_windows(found, kind).groupBy("id", "text_a")
    lost = lost.agg(F.collect_list(F.struct("start", "count")).alias("lost"))
    whole = copies.select(
        "id", F.col("a").alias("text_a"), F.lit(None).cast(lost.schema["lost"].dataType).alias("lost"), F.lit(True).alias("copy")
    )
    lost = lost.select("id", "text_a", "lost", F.lit(False).alias("copy")).unionByName(whole)
    lost = materialize(lost, "lost")

    def kept(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in tables:
            rows = []
            for i, text, lost, copy in zip(*(c.to_pylist() for c in table.columns)):
                tokens = text.split() if kind.by_word else np.frombuffer(text, np.uint8)
                removed = np.zeros(len(tokens), bool)
                if copy and len(tokens) >= kind.window:
                    removed[:] = True
                elif lost:
                    depth = np.zeros(len(tokens) + 1, np.int64)
                    starts = np.array([x["start"] for x in lost])
                    counts = np.array([x["count"] for x in lost])
                    np.add.at(depth, starts, 1)
                    np.add.at(depth, starts + counts + kind.window - 1, -1)
                    removed = np.cumsum(depth[:-1]) > 0
                if kind.by_word:
                    out = b" ".join(w for w, r in zip(tokens, removed.tolist()) if not r)
                else:
                    out = tokens[~removed].tobytes()
                spans = len(runs(removed)[0])
                rows.append((i, len(tokens), int(removed.sum()), spans, out))
            yield record_batch(rows, RESULT)

    every = marked(keyed.select("id", "a", "text"), bitmap(lost.select("id")))
    touched = every.filter("listed").join(
        lost.withColumnRenamed("text_a", "a"), ["id", "a"], "left"
    )
    touched = touched.select("id", "text", "lost", F.coalesce("copy", F.lit(False)).alias("copy"))
    rest = every.filter("NOT listed").select(
        "id", "text", F.lit(None).cast(lost.schema["lost"].dataType).alias("lost"), F.lit(False).alias("copy")
    )
    return touched.mapInArrow(kept, RESULT).unionByName(rest.mapInArrow(kept, RESULT))
