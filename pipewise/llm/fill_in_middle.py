"""Fill-in-the-middle examples, put together by secondary sorts.

A text is cut into units: a word with the white space before it, or the white
space that ends the text. Its prefix, middle and suffix are runs of units. Each
document leaves its task as pieces of whole units (``PIECE`` bytes; only a
longer unit is cut itself), keyed by the document and the place of the piece in
the output. ``repartitionAndSortWithinPartitions`` brings the pieces of a
document together in the order of the output, where they stream into a digest,
one piece in memory at a time. What streams out is read again by its form and
its sentinels alone, keyed by the place in the original, and sorted once more:
the second stream is the restored text.

Documents are told apart by id, digest of the text, number of the repeat within
their input partition and that partition, so repeated ids and rows never mix.
Pieces are dealt by a hash of all but the partition: a task that runs again
after a lost executor deals alike in whatever order its rows come, and equal
rows do not gather in one task.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import xxhash
import zstandard
from pyspark import RDD
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pipewise.llm.shared import WHITE

SEED = 42
PLAIN_PERCENT = 50
SPM_PERCENT = 80
PIECE = 1 << 16
"""Bytes of a piece."""
PART_BYTES = 32 << 20
"""Bytes of text that a task sorts, about; the sort itself spills."""
PREFIX, MIDDLE, SUFFIX = 0, 1, 2
SENTINELS = {b"<P>": PREFIX, b"<M>": MIDDLE, b"<S>": SUFFIX}
ORDERS = {"plain": (PREFIX,), "psm": (PREFIX, SUFFIX, MIDDLE), "spm": (SUFFIX, PREFIX, MIDDLE)}
"""The parts of a text in the order of each form; a plain text is one part."""
_MARK = {part: mark for mark, part in SENTINELS.items()}
_IS_WHITE = np.isin(np.arange(256), np.frombuffer(WHITE.encode(), np.uint8))
EXAMPLE = "doc_id long, n long, form string, prefix_chars long, middle_chars long"


def unit_ends(text: bytes) -> np.ndarray:
    """Where each unit ends, in bytes of UTF-8."""
    if not text:
        return np.empty(0, np.int64)
    white = _IS_WHITE[np.frombuffer(text, np.uint8)]
    return np.append(np.flatnonzero(~white[:-1] & white[1:]) + 1, len(text))


def _chars(text: bytes) -> int:
    return int(np.count_nonzero(np.frombuffer(text, np.uint8) & 0xC0 != 0x80))


def choices(doc_id: int | None, seed: int) -> list[int]:
    """The four numbers that decide a document; without an id those of the seed."""
    name = f"{seed}:{'' if doc_id is None else doc_id}"
    digits = hashlib.sha256(name.encode()).hexdigest()
    return [int(digits[at : at + 8], 16) for at in (0, 8, 16, 24)]


def _parts(doc_id: int | None, text: bytes, seed: int) -> tuple[tuple, np.ndarray, dict]:
    """((n, form, prefix_chars, middle_chars), unit ends, (start, end) of each part)."""
    ends = unit_ends(text)
    n = len(ends)
    h1, h2, h3, h4 = choices(doc_id, seed)
    if not text or any(mark in text for mark in SENTINELS) or h3 % 100 >= PLAIN_PERCENT:
        return (n, "plain", None, None), ends, {PREFIX: (0, len(text))}
    starts = np.append(0, ends)
    a, b = sorted(int(starts[h % (n + 1)]) for h in (h1, h2))
    form = "spm" if h4 % 100 < SPM_PERCENT else "psm"
    parts = {PREFIX: (0, a), MIDDLE: (a, b), SUFFIX: (b, len(text))}
    return (n, form, _chars(text[:a]), _chars(text[a:b])), ends, parts


def _chunks(text: bytes, ends: np.ndarray, start: int, end: int, size: int) -> Iterator[bytes]:
    """``text[start:end]`` in pieces of whole units; a unit over ``size`` is cut."""
    while start < end:
        until = min(start + size, end)
        if until < end:
            whole = np.searchsorted(ends, until, "right") - 1
            until = int(ends[whole]) if whole >= 0 and ends[whole] > start else until
        yield text[start:until]
        start = until


def _output(text: bytes, head: tuple, ends: np.ndarray, parts: dict, size: int) -> Iterator[bytes]:
    """The pieces of the output, the sentinel of a part at the head of its first."""
    form = head[1]
    for part in ORDERS[form]:
        mark = b"" if form == "plain" else _MARK[part]
        pieces = _chunks(text, ends, *parts[part], size)
        yield mark + next(pieces, b"")
        yield from pieces


def _read_back(form: str, output: Iterator[bytes]) -> Iterator[tuple[int, int, bytes]]:
    """(part, number, piece) of an output that comes in pieces cut anywhere.

    The parts follow from the form; each ends where the sentinel of the next
    one begins, which no text of such a form contains.
    """
    marks = [] if form == "plain" else [_MARK[part] for part in ORDERS[form]]
    order = [None, *ORDERS[form]] if marks else list(ORDERS[form])
    held, at, number = b"", 0, 0
    for piece in output:
        held += piece
        while at < len(marks) and (found := held.find(marks[at])) >= 0:
            if found:
                yield order[at], number, held[:found]
            held, at, number = held[found + 3 :], at + 1, 0
        safe = len(held) - 2 if at < len(marks) else len(held)
        if safe > 0:
            yield order[at], number, held[:safe]
            held, number = held[safe:], number + 1
    if held:
        yield order[at], number, held


def _dealt(key: tuple) -> int:
    (has_id, number, digest, repeat, _), *_ = key
    return xxhash.xxh3_64_intdigest(b"%d:%d:%d:" % (has_id, number, repeat) + digest)


def _tasks(rows: DataFrame, column: str) -> int:
    """How many tasks the sorts take: the bytes of the texts, counted by a scan, by
    ``PART_BYTES``. No later step can change that number."""
    total = rows.agg(F.sum(F.octet_length(F.col(column)).cast("long"))).first()[0] or 0
    return 1 + total // PART_BYTES


def _sorted(pieces: RDD, tasks: int) -> RDD:
    """Each document's pieces together and in order."""
    return pieces.repartitionAndSortWithinPartitions(numPartitions=tasks, partitionFunc=_dealt)


def _named(rows: Iterator[tuple], part: int) -> Iterator[tuple[tuple, int | None, bytes, tuple]]:
    """(key, id, text, row) of rows that begin with an id and a text."""
    seen: Counter[tuple] = Counter()
    for row in rows:
        doc_id, text = row[0], bytes(row[1] or b"")
        named = (doc_id is not None, doc_id or 0, xxhash.xxh3_128_digest(text))
        key = (*named, seen[named], part)
        seen[named] += 1
        yield key, doc_id, text, row


def _pieces(docs: DataFrame, seed: int, size: int) -> RDD:
    """((document, place in the output), (head or None, packed piece))."""

    def cut(part: int, rows: Iterator[tuple]) -> Iterator[tuple]:
        pack = zstandard.ZstdCompressor(level=6).compress
        for key, doc_id, text, _ in _named(rows, part):
            head, ends, parts = _parts(doc_id, text, seed)
            for place, piece in enumerate(_output(text, head, ends, parts, size)):
                yield (key, place), (None if place else (doc_id, *head), pack(piece))

    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary"))
    return texts.rdd.mapPartitionsWithIndex(cut)


def _documents(pieces: Iterator[tuple]) -> Iterator[tuple[tuple, tuple, Iterator[bytes]]]:
    """(document, head, its pieces unpacked) of a sorted partition; a document is
    read to its end before the next."""
    unpack = zstandard.ZstdDecompressor().decompress
    for key, own in groupby(pieces, key=lambda p: p[0][0]):
        first = next(own)
        head, packed = first[1]

        def stream(packed=packed, own=own):
            if packed is not None:
                yield unpack(packed)
            for _, (_, more) in own:
                yield unpack(more)

        yield key, head, stream()


def examples(docs: DataFrame, seed: int = SEED, size: int = PIECE) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output): the training texts.

    ``docs`` has doc_id and text; other columns play no part, whatever their
    names. One row per row of ``docs``: repeated ids and rows stay apart, a null
    text is empty. An empty text, and one that contains a sentinel, is plain, in
    any seed. A row without an id is decided by the seed alone. An empty table
    gives an empty one. Lengths are code points, null if plain.
    """

    def joined(pieces: Iterator[tuple]) -> Iterator[tuple]:
        for _, head, stream in _documents(pieces):
            yield (*head, b"".join(stream).decode("utf-8", "replace"))

    pieces = _pieces(docs, seed, size)
    rows = _sorted(pieces, _tasks(docs, "text")).mapPartitions(joined)
    return docs.sparkSession.createDataFrame(rows, f"{EXAMPLE}, output string", verifySchema=False)


def restore(outputs: DataFrame, size: int = PIECE) -> DataFrame:
    """(doc_id, text): the original texts from doc_id, output and form alone.

    Takes ``examples`` or any table with these columns; a null output is an
    empty text, a null form is plain.
    """

    def cut(part: int, rows: Iterator[tuple]) -> Iterator[tuple]:
        pack = zstandard.ZstdCompressor(level=6).compress
        for key, doc_id, text, row in _named(rows, part):
            yield (key, -1, 0), ((doc_id,), None)
            chunks = (text[at : at + size] for at in range(0, len(text), size))
            for place, number, piece in _read_back(row[2] or "plain", chunks):
                yield (key, place, number), (None, pack(piece))

    def joined(pieces: Iterator[tuple]) -> Iterator[tuple]:
        for _, (doc_id,), stream in _documents(pieces):
            yield doc_id, b"".join(stream).decode("utf-8", "replace")

    texts = outputs.select(F.col("doc_id").cast("long"), F.col("output").cast("binary"), "form")
    tasks = _tasks(outputs, "output")
    rows = _sorted(texts.rdd.mapPartitionsWithIndex(cut), tasks).mapPartitions(joined)
    return outputs.sparkSession.createDataFrame(
        rows, "doc_id long, text string", verifySchema=False
    )


def round_trip(docs: DataFrame, seed: int = SEED, size: int = PIECE) -> DataFrame:
    """As ``examples``, with digests of the output and of the text restored from
    it in place of the text: (..., output_sha256, restored_sha256).

    No task holds a whole output. A plain output is the text itself, so its
    restored text is the same stream; the parts of the others are sorted back.
    """

    def written(pieces: Iterator[tuple]) -> Iterator[tuple]:
        pack = zstandard.ZstdCompressor(level=6).compress
        for key, head, stream in _documents(pieces):
            digest, form = hashlib.sha256(), head[2]

            def digested(stream=stream, digest=digest):
                for piece in stream:
                    digest.update(piece)
                    yield piece

            for part, number, piece in _read_back(form, digested()):
                if form != "plain":
                    yield (key, part, number), (None, pack(piece))
            yield (key, -1, 0), ((*head, digest.hexdigest()), None)

    def restored(pieces: Iterator[tuple]) -> Iterator[tuple]:
        for _, head, stream in _documents(pieces):
            digest = hashlib.sha256()
            for piece in stream:
                digest.update(piece)
            yield (*head, head[-1] if head[2] == "plain" else digest.hexdigest())

    tasks = _tasks(docs, "text")
    outputs = _sorted(_pieces(docs, seed, size), tasks).mapPartitions(written)
    rows = _sorted(outputs, tasks).mapPartitions(restored)
    schema = f"{EXAMPLE}, output_sha256 string, restored_sha256 string"
    return docs.sparkSession.createDataFrame(rows, schema, verifySchema=False)
