"""Packing of tokenised documents into training windows by minimum bin slack.

A document is its token ids and an end mark. Pieces of a whole window are cut
off at once; what remains of a document (shorter than a window) goes to a pool.
For each window the longest piece of the pool is set, and a subset-sum dynamic
programme over a bitset (a Python integer, bit s: sum s can be reached) picks
the multiset of lengths that comes closest to the space left; counts per length
are found by going back through the programme. A window that could not be
filled is closed with a cut piece, and the very last tokens of a task are cut
into windows whose lengths are powers of two, which are not padded.

Each task packs the rows of its own input partition, whatever their number, in
memory bounded by the pool; nothing is shuffled, so no key can be hot. Token
ids come from a public tokenizer file whose path is a parameter.
"""

from __future__ import annotations

import re
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from pipewise.llm.shared import record_batch

WINDOW, END_ID = 2048, 1
POOL = 1024
"""Pieces a task keeps waiting; the longer the pool, the smaller the slack."""
CACHED_PIECES = 1_500_000
"""Pieces a Python worker remembers the ids of."""
BATCH_CHARS = 500_000
SCHEMA = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, "
    "sequence_id long, offset long"
)

_BREAK = "\x1f"
_ODD_SPACE = re.compile(r"\s\s|[^\S \n]|\s\Z")
_ODD_STOP = re.compile(r"[.,](?<=[\W_].)")


def pieces_of(text: str) -> list[str] | None:
    """The text cut where the pre-tokenizer always starts a token.

    That is before a blank or line end between two other characters, and before
    a stop or comma after a letter or digit. A text with stops after other
    signs is cut at fewer places, one with other white space not at all (None).
    """
    blank = text.replace("\n", " ")
    if "  " in blank or blank[-1:] == " " or not blank.isprintable():
        if _ODD_SPACE.search(text) or _BREAK in text:
            return None
    cut = text.replace(" ", _BREAK + " ").replace("\n", _BREAK + "\n")
    if not _ODD_STOP.search(text):
        cut = cut.replace(".", _BREAK + ".").replace(",", _BREAK + ",")
    return cut.split(_BREAK)


class PieceTokenizer:
    """Ids of whole texts from a byte-level BPE file of ``tokenizers``.

    The ids of a text are those of its pieces one after the other; pieces are
    encoded once and remembered, as most of them come again.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        if self.tokenizer.get_vocab_size() > 1 << 16:
            raise ValueError("ids must fit in 16 bits")
        self.known: dict[str, bytes] = {}
        # in the vocabulary of a byte-level file one character stands for one byte
        self.lengths = np.zeros(1 << 16, np.int64)
        for token, number in self.tokenizer.get_vocab().items():
            self.lengths[number] = len(token)

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(x.ids, np.uint16) for x in found]

    def _learn(self, pieces: list[str]) -> None:
        """Encodes pieces as lines of one text: a line end is a token of its own,
        and the tokens' lengths in bytes tell which one ends a piece."""
        for at in range(0, len(pieces), 20_000):
            part = pieces[at : at + 20_000]
            ids = self._ids(["\n".join([*part, ""])])[0]
            ends = np.cumsum([len(p.encode()) + 1 for p in part])
            place = np.cumsum(self.lengths[ids])
            line_end = np.searchsorted(place, ends)
            if not (place[line_end] == ends).all() or (self.lengths[ids[line_end]] != 1).any():
                self.known.update(zip(part, [x.tobytes() for x in self._ids(part)]))
                continue
            raw, start = ids.tobytes(), 0
            for piece, end in zip(part, (2 * line_end).tolist()):
                self.known[piece] = raw[start:end]
                start = end + 2

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        pieces = [pieces_of(t) for t in texts]
        if len(self.known) > CACHED_PIECES:
            self.known.clear()
        cut = [p for p in pieces if p is not None]
        self._learn(list(set().union(*cut).difference(self.known)))
        known = self.known.__getitem__
        return [
            self._ids([t])[0] if p is None else np.frombuffer(b"".join(map(known, p)), np.uint16)
            for t, p in zip(texts, pieces)
        ]


_tokenizers: dict[str, PieceTokenizer] = {}


def tokenizer_at(path: str) -> PieceTokenizer:
    """One per Python worker and file."""
    if path not in _tokenizers:
        _tokenizers[path] = PieceTokenizer(path)
    return _tokenizers[path]


def closest_counts(counts: dict[int, int], space: int) -> dict[int, int]:
    """How many pieces of each length sum closest to ``space`` without passing it.

    Lengths are taken in falling order, each in shares of 1, 2, 4, ... pieces; a
    sum, once reached, keeps the way it was reached first.
    """
    reach, goal, steps = 1, 1 << space, []
    mask = (goal << 1) - 1
    for length in sorted(counts, reverse=True):
        left, share = min(counts[length], space // length), 1
        while left > 0 and not reach & goal:
            take = min(share, left)
            steps.append((reach, length, take))
            reach |= (reach << (length * take)) & mask
            left, share = left - take, share * 2
        if reach & goal:
            break
    total, picked = reach.bit_length() - 1, defaultdict(int)
    for before, length, take in reversed(steps):
        if not before >> total & 1:
            picked[length] += take
            total -= length * take
    return picked


class Packer:
    """Pieces (doc, start, ids, doc_tokens) to rows of windows."""

    def __init__(self, window: int, first_sequence: int):
        self.window, self.sequence = window, first_sequence
        self.pool: dict[int, list] = defaultdict(list)
        self.waiting = 0
        self.rows: list[tuple] = []

    def add(self, doc, ids: np.ndarray) -> None:
        n, start = len(ids), 0
        while n - start >= self.window:
            self.close([(doc, start, ids[start : start + self.window], n)])
            start += self.window
        if start < n:
            self.put((doc, start, ids[start:], n))

    def put(self, piece) -> None:
        self.pool[len(piece[2])].append(piece)
        self.waiting += 1

    def take(self, length: int):
        pieces = self.pool[length]
        piece = pieces.pop()
        if not pieces:
            del self.pool[length]
        self.waiting -= 1
        return piece

    def close(self, pieces: list) -> None:
        offset = 0
        for doc, start, ids, n in pieces:
            crc = zlib.crc32(ids.astype("<u4").tobytes())
            self.rows.append((doc, start, len(ids), crc, n, self.sequence, offset))
            offset += len(ids)
        self.sequence += 1

    def fill(self) -> tuple[list, int]:
        """The longest piece, the multiset closest to the space it leaves, and the slack."""
        pieces = [self.take(max(self.pool))]
        space = self.window - len(pieces[0][2])
        counts = {length: len(x) for length, x in self.pool.items() if length <= space}
        for length, count in closest_counts(counts, space).items():
            pieces += [self.take(length) for _ in range(count)]
            space -= length * count
        return pieces, space

    def pack(self, keep: int) -> None:
        """Windows until at most ``keep`` pieces wait; slack is filled with a cut piece."""
        while self.waiting > keep:
            pieces, slack = self.fill()
            if slack and self.waiting:
                pieces.append(self.cut(self.take(max(self.pool)), slack))
                slack = 0
            if slack:
                self.close_short(pieces)
            else:
                self.close(pieces)

    def cut(self, piece, length: int):
        doc, start, ids, n = piece
        if length < len(ids):
            self.put((doc, start + length, ids[length:], n))
        return doc, start, ids[:length], n

    def close_short(self, pieces: list) -> None:
        """The last tokens as windows of powers of two, the longest first."""
        total = sum(len(p[2]) for p in pieces)
        queue = pieces[::-1]
        for power in reversed(range(total.bit_length())):
            space, own = (1 << power) if total >> power & 1 else 0, []
            while space:
                doc, start, ids, n = queue.pop()
                if len(ids) > space:
                    queue.append((doc, start + space, ids[space:], n))
                    ids = ids[:space]
                own.append((doc, start, ids, n))
                space -= len(ids)
            if own:
                self.close(own)

    def emit(self) -> pa.RecordBatch:
        rows, self.rows = self.rows, []
        return record_batch(rows, SCHEMA)


def pack_documents(
    docs: DataFrame,
    tokenizer_path: str,
    window: int = WINDOW,
    end_id: int = END_ID,
    pool: int = POOL,
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Every id of every document lies in exactly one piece; pieces of a sequence
    follow each other from offset 0. A null or empty text is the end mark alone.
    Rows are packed one by one, so repeated rows and rows without a ``doc_id``
    are packed like any other. An empty table gives no row. ``sequence_id``
    holds the number of the input partition in its upper bits.
    """

    def packed(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = tokenizer_at(tokenizer_path)
        packer = Packer(window, TaskContext.get().partitionId() << 36)
        end = np.array([end_id], np.uint16)

        def batches():
            ids, texts, size = [], [], 0
            for table in tables:
                for doc, text in zip(*[c.to_pylist() for c in table.columns]):
                    ids.append(doc)
                    texts.append(text or "")
                    size += len(texts[-1])
                    if size >= BATCH_CHARS:
                        yield ids, texts
                        ids, texts, size = [], [], 0
            yield ids, texts

        for ids, texts in batches():
            for doc, found in zip(ids, tokens.encode(texts)):
                packer.add(doc, np.concatenate([found, end]))
                if packer.waiting >= 2 * pool:
                    packer.pack(pool)
            if len(packer.rows) > 20_000:
                yield packer.emit()
        packer.pack(0)
        yield packer.emit()

    return docs.select("doc_id", "text").mapInArrow(packed, SCHEMA)
