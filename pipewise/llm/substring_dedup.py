"""Substring dedup by fixed-block anchors, on words.

Among the texts that share a pick (see ``passages``), every document's
non-overlapping blocks of ``block`` words, counted from its first word, are
indexed by hash; every rolling window of ``block`` words probes the index; and
each hit in a document with a smaller id is extended word by word in both
directions to a maximal exact repeat. A window of 2 ``block`` - 1 words or more
always holds a whole block, so no repeat of that length is missed.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from pipewise.llm.grams import mixed, rolling, word_bounds, word_codes
from pipewise.llm.passages import Passages, Segment, without_repeats

WINDOW = 50
GRAM = 12
LIMIT = 64
"""Distinct segments of a pick that are compared with each other in one task."""


def block_size(window: int) -> int:
    return (window + 1) // 2


def _grams(codes: np.ndarray, bounds: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of all windows of ``size`` words within one segment."""
    hashes = rolling(codes, size)
    ends = np.repeat(bounds[1:], np.diff(bounds))
    places = np.flatnonzero(np.arange(len(hashes)) + size <= ends[: len(hashes)])
    return places, hashes[places]


def _extended(codes, own, left, right, limits, step):
    """How many words further left and right agree, up to the bounds of both segments."""
    length, active = np.zeros(len(left), np.int64), np.arange(len(left))
    while len(active):
        q, r = left[active] + step * length[active], right[active] + step * length[active]
        inside = (q >= 0) & (r >= 0) & (q < len(codes)) & (r < len(codes))
        active, q, r = active[inside], q[inside], r[inside]
        same = (own[q] == limits[0][active]) & (own[r] == limits[1][active])
        same &= codes[q] == codes[r]
        active = active[same]
        length[active] += 1
    return length


def match_blocks(segments: list[Segment], window: int = WINDOW) -> list[np.ndarray]:
    block = block_size(window)
    codes, bounds = [], [0]
    for s in segments:
        buffer = np.frombuffer(s.payload, np.uint8)
        codes.append(word_codes(buffer, *word_bounds(buffer)))
        bounds.append(bounds[-1] + len(codes[-1]))
    codes, bounds = np.concatenate(codes), np.array(bounds)
    own = np.repeat(np.arange(len(segments)), np.diff(bounds))
    keys = np.array([s.key for s in segments], np.int64).view(np.uint64)
    docs = np.array([s.doc for s in segments], np.int64)
    starts = np.array([s.start for s in segments], np.int64)

    probes, hashes = _grams(codes, bounds, block)
    names = mixed(hashes + keys[own[probes]] * np.uint64(0x9E3779B97F4A7C15))
    place_in_doc = starts[own[probes]] + probes - bounds[own[probes]]
    blocks = np.flatnonzero(place_in_doc % block == 0)
    blocks = blocks[np.argsort(names[blocks], kind="stable")]
    indexed = names[blocks]
    low = np.searchsorted(indexed, names, "left")
    hits = np.searchsorted(indexed, names, "right") - low
    q = np.repeat(np.arange(len(probes)), hits)
    r = blocks[np.repeat(low, hits) + np.arange(len(q)) - np.repeat(np.cumsum(hits) - hits, hits)]
    q, r = probes[q], probes[r]
    earlier = (docs[own[r]] < docs[own[q]]) & (keys[own[r]] == keys[own[q]])
    q, r = q[earlier], r[earlier]

    limits = (own[q], own[r])
    back = _extended(codes, own, q - 1, r - 1, limits, -1)
    ahead = _extended(codes, own, q, r, limits, 1)
    long = back + ahead >= window
    depth = np.zeros(len(codes) + 1, np.int64)
    np.add.at(depth, (q - back)[long], 1)
    np.add.at(depth, (q + ahead - window + 1)[long], -1)
    lost = np.cumsum(depth[:-1]) > 0
    return [np.flatnonzero(lost[bounds[k] : bounds[k + 1]]) for k in range(len(segments))]


def scheme(window: int = WINDOW, gram: int = GRAM, limit: int = LIMIT) -> Passages:
    def match(segments: list[Segment]) -> list[np.ndarray]:
        return match_blocks(segments, window)

    return Passages(window, gram, by_word=True, within=False, limit=limit, match=match)


def remove_repeated_passages(docs: DataFrame, kind: Passages | None = None) -> DataFrame:
    """(doc_id, n_tokens, n_removed, n_spans, kept): see ``passages.without_repeats``.

    Words are runs of characters other than the six ASCII white spaces, as
    written; a word goes if it lies in a window of words that also starts in a
    document with a smaller id.
    """
    return without_repeats(docs, kind or scheme())
