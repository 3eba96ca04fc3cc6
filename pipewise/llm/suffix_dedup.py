"""Suffix-array dedup on bytes: what a string of ``window`` bytes repeats goes.

The segments that share a pick (see ``passages``) and, with it, nearly a window's
bytes with some other segment are put one after the other, all their suffixes are sorted by external induced sorting with common-prefix
values, and neighbours in that order with a common prefix of ``window`` bytes
or more are equal windows; all but the earliest of them are lost.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import DataFrame

from pipewise.llm.induced_sort import InducedSorter
from pipewise.llm.passages import Passages, Segment, without_repeats

WINDOW = 100
GRAM = 32
LIMIT = 16384
"""Distinct segments of a pick that are sorted together in one task."""


STEPS = 4
"""Reaches from the pick by which windows are told to be without an equal."""
DEPTH = 250
"""Longest window: common prefixes are counted up to here."""


def _with_equals(segments: list[Segment], window: int) -> np.ndarray:
    """Which segments may have a window that another has.

    A window holds the group's common bytes and so many to their left that it
    falls in one of STEPS classes; all of a class hold one block around the common
    bytes. Windows of a segment whose blocks occur nowhere else have no equal.
    """
    seen: dict[tuple, int] = {}
    keep = np.zeros(len(segments), bool)
    for own, s in enumerate(segments):
        free = window - s.size
        step = free // STEPS + 1
        for left in range(0, free + 1, step):
            low, high = s.at - left, s.at + s.size + max(0, free - left - step + 1)
            if low < 0 or high > len(s.payload):
                continue
            name = (s.key, left, xxhash.xxh3_64_intdigest(s.payload[low:high]))
            other = seen.setdefault(name, own)
            if other != own:
                keep[own] = keep[other] = True
    return keep


def match_suffixes(segments: list[Segment], window: int = WINDOW) -> list[np.ndarray]:
    kept = _with_equals(segments, window)
    lost = [np.empty(0, np.int64)] * len(segments)
    if kept.any():
        own = np.flatnonzero(kept).tolist()
        for k, offsets in zip(own, _sorted_suffixes([segments[k] for k in own], window)):
            lost[k] = offsets
    return lost


def _sorted_suffixes(segments: list[Segment], window: int) -> list[np.ndarray]:
    sizes = np.array([len(s.payload) for s in segments])
    bounds = np.r_[0, np.cumsum(sizes + 1)]
    text = np.zeros(bounds[-1], np.uint16)
    for at, s in zip(bounds.tolist(), segments):
        text[at : at + len(s.payload)] = np.frombuffer(s.payload, np.uint8)
        text[at : at + len(s.payload)] += 1
    order, common = InducedSorter(text, window).sort()

    equal = common >= window  # with the suffix before
    group = np.cumsum(~equal)
    inside = equal.copy()
    inside[:-1] |= equal[1:]
    order, group = order[inside], group[inside]
    own = np.searchsorted(bounds, order, "right") - 1
    # what runs past the end of its segment is no window
    whole = order - bounds[own] + window <= sizes[own]
    order, group, own = order[whole], group[whole], own[whole]
    if not len(order):
        return [order] * len(segments)
    docs = np.array([s.doc for s in segments], np.int64)[own]
    places = np.array([s.start for s in segments], np.int64)[own] + order - bounds[own]
    by_place = np.lexsort((places, docs, group))
    first = np.r_[True, np.diff(group[by_place]) != 0]
    lost = np.zeros(len(text), bool)
    lost[order[by_place[~first]]] = True
    return [np.flatnonzero(lost[a:b]) for a, b in zip(bounds, bounds[1:])]


def scheme(window: int = WINDOW, gram: int = GRAM, limit: int = LIMIT) -> Passages:
    if window > DEPTH:
        raise ValueError(f"a window has at most {DEPTH} bytes")

    def match(segments: list[Segment]) -> list[np.ndarray]:
        return match_suffixes(segments, window)

    return Passages(window, gram, by_word=False, within=True, limit=limit, match=match)


def remove_repeated_bytes(docs: DataFrame, kind: Passages | None = None) -> DataFrame:
    """(doc_id, n_tokens, n_removed, n_spans, kept): see ``passages.without_repeats``.

    Tokens are the bytes of a text in UTF-8. A byte goes if it lies in a string
    of ``window`` bytes that also starts earlier: in a document with a smaller
    id, or earlier in the same one. Matches never cross documents.
    """
    return without_repeats(docs, kind or scheme())
