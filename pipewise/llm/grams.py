"""Rolling hashes over bytes and words, and the choice of anchors among them."""

from __future__ import annotations

import numpy as np

BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
"""Odd factors of the two polynomial hashes, modulo 2^64."""
_WORD_BASES = (0x100000001B3, 0xD6E8FEB86659FD93)
_LOWER = np.uint64(0xFFFFFFFF)
_WHITE = np.zeros(256, bool)
_WHITE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def word_bounds(buffer: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of every word in the bytes of a text."""
    inside = np.zeros(len(buffer) + 2, np.int8)
    inside[1:-1] = ~_WHITE[buffer]
    edges = np.diff(inside)
    return np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)


def word_codes(buffer: np.ndarray, starts: np.ndarray, ends: np.ndarray, k: int = 0) -> np.ndarray:
    """A 64-bit code per word: a polynomial of its bytes, mixed."""
    if not len(starts):
        return np.empty(0, np.uint64)
    lengths = ends - starts
    powers = np.full(int(lengths.max()) + 1, _WORD_BASES[k], np.uint64)
    powers[0] = 1
    powers = np.multiply.accumulate(powers)
    of_word = np.repeat(starts, lengths)
    within = np.arange(len(of_word)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    values = (buffer[of_word + within].astype(np.uint64) + np.uint64(1)) * powers[within]
    sums = np.add.reduceat(values, np.cumsum(lengths) - lengths)
    return mixed(sums + lengths.astype(np.uint64) * np.uint64(BASES[1]))


def mixed(values: np.ndarray) -> np.ndarray:
    out = (values ^ (values >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return out ^ (out >> np.uint64(29))


def rolling(codes: np.ndarray, size: int, k: int = 0) -> np.ndarray:
    """The hash of every run of ``size`` codes (none if there are fewer).

    Runs of 1, 2, 4, ... codes are put together as the bits of ``size`` say.
    """
    count = len(codes) - size + 1
    if count <= 0:
        return np.empty(0, np.uint64)
    base = BASES[k]
    out, done, run, length = None, 0, codes, 1
    while True:
        factor = np.uint64(pow(base, length, 1 << 64))
        if size & length:
            part = run[done : done + count]
            out = part if out is None else out * factor + part
            done += length
        if 2 * length > size:
            return mixed(out)
        run = run[: len(run) - length] * factor + run[length:]
        length *= 2


def picked(hashes: np.ndarray, width: int) -> np.ndarray:
    """For every ``width`` hashes in a row, the place of the first smallest.

    Hashes are compared by their upper 32 bits, the lower ones hold the place. What
    is picked depends on these hashes only, so equal runs of text pick the same
    gram at the same place within them.
    """
    count = len(hashes) - width + 1
    if count <= 0:
        return np.empty(0, np.int64)
    least = (hashes & ~_LOWER) | np.arange(len(hashes), dtype=np.uint64)
    length = 1
    while 2 * length <= width:
        least = np.minimum(least[:-length], least[length:])
        length *= 2
    if length < width:
        least = np.minimum(least[:count], least[width - length :])
    return (least & _LOWER).astype(np.int64)


def runs(marked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of every run of true values."""
    edges = np.diff(np.r_[0, marked.astype(np.int8), 0])
    return np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)


def covered(starts: np.ndarray, size: int, total: int) -> np.ndarray:
    """Which of ``total`` places lie in a window of ``size`` that starts at one of ``starts``."""
    depth = np.zeros(total + 1, np.int64)
    np.add.at(depth, starts, 1)
    np.add.at(depth, np.minimum(starts + size, total), -1)
    return np.cumsum(depth[:-1]) > 0
