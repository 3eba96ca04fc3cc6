"""External induced sorting of suffixes, with common-prefix values.

Suffixes are sorted as in external induced sorting: those that are smaller than
their successor after a larger letter (LMS) are sorted first, and every other
suffix gets its place when its successor is met in order. What waits for its
place are tuples (position, common prefix with the tuple before it) in a
priority queue: by first letter, and within a letter by arrival, which is the
order of the successors. The queue keeps a bounded part in memory and the rest
in a file. A letter's tuples are taken out together, so each step works on
arrays; suffixes that begin with a run of the letter come back once per letter
of the run.

LMS suffixes are sorted by inducing LMS substrings, naming them, and ranking
the string of names, each round by names of twice the length, until no name is
shared or names cover ``depth`` letters: order and common prefixes beyond that
depth are not needed. A common prefix of two induced suffixes is one more than
the smallest between their successors.
"""

from __future__ import annotations

import tempfile
from collections import defaultdict

import numpy as np

QUEUE_BYTES = 16 << 20


class TupleQueue:
    """Arrays of tuples by letter, first in, first out.

    Over ``memory`` bytes all that waits goes to a file that has no name and
    ends with the task, as a sort's own spill does; nothing else reads it.
    """

    def __init__(self, memory: int = QUEUE_BYTES):
        self.memory, self.used, self.file = memory, 0, None
        self.held: dict[int, list] = defaultdict(list)

    def put(self, letter: int, places: np.ndarray, common: np.ndarray) -> None:
        if len(places):
            self.held[letter].append((places, common))
            self.used += places.nbytes + common.nbytes
            if self.used > self.memory:
                self.spill()

    def spill(self) -> None:
        self.file = self.file or tempfile.TemporaryFile()
        self.file.seek(0, 2)
        for parts in self.held.values():
            for k, (places, common) in enumerate(parts):
                if isinstance(places, np.ndarray):
                    at = self.file.tell()
                    self.file.write(places.tobytes())
                    self.file.write(common.tobytes())
                    parts[k] = (at, len(places))
        self.used = 0

    def take(self, letter: int) -> tuple[np.ndarray, np.ndarray]:
        places, common = [np.empty(0, np.int32)], [np.empty(0, np.uint8)]
        for a, b in self.held.pop(letter, []):
            if isinstance(a, np.ndarray):
                self.used -= a.nbytes + b.nbytes
            else:
                self.file.seek(a)
                raw = self.file.read(5 * b)
                a, b = np.frombuffer(raw[: 4 * b], np.int32), np.frombuffer(raw[4 * b :], np.uint8)
            places.append(a)
            common.append(b)
        return np.concatenate(places), np.concatenate(common)

    def close(self) -> None:
        if self.file:
            self.file.close()


def smaller_than_next(text: np.ndarray) -> np.ndarray:
    """Per suffix: is it smaller than the one after it (the last one counts as such)."""
    step = np.sign(np.diff(text.astype(np.int16)))
    place = np.where(np.r_[step, 1] != 0, np.arange(len(text)), len(text))
    decided = np.minimum.accumulate(place[::-1])[::-1]
    return np.r_[step, 1][decided] > 0


def _least_between(common: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """min of common[low+1 .. high] for each pair, low < high, by doubling ranges."""
    if not len(low):
        return np.empty(0, np.uint8)
    level = np.floor(np.log2(high - low)).astype(np.int64)
    out = np.empty(len(low), np.uint8)
    table, width = common, 1
    for k in range(int(level.max()) + 1):
        own = level == k
        out[own] = np.minimum(table[low[own] + 1], table[high[own] - width + 1])
        table = np.minimum(table[:-width], table[width:]) if len(table) > width else table
        width *= 2
    return out


class InducedSorter:
    """Order and common prefixes (up to ``depth``) of all suffixes of a text.

    ``text`` holds letters 0..256 and ends with a 0; 0 ends every segment.
    """

    def __init__(self, text: np.ndarray, depth: int, memory: int = QUEUE_BYTES):
        self.text, self.depth, self.memory = text, min(depth, 250), memory
        self.rising = smaller_than_next(text)
        starts = self.rising.copy()
        starts[1:] &= ~self.rising[:-1]
        starts[0] = False
        self.lms = np.flatnonzero(starts).astype(np.int32)
        self.letters = np.unique(text)

    def _runs(self, places: np.ndarray) -> int:
        """Length of the run of its first letter that the one suffix starts with."""
        at, letter = int(places), self.text[places]
        end = at
        while end < len(self.text) and end - at < self.depth and self.text[end] == letter:
            end += 1
        return end - at

    def _send(self, queue: TupleQueue, places, common, wanted) -> None:
        """Puts the predecessors that ``wanted`` picks into the queue, by their letter."""
        index = np.flatnonzero(wanted)
        if not len(index):
            return
        before = places[index] - 1
        letters = self.text[before]
        order = np.argsort(letters, kind="stable")
        index, before, letters = index[order], before[order], letters[order]
        first = np.r_[True, letters[1:] != letters[:-1]]
        value = np.ones(len(index), np.uint8)
        later = np.flatnonzero(~first)
        least = _least_between(common, index[later - 1], index[later])
        value[later] = np.minimum(least.astype(np.int64) + 1, self.depth)
        cuts = np.flatnonzero(first).tolist() + [len(index)]
        for a, b in zip(cuts, cuts[1:]):
            queue.put(int(letters[a]), before[a:b], value[a:b])

    def _chain(self, places, common, letter: int, rising: bool) -> tuple[np.ndarray, np.ndarray]:
        """The tuples of a letter with those that its own runs bring back."""
        every, values, run = [], [], 1
        while len(places):
            if run > 1:
                common = common.copy()
                common[0] = min(run - 1, self.depth)
            every.append(places)
            values.append(common)
            own = places > 0
            own[own] = (self.text[places[own] - 1] == letter) & (
                self.rising[places[own] - 1] == rising
            )
            index = np.flatnonzero(own)
            value = np.ones(len(index), np.uint8)
            if len(index) > 1:
                least = _least_between(common, index[:-1], index[1:]).astype(np.int64)
                value[1:] = np.minimum(least + 1, self.depth)
            places, common, run = places[index] - 1, value, run + 1
        if not every:
            return np.empty(0, np.int32), np.empty(0, np.uint8)
        return np.concatenate(every), np.concatenate(values)

    def induce(self, seeds: np.ndarray, common: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All suffixes in order, from LMS suffixes in order; and the common prefix
        of each with the one before it."""
        first = np.searchsorted(self.text[seeds], np.arange(258))
        falling: dict[int, tuple] = {}
        queue = TupleQueue(self.memory)
        for c in self.letters.tolist():
            places, values = self._chain(*queue.take(c), c, False)
            falling[c] = (places, values)
            own, lcp = seeds[first[c] : first[c + 1]], common[first[c] : first[c + 1]].copy()
            if len(own):
                lcp[0] = min(self._runs(own[0]), self._runs(places[-1])) if len(places) else 0
            every, values = np.concatenate([places, own]), np.concatenate([values, lcp])
            wanted = every > 0
            before = every[wanted] - 1
            wanted[wanted] = ~self.rising[before] & (self.text[before] > c)
            self._send(queue, every, values, wanted)
        queue.close()
        # the same from the largest letter down; a common prefix stands with the later tuple
        order, prefix = [], []
        queue = TupleQueue(self.memory)
        for c in self.letters[::-1].tolist():
            arrived = queue.take(c)
            if c == 0:  # the very last letter has no successor and is the smallest
                arrived = (
                    np.r_[arrived[0], np.int32(len(self.text) - 1)].astype(np.int32),
                    np.r_[arrived[1], np.uint8(1)].astype(np.uint8),
                )
            places, values = self._chain(*arrived, c, True)
            down, lcp = falling[c]
            down, lcp = down[::-1], np.r_[lcp[:1], lcp[:0:-1]]
            if len(down) and len(places):
                lcp[0] = min(self._runs(places[-1]), self._runs(down[0]))
            every, values = np.concatenate([places, down]), np.concatenate([values, lcp])
            if len(values):
                values[0] = 0
            order.append(every)
            prefix.append(values)
            wanted = every > 0
            before = every[wanted] - 1
            wanted[wanted] = self.rising[before] & (self.text[before] < c)
            self._send(queue, every, values, wanted)
        queue.close()
        order, prefix = np.concatenate(order)[::-1], np.concatenate(prefix)
        return order, np.r_[np.uint8(0), prefix[:0:-1]].astype(np.uint8)

    def _names(self, order: np.ndarray) -> np.ndarray:
        """Names of the LMS substrings, in text order, equal for equal substrings;
        ``order`` holds LMS positions sorted by substring."""
        index = np.searchsorted(self.lms, order)
        length = np.diff(np.r_[self.lms, len(self.text) - 1])[index] + 1
        a, b = order[:-1].astype(np.int64), order[1:].astype(np.int64)
        same = length[:-1] == length[1:]
        active, k = np.flatnonzero(same), 0
        while len(active):
            active = active[k < length[active]]
            differ = self.text[a[active] + k] != self.text[b[active] + k]
            same[active[differ]] = False
            active, k = active[~differ], k + 1
        names = np.empty(len(order), np.int64)
        names[index] = np.cumsum(np.r_[0, ~same])
        return names

    def _common(self, order: np.ndarray) -> np.ndarray:
        """Common prefixes of neighbours in ``order``, compared four letters at once."""
        size = len(self.text)
        ended = np.r_[self.text, np.full(4, 0xFFFF, np.uint16)].astype(np.uint64)
        four = ended[: size + 1].copy()
        for k in (1, 2, 3):
            four |= ended[k : size + 1 + k] << np.uint64(16 * k)
        out = np.zeros(len(order), np.int64)
        a, b = order[:-1].astype(np.int64), order[1:].astype(np.int64)
        active, k = np.arange(len(a)), 0
        while k < self.depth and len(active):
            differ = four[a[active] + k] ^ four[b[active] + k]
            alike = differ == 0
            ended_at = sum((differ & np.uint64((1 << bits) - 1)) == 0 for bits in (16, 32, 48))
            out[active + 1] += np.where(alike, 4, ended_at)
            active, k = active[alike], k + 4
        return np.minimum(out, self.depth).astype(np.uint8)

    def sort(self) -> tuple[np.ndarray, np.ndarray]:
        by_letter = self.lms[np.argsort(self.text[self.lms], kind="stable")]
        order, _ = self.induce(by_letter, np.zeros(len(by_letter), np.uint8))
        starts = np.zeros(len(self.text), bool)
        starts[self.lms] = True
        rank = self._names(order[starts[order]])
        covered = 1
        while covered <= self.depth and rank.max(initial=0) + 1 < len(rank):
            after = np.r_[rank[covered:] + 1, np.zeros(min(covered, len(rank)), np.int64)][: len(rank)]
            _, rank = np.unique(rank * (len(rank) + 1) + after, return_inverse=True)
            covered *= 2
        seeds = self.lms[np.argsort(rank, kind="stable")]
        return self.induce(seeds, self._common(seeds))
