"""Benchmark decontamination by template canonicalisation.

Words become templates: numbers, names (capitalised words within a sentence, a
run of them as one) and units (after a number) become typed placeholders, all
other words their letters in lower case. Windows of ``WINDOW`` template tokens
of documents are joined by hash with those of the benchmark items. Matches on
one diagonal (same distance between the places in document and item) are one
candidate; its slots are consistent if equal values of the item stand for equal
values of the document and the other way round, which holds for copies and for
questions asked again with other numbers or names.

Documents are filtered by a bitmap of the items' window hashes, a broadcast of
fixed size, before anything is shuffled; a fuller bitmap only lets more windows
through to the join.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pipewise.llm.grams import rolling, word_bounds, word_codes
from pipewise.llm.shared import record_batch, text_of
from pipewise.sources.scratch import materialize

WINDOW = 8
LITERAL = 4
"""Tokens of a window that must be words, not placeholders. The words as written have none."""
SHARE = 0.5
"""Share of an item's windows that must match on one diagonal, or a chain of them."""
SLACK = 8
"""Tokens put in or left out between two diagonals of a chain, at most."""
BITMAP_WORDS = 1 << 20
BATCH_BYTES = 1 << 20

WORD, NUMBER, NAME, UNIT = range(4)
PLAIN = 2
"""The reading of words as written."""
_SLOT_CODES = np.array([0, 0x9AE16A3B2F90404F, 0xC949D7C7509E6557, 0xE7037ED1A0B428DB], np.uint64)

NUMBER_WORDS = frozenset(
    """
    zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen
    sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety
    hundred thousand million billion half dozen
    """.split()
)
UNITS = frozenset(
    """
    mm cm m km in inch inches ft foot feet yard yards mile miles mg g kg gram grams kilogram
    kilograms lb lbs pound pounds oz ounce ounces ton tons ml l liter liters litre litres gallon
    gallons cup cups s sec second seconds min minute minutes h hr hour hours day days week weeks
    month months year years cent cents dollar dollars euro euros usd eur percent degree degrees
    meter meters metre metres kilometer kilometers kilometre kilometres mph kmh watt watts kw volt
    volts amp amps hz khz mhz ghz byte bytes kb mb gb tb
    """.split()
)


def _table(marked: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(marked)] = True
    return out


_DIGIT = _table(b"0123456789")
_ALNUM = _DIGIT | _table(bytes(range(65, 91)) + bytes(range(97, 123)) + bytes(range(128, 256)))
_STOP, _QUOTE = _table(b".!?:"), _table(b"'\")]")


def _codes_of(words: frozenset[str]) -> np.ndarray:
    raw = [w.encode() for w in sorted(words)]
    ends = np.cumsum([len(w) for w in raw])
    starts = np.r_[0, ends[:-1]]
    return np.sort(word_codes(np.frombuffer(b"".join(raw), np.uint8), starts, ends))


_NUMBER_CODES, _UNIT_CODES = _codes_of(NUMBER_WORDS), _codes_of(UNITS)


@dataclass
class Template:
    """Template tokens of several texts, one after the other: code, kind, number of
    the text, and the bytes [start, end) of the word behind a token."""

    text: bytes
    code: np.ndarray
    kind: np.ndarray
    owner: np.ndarray
    start: np.ndarray
    end: np.ndarray

    def slots(self, place: int, size: int) -> list[str]:
        own = range(place, place + size)
        return [
            "?#@%"[self.kind[k]]
            + self.text[self.start[k] : self.end[k]].decode("utf-8", "replace").lower().replace(",", "")
            for k in own
            if self.kind[k] != WORD
        ]


def template_of(texts: list[bytes]) -> Template:
    """The first of ``readings_of``."""
    return readings_of(texts)[0]


def readings_of(texts: list[bytes]) -> list[Template]:
    """Canonical tokens in each reading: names told within sentences only; words
    that begin a sentence with a capital taken as names too; and the words as
    written, in lower case, without a placeholder, so that every window counts.

    Canonical tokens. A word is what white space leaves together, less signs
    at both ends; words of signs only are no token. A number begins with a
    digit and has at most three letters (5kg, 3rd), or is a number word. A name
    begins with a capital, does not begin a sentence or line, and does not end
    with a capital too (those are abbreviations, and texts in capitals)."""
    text = b"\n".join(texts)
    buffer = np.frombuffer(text, np.uint8)
    lower = text.decode("utf-8", "replace").lower().encode()
    lower = np.frombuffer(lower if len(lower) == len(text) else text.lower(), np.uint8)
    starts, ends = word_bounds(buffer)
    alnum = _ALNUM[buffer]
    place = np.arange(len(buffer))
    after = np.minimum.accumulate(np.where(alnum, place, len(buffer))[::-1])[::-1]
    before = np.maximum.accumulate(np.where(alnum, place, -1))
    keep = after[starts] < ends if len(starts) else np.empty(0, bool)
    last = buffer[ends - 1]
    closes = _STOP[last] | (_QUOTE[last] & _STOP[buffer[np.maximum(ends - 2, 0)]])
    lines = np.cumsum(buffer == 10)
    line = lines[starts]
    begins = np.r_[True, closes[:-1] | (line[1:] != line[:-1])][: len(starts)]
    starts, ends, begins = starts[keep], ends[keep], begins[keep]
    start, end = after[starts], before[ends - 1] + 1
    bounds = np.cumsum([len(t) + 1 for t in texts])
    owner = np.searchsorted(bounds, start, "right")

    code = word_codes(lower, start, end)
    letters = np.cumsum(np.r_[0, alnum & ~_DIGIT[buffer]])
    number = _DIGIT[buffer[start]] & (letters[end] - letters[start] <= 3)
    number |= _within(code, _NUMBER_CODES)
    raised = lower != buffer
    second = np.minimum(start + 1, end - 1)
    high = raised[start] | (raised[second] & (buffer[start] >= 0xC0))
    inside = high & ~(raised[end - 1] & (end - start > 1) & (letters[end] - letters[start] > 1))
    first = np.r_[True, owner[1:] != owner[:-1]][: len(owner)]
    behind_number = np.r_[False, number[:-1]][: len(owner)] & ~first
    unit = _within(code, _UNIT_CODES) & behind_number
    out = []
    for name in (inside & ~begins, inside):
        kind = np.where(name, NAME, WORD)
        kind = np.where(unit, UNIT, kind)
        kind = np.where(number, NUMBER, kind)
        slotted = np.where(kind == WORD, code, _SLOT_CODES[kind])
        # of a run of names the first stays
        stays = ~((kind == NAME) & (np.r_[0, kind[:-1]][: len(kind)] == NAME) & ~first)
        out.append(Template(text, *(x[stays] for x in (slotted, kind, owner, start, end))))
    plain = np.full(len(code), WORD)
    return [*out, Template(text, code, plain, owner, start, end)]


def _within(codes: np.ndarray, known: np.ndarray) -> np.ndarray:
    return known[np.minimum(np.searchsorted(known, codes), len(known) - 1)] == codes


def windows_of(found: Template, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, hashes) of the windows of ``size`` tokens of one text that have
    enough words among them."""
    hashes = rolling(found.code, size)
    count = len(hashes)
    words = np.cumsum(np.r_[0, found.kind == WORD])
    good = words[size:][:count] - words[:count] >= min(LITERAL, size)
    good &= found.owner[size - 1 :][:count] == found.owner[:count]
    places = np.flatnonzero(good)
    return places, hashes[places].view(np.int64)


ITEM_WINDOWS = (
    "item_id long, reading int, at int, size int, h long, item_slots array<string>, item_windows int"
)


def item_windows(benchmark: DataFrame, size: int) -> DataFrame:
    """One row per window of every item. An item of fewer template tokens than a
    window is one window, its whole template."""

    def found(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in tables:
            rows = []
            for item, text in zip(*(c.to_pylist() for c in table.columns)):
                for n, own in enumerate(readings_of([text])):
                    width = min(size, len(own.code))
                    places, hashes = windows_of(own, width) if width else ((), ())
                    for p, h in zip(places.tolist() if width else (), hashes.tolist() if width else ()):
                        rows.append((item, n, p, width, h, own.slots(p, width), len(places)))
            yield record_batch(rows, ITEM_WINDOWS)

    texts = benchmark.filter("item_id IS NOT NULL").select(
        F.col("item_id").cast("long"), text_of(benchmark["text"]).cast("binary")
    )
    return texts.mapInArrow(found, ITEM_WINDOWS).distinct()


def _bits(windows: DataFrame) -> np.ndarray:
    """A bitmap of the hashes: BITMAP_WORDS words, whatever the number of windows."""
    place = F.col("h").bitwiseAND(F.lit(64 * BITMAP_WORDS - 1))
    one = F.lit(1).cast("long")
    rows = windows.select(
        F.shiftright(place, 6).alias("word"),
        F.call_function("shiftleft", one, place.bitwiseAND(F.lit(63)).cast("int")).alias("bit"),
    )
    words = rows.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(BITMAP_WORDS, np.int64)
    out[words.column(0).to_numpy()] = words.column(1).to_numpy()
    return out.view(np.uint64)


HITS = "doc_id long, reading int, pos int, size int, h long, doc_slots array<string>"


def document_windows(docs: DataFrame, bits: np.ndarray, sizes: list[int]) -> DataFrame:
    """Windows of whole texts, of each size that items have, that the bitmap lets through."""
    shared = docs.sparkSession.sparkContext.broadcast(bits)

    def hits(ids: list[int], texts: list[bytes]) -> pa.RecordBatch:
        bitmap, rows = shared.value, []
        for n, own in enumerate(readings_of(texts)):
            # places are counted from the first token of a text
            firsts = np.searchsorted(own.owner, np.arange(len(texts)))
            for size in sizes:
                places, hashes = windows_of(own, size)
                bit = hashes & (64 * BITMAP_WORDS - 1)
                hit = bitmap[bit >> 6] >> (bit & 63).astype(np.uint64) & np.uint64(1) > 0
                places, hashes = places[hit], hashes[hit]
                if size < LITERAL:
                    # words only, one window per item: one place in a text says all
                    keys = np.stack([own.owner[places], hashes])
                    once = np.unique(keys, axis=1, return_index=True)[1] if len(places) else []
                    places, hashes = places[once], hashes[once]
                for p, h in zip(places.tolist(), hashes.tolist()):
                    k = own.owner[p]
                    rows.append((ids[k], n, int(p - firsts[k]), size, h, own.slots(p, size)))
        return record_batch(rows, HITS)

    def found(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, held = [], [], 0
        for table in tables:
            for doc, text in zip(table.column(0).to_pylist(), table.column(1)):
                ids.append(doc)
                texts.append(text.as_py())
                held += len(texts[-1])
                if held >= BATCH_BYTES:
                    yield hits(ids, texts)
                    ids, texts, held = [], [], 0
        if ids:
            yield hits(ids, texts)

    texts = docs.filter(docs["doc_id"].isNotNull()).select(
        docs["doc_id"].cast("long"), text_of(docs["text"]).cast("binary")
    )
    return texts.mapInArrow(found, HITS)


def chain(runs: np.ndarray) -> list[tuple[int, int, int]]:
    """The runs (pos, at, length), sorted by place, that follow each other in
    document and item on diagonals at most ``SLACK`` apart and hold most windows;
    what two runs share counts once."""
    pos, at, size = runs.T
    best, back = size.copy(), np.full(len(runs), -1)
    cut = np.zeros(len(runs), np.int64)
    # at most the item's length and SLACK lie between the places of neighbours
    lows = np.searchsorted(pos, pos - (int(at.max()) + SLACK))
    for k in range(1, len(runs)):
        low = int(lows[k])
        i = low + np.flatnonzero(np.abs((pos[low:k] - at[low:k]) - (pos[k] - at[k])) <= SLACK)
        lost = np.maximum(0, np.maximum(at[i] + size[i] - at[k], pos[i] + size[i] - pos[k]))
        value = np.where((at[i] <= at[k]) & (lost < size[k]), best[i] + size[k] - lost, 0)
        if len(i) and value.max() > best[k]:
            best[k], back[k], cut[k] = value.max(), i[value.argmax()], lost[value.argmax()]
    out, k = [], int(best.argmax())
    while k >= 0:
        out.append((int(pos[k] + cut[k]), int(at[k] + cut[k]), int(size[k] - cut[k])))
        k = int(back[k])
    return out


CHAINED = (
    "doc_id long, item_id long, reading int, matched int, item_windows int, changed int, held boolean"
)


def _chained(met: DataFrame, share: float) -> DataFrame:
    """Documents and items whose windows match often enough over a chain of
    diagonals; not held if its slots are not one-to-one."""

    def found(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in tables:
            rows = []
            for doc, item, reading, total, windows in zip(*(c.to_pylist() for c in table.columns)):
                slots = {(w["pos"], w["at"]): (w["item_slots"], w["doc_slots"]) for w in windows}
                runs = []
                for p, a in sorted(slots, key=lambda x: (x[0] - x[1], x[0])):
                    if runs and runs[-1][0] + runs[-1][2] == p and runs[-1][1] + runs[-1][2] == a:
                        runs[-1][2] += 1
                    else:
                        runs.append([p, a, 1])
                own = chain(np.array(sorted(runs), np.int64))
                pairs = {
                    pair
                    for p, a, n in own
                    for k in range(n)
                    for pair in zip(*slots[p + k, a + k])
                }
                one_to_one = len({i for i, _ in pairs}) == len({d for _, d in pairs}) == len(pairs)
                matched = sum(n for _, _, n in own)
                if matched >= share * total:
                    changed = sum(i != d for i, d in pairs)
                    rows.append((doc, item, reading, matched, total, changed, one_to_one))
            yield record_batch(rows, CHAINED)

    window = F.struct("pos", "at", "item_slots", "doc_slots")
    grouped = met.groupBy("doc_id", "item_id", "reading").agg(
        F.max("item_windows").alias("item_windows"),
        F.count_distinct("at").alias("places"),
        F.collect_list(window).alias("windows"),
    )
    grouped = grouped.filter(F.col("places") >= share * F.col("item_windows"))
    columns = grouped.select("doc_id", "item_id", "reading", "item_windows", "windows")
    return columns.mapInArrow(found, CHAINED)


def contaminated(
    docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, share: float = SHARE
) -> DataFrame:
    """(doc_id, item_id, matched, item_windows, coverage, changed_slots): one row
    for every document and item it holds.

    An item is held if on one diagonal at least ``share`` of its windows match
    and their slots are consistent; of several diagonals the one with most
    windows, then fewest changed slots, is reported. Where no diagonal does, a
    chain of neighbouring ones counts: words put in, left out or written as more
    words. Both hold in any reading; the words as written have no slots, so an
    item whose windows match often enough as written is held, also where two of
    its values became one. ``changed_slots`` counts
    the values that differ: 0 for a copy, more for a question asked again.
    Items without a window of enough words (few words, or placeholders only)
    are found as written only, an item of one word in every text that has it;
    signs between words are not compared. Null texts are empty; rows without an id are left out, as
    no pair can name them; repeated rows count once. Empty tables give an empty
    result.
    """
    items = materialize(item_windows(benchmark, size), "item-windows")
    # one row per window size, at most ``size`` of them
    sizes = sorted(r["size"] for r in items.select("size").distinct().collect())
    hits = document_windows(docs, _bits(items), sizes).distinct()
    met = hits.join(items, ["h", "size", "reading"]).filter(F.size("doc_slots") == F.size("item_slots"))
    pairs = F.arrays_zip(F.col("item_slots").alias("i"), F.col("doc_slots").alias("d"))
    # at most one row per window of the item on a diagonal
    met = materialize(met, "met-windows")
    lines = met.filter("reading = 0").groupBy("doc_id", "item_id", (F.col("pos") - F.col("at")).alias("diagonal")).agg(
        F.count_distinct("at").cast("int").alias("matched"),
        F.max("item_windows").alias("item_windows"),
        F.array_distinct(F.flatten(F.collect_list(pairs))).alias("pairs"),
    )
    values = lambda side: F.size(F.array_distinct(F.transform("pairs", lambda p: p[side])))
    lines = lines.filter(
        (F.col("matched") >= share * F.col("item_windows"))
        & (values("i") == F.size("pairs"))
        & (values("d") == F.size("pairs"))
    )
    changed = F.size(F.filter("pairs", lambda p: p["i"] != p["d"]))
    best = lines.groupBy("doc_id", "item_id").agg(
        F.max(F.struct("matched", (-changed).alias("same"))).alias("best"),
        F.max("item_windows").alias("item_windows"),
    )
    best = best.select(
        "doc_id",
        "item_id",
        F.col("best.matched").alias("matched"),
        "item_windows",
        (-F.col("best.same")).alias("changed"),
    )
    best = materialize(best, "single-diagonals")
    more = _chained(met.join(best, ["doc_id", "item_id"], "left_anti"), share)
    more = materialize(more, "chains")
    # the words as written have no slots: their share decides alone, whatever a template says
    more = more.filter("held")
    more = more.groupBy("doc_id", "item_id").agg(
        F.max(
            F.struct(
                (F.col("matched") / F.col("item_windows")).alias("coverage"),
                "matched",
                (-F.col("changed")).alias("same"),
                "item_windows",
            )
        ).alias("best")
    )
    more = more.select(
        "doc_id",
        "item_id",
        F.col("best.matched").alias("matched"),
        F.col("best.item_windows").alias("item_windows"),
        (-F.col("best.same")).alias("changed"),
    )
    return best.unionByName(more).select(
        "doc_id",
        "item_id",
        "matched",
        "item_windows",
        (F.col("matched") / F.col("item_windows")).alias("coverage"),
        F.col("changed").alias("changed_slots"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents, same columns, that hold no benchmark item; rows without an id stay."""
    held = contaminated(docs, benchmark).select(F.col("doc_id").alias("_held")).distinct()
    return docs.join(held, docs["doc_id"] == held["_held"], "left_anti")
