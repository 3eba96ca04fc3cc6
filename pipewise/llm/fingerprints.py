"""Document fingerprints as invertible Bloom lookup sketches, in native expressions.

A text is cut into paragraphs (lines, longer ones every ``PIECE`` code points),
and each distinct paragraph is hashed to 64 bits. A sketch has ``cells`` in
three parts; a digest goes into one cell of each part, where count, digests and
checks are summed by exclusive or. Sketches of two versions subtract cell by
cell; what both hold cancels, and peeling cells that hold one digest recovers
the paragraphs that differ. If peeling gets stuck, the digests are dealt into
sections by their hash and each section is sketched again, larger at every
retry. The likeness is the share of common paragraphs in all paragraphs of both.

Everything happens within a row; the only shuffles are those that bring the
next document beside each one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pipewise.llm.shared import text_of
from pipewise.sources.scratch import materialize

PIECE = 160
CELLS = 18
"""Cells of the fingerprint; a multiple of three, like the sizes of retries."""
RETRIES = (24, 48, 96, 192, 384)
SECTION = 16
"""Digests of both versions in a section, on average."""
ROUNDS = 8

_CELL = "struct<c:int,k:bigint,h:bigint>"
_FOUND = "struct<s:int,k:bigint>"


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value worked out once."""
    return F.get(F.transform(F.array(value), body), 0)


def digests(text: Column) -> Column:
    """The distinct 64-bit hashes of a text's paragraphs."""
    pieces = F.regexp_extract_all(text, F.lit(rf"[^\n]{{1,{PIECE}}}"), F.lit(0))
    return F.array_distinct(F.transform(pieces, lambda p: F.xxhash64(p)))


def _check(digest: Column) -> Column:
    return F.xxhash64(digest, F.lit(99)).bitwiseAND(F.lit(0xFFFFFFFF))


def _place(digest: Column, part: int, cells: Column) -> Column:
    third = (cells / 3).cast("int")
    return (F.pmod(F.xxhash64(digest, F.lit(part)), third) + part * third).cast("int")


def _at(digest: Column, cells: Column) -> Column:
    return F.struct(
        digest.alias("k"),
        _check(digest).alias("h"),
        *[_place(digest, part, cells).alias(f"i{part}") for part in range(3)],
    )


def _holds(item: Column, i: Column) -> Column:
    return (item["i0"] == i) | (item["i1"] == i) | (item["i2"] == i)


def _xor(items: Column, field: str) -> Column:
    return F.aggregate(items, F.lit(0).cast("long"), lambda s, x: s.bitwiseXOR(x[field]))


def sketch(found: Column, cells: Column) -> Column:
    """The cells of a set of digests."""
    def cell(own: Column) -> Column:
        return F.struct(F.size(own).alias("c"), _xor(own, "k").alias("k"), _xor(own, "h").alias("h"))

    def of(items: Column) -> Column:
        return F.transform(
            F.sequence(F.lit(0), (cells - 1).cast("int")),
            lambda i: _let(F.filter(items, lambda x: _holds(x, i)), cell),
        )

    return _let(F.transform(found, lambda d: _at(d, cells)), of).cast(f"array<{_CELL}>")


def subtract(a: Column, b: Column) -> Column:
    return F.zip_with(
        a,
        b,
        lambda p, q: F.struct(
            (p["c"] - q["c"]).alias("c"),
            p["k"].bitwiseXOR(q["k"]).alias("k"),
            p["h"].bitwiseXOR(q["h"]).alias("h"),
        ),
    ).cast(f"array<{_CELL}>")


def peel(difference: Column, cells: Column) -> Column:
    """(left, right): how many digests only either version has; null if stuck.

    Each round takes all cells that hold one digest and removes these digests
    from their other cells.
    """

    def step(state: Column, _) -> Column:
        pure = F.filter(
            state["cells"], lambda c: (F.abs(c["c"]) == 1) & (_check(c["k"]) == c["h"])
        )
        items = F.array_distinct(
            F.transform(pure, lambda c: F.struct(c["c"].alias("s"), _at(c["k"], cells).alias("at")))
        )

        def removed(own: Column) -> Column:
            def without(c: Column, i: Column) -> Column:
                mine = F.filter(own, lambda x: _holds(x["at"], i))
                return F.aggregate(
                    mine,
                    c,
                    lambda z, x: F.struct(
                        (z["c"] - x["s"]).alias("c"),
                        z["k"].bitwiseXOR(x["at"]["k"]).alias("k"),
                        z["h"].bitwiseXOR(x["at"]["h"]).alias("h"),
                    ).cast(_CELL),
                )

            found = F.transform(
                own, lambda x: F.struct(x["s"].alias("s"), x["at"]["k"].alias("k"))
            )
            return F.struct(
                F.transform(state["cells"], without).cast(f"array<{_CELL}>").alias("cells"),
                F.concat(state["found"], found).cast(f"array<{_FOUND}>").alias("found"),
            )

        return _let(items, lambda own: F.when(F.size(own) == 0, state).otherwise(removed(own)))

    start = F.struct(
        difference.cast(f"array<{_CELL}>").alias("cells"),
        F.array().cast(f"array<{_FOUND}>").alias("found"),
    )
    empty = lambda c: (c["c"] == 0) & (c["k"] == 0) & (c["h"] == 0)
    return F.aggregate(
        F.sequence(F.lit(1), F.lit(ROUNDS)),
        start,
        step,
        lambda s: F.when(
            F.forall(s["cells"], empty),
            F.struct(
                F.size(F.filter(s["found"], lambda x: x["s"] == 1)).alias("left"),
                F.size(F.filter(s["found"], lambda x: x["s"] == -1)).alias("right"),
            ),
        ),
    )


def _sound(found: Column, a: Column, b: Column) -> Column:
    """What was peeled, if it explains the sizes of both sets."""
    explains = F.size(a) - found["left"] == F.size(b) - found["right"]
    return F.when(explains, found)


def _retried(section: Column) -> Column:
    """Differences of one section, with larger sketches until peeling succeeds."""
    a, b = section["a"], section["b"]

    def attempt(state: Column, cells: Column) -> Column:
        own = lambda: _let(
            peel(subtract(sketch(a, cells), sketch(b, cells)), cells),
            lambda found: _sound(found, a, b),
        )
        return F.coalesce(state, own())

    sizes = F.array(*[F.lit(m) for m in RETRIES])
    none = F.lit(None).cast("struct<left:int,right:int>")
    compared = F.struct(
        F.size(F.array_except(a, b)).alias("left"), F.size(F.array_except(b, a)).alias("right")
    )
    return F.coalesce(F.aggregate(sizes, none, attempt), compared)


def _dealt(sets: Column, count: Column, salt: int) -> Column:
    """The pair of sets dealt into ``count`` pairs by a hash of each digest."""
    def own(digests: Column, s: Column) -> Column:
        return F.filter(digests, lambda d: F.pmod(F.xxhash64(d, F.lit(salt)), count) == s)

    return F.transform(
        F.sequence(F.lit(0), (count - 1).cast("int")),
        lambda s: F.struct(own(sets["a"], s).alias("a"), own(sets["b"], s).alias("b")),
    )


def _in_sections(a: Column, b: Column) -> Column:
    """Differences by sections; these are dealt in two steps, so the work grows
    with size to the power 1.5 at most."""
    total = F.size(a) + F.size(b)
    count = F.greatest(F.lit(1), F.ceil(F.sqrt(total / SECTION))).cast("int")
    both = F.struct(a.alias("a"), b.alias("b"))
    sections = F.flatten(F.transform(_dealt(both, count, 7), lambda s: _dealt(s, count, 8)))
    found = F.transform(sections, _retried)
    return F.aggregate(
        found,
        F.struct(F.lit(0).alias("left"), F.lit(0).alias("right")),
        lambda s, x: F.struct(
            (s["left"] + x["left"]).alias("left"), (s["right"] + x["right"]).alias("right")
        ),
    )


def likeness(a: Column, b: Column, sketch_a: Column, sketch_b: Column) -> Column:
    """Common paragraphs over all paragraphs of both sets, 1 if both are empty,
    from the difference of their sketches, or of larger ones if it can't be peeled."""
    cells = F.lit(CELLS)
    base = _let(
        peel(subtract(sketch_a, sketch_b), cells), lambda found: _sound(found, a, b)
    )
    found = F.coalesce(base, _in_sections(a, b))
    return _let(
        found,
        lambda d: F.when(F.size(a) + d["right"] == 0, F.lit(1.0)).otherwise(
            (F.size(a) - d["left"]) / (F.size(a) + d["right"])
        ),
    )


def written(text: Column, cells: Column) -> Column:
    """The fingerprint: the hash of the whole text, then count, digests and check
    of each cell, in hexadecimal."""
    def padded(value: Column, width: int) -> Column:
        return F.lpad(F.hex(value), width, "0")

    parts = F.transform(
        cells, lambda c: F.concat(padded(c["c"], 4), padded(c["k"], 16), padded(c["h"], 8))
    )
    return F.lower(F.concat(padded(F.xxhash64(text), 16), F.array_join(parts, "")))


def next_in_order(rows: DataFrame) -> DataFrame:
    """(id, mark, next_id, next_mark) for distinct (id, mark): the following row in
    descending order, after the last the first.

    Rows are range partitioned and ordered within their range; the first row of
    each range (one per partition) tells the range above what follows its last.
    """
    ranged = rows.select("id", "mark").distinct().repartitionByRange("id")
    ranged = materialize(ranged.withColumn("range", F.spark_partition_id()), "ranges")
    falling = Window.partitionBy("range").orderBy(F.desc("id"), F.desc("mark"))
    following = ranged.withColumn("next", F.lead(F.struct("id", "mark")).over(falling))
    heads = ranged.groupBy("range").agg(F.max(F.struct("id", "mark")).alias("head"))
    # one row per range from here on
    order = Window.orderBy(F.desc("head"))
    heads = heads.withColumn("after", F.lead("head").over(order))
    heads = heads.withColumn("after", F.coalesce("after", F.first("head").over(order)))
    heads = heads.select(F.col("range").alias("own"), "after")
    joined = following.join(F.broadcast(heads), F.col("range") == F.col("own"))
    after = F.coalesce("next", "after")
    return joined.select(
        "id", "mark", after["id"].alias("next_id"), after["mark"].alias("next_mark")
    )


def compare_versions(docs: DataFrame) -> DataFrame:
    """For every row: doc_id, n_chars, edited (text), fingerprint, edited_fingerprint,
    near_edited, near_next.

    A document's edited text has its last floor(n_chars / 3) code points replaced
    by as many first ones, or all, of the next document in descending order of
    id. Rows of one id with different texts are ordered by a hash of the text;
    repeated rows have equal results; rows without an id come in no order and
    their next text is empty. Null texts are empty. Empty texts have no
    paragraph; two of them are alike (1). An empty table gives an empty result.
    """
    text = text_of(docs["text"])
    rows = docs.select(
        docs["doc_id"].cast("long").alias("id"), F.xxhash64(text).alias("mark"), text.alias("text")
    )
    # filtered alike wherever it is joined, so that texts are exchanged once
    named = rows.filter("id IS NOT NULL")
    sizes = named.select("id", "mark", F.char_length("text").alias("n"))
    order = next_in_order(sizes)
    wanted = order.join(sizes.distinct(), ["id", "mark"]).select(
        F.col("id").alias("for_id"), F.col("mark").alias("for_mark"), "n",
        F.col("next_id").alias("id"), F.col("next_mark").alias("mark"),
    )
    wanted = materialize(wanted, "next-documents")
    third = F.floor(F.col("n") / 3).cast("int")
    heads = named.join(wanted, ["id", "mark"]).select(
        "for_id",
        "for_mark",
        F.substring(F.col("text"), F.lit(1), third).alias("head"),
        digests(F.col("text")).alias("next"),
    )
    heads = heads.groupBy("for_id", "for_mark").agg(
        F.first("head").alias("head"), F.first("next").alias("next")
    )
    joined = named.join(
        heads,
        (F.col("id") == F.col("for_id")) & (F.col("mark") == F.col("for_mark")),
        "left",
    ).select("id", "text", "head", "next")
    alone = rows.filter("id IS NULL").select(
        "id", "text", F.lit("").alias("head"), F.array().cast("array<bigint>").alias("next")
    )
    joined = joined.unionByName(alone)
    n = F.char_length("text")
    edited = F.concat(
        F.substring(F.col("text"), F.lit(1), n - F.floor(n / 3).cast("int")),
        F.coalesce("head", F.lit("")),
    )
    none = F.array().cast("array<bigint>")
    parts = joined.select(
        "id", "text", edited.alias("edited"), F.coalesce("next", none).alias("next")
    ).select(
        "*", digests(F.col("text")).alias("own"), digests(F.col("edited")).alias("changed")
    )
    cells = F.lit(CELLS)
    sketched = parts.select(
        "*",
        sketch(F.col("own"), cells).alias("own_cells"),
        sketch(F.col("changed"), cells).alias("changed_cells"),
        sketch(F.col("next"), cells).alias("next_cells"),
    )
    own, changed, following = F.col("own"), F.col("changed"), F.col("next")
    return sketched.select(
        F.col("id").alias("doc_id"),
        F.char_length("text").cast("long").alias("n_chars"),
        "edited",
        written(F.col("text"), F.col("own_cells")).alias("fingerprint"),
        written(F.col("edited"), F.col("changed_cells")).alias("edited_fingerprint"),
        likeness(own, changed, F.col("own_cells"), F.col("changed_cells")).alias("near_edited"),
        likeness(own, following, F.col("own_cells"), F.col("next_cells")).alias("near_next"),
    )
