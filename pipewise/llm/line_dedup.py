"""Lines that many documents share leave every document.

Normalised lines are exploded as 128-bit digests, each document counts once per
digest, digests found in at least ``min_docs`` documents are frequent, and a
document is put together again from the positions that stay. Counting combines
before the shuffle; the join of positions with frequent digests has one row per
digest on one side, so a hot line only makes a skewed partition that is split.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pipewise.llm.shared import WHITE, ascii_lower, digest128, text_of, unpacked, whole_row

MIN_DOCS, MIN_CHARS = 10, 1


def line_key(line: Column) -> Column:
    """The line without white space at both ends, A-Z in lower case."""
    return ascii_lower(F.btrim(line, F.lit(WHITE)))


def _split(docs: DataFrame) -> DataFrame:
    """One row per document: id, row (all columns), mark (tells rows of one id
    apart), lines."""
    text = text_of("text")
    return docs.select(
        F.col("doc_id").alias("id"),
        whole_row(docs).alias("row"),
        F.xxhash64(text).alias("mark"),
        F.split(text, "\n", -1).alias("lines"),
    )


def repeated_positions(docs: DataFrame, min_docs: int, min_chars: int) -> DataFrame:
    """(id, mark, dropped): positions of the lines to drop, for documents that have any."""
    lines = _split(docs).select("id", "mark", F.posexplode("lines").alias("pos", "line"))
    keyed = lines.select("id", "mark", "pos", line_key(F.col("line")).alias("key"))
    keyed = keyed.filter(F.char_length("key") >= min_chars).select(
        "id", "mark", "pos", digest128(F.col("key")).alias("digest")
    )
    frequent = (
        keyed.select("id", "digest")
        .distinct()
        .groupBy("digest")
        .count()
        .filter(F.col("count") >= min_docs)
        .select("digest")
    )
    return (
        keyed.join(frequent, "digest")
        .groupBy("id", "mark")
        .agg(F.collect_set("pos").alias("dropped"))
    )


def line_verdicts(
    docs: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS
) -> DataFrame:
    """(row, n_lines, n_dropped, kept): the text without lines many documents share.

    A line's key is the line trimmed and with A-Z lowered; keys shorter than
    ``min_chars`` code points never count. Documents are told apart by
    ``doc_id``; rows without one count as one document. A null or empty text is
    one empty line. Rows repeated under one id get one verdict each. An empty
    table gives an empty result. Nothing is capped: a line is dropped wherever
    it stands, and a document may lose all of its lines (``kept`` is empty).
    """
    drops = repeated_positions(docs, min_docs, min_chars)
    split = _split(docs)
    joined = split.join(
        drops.select(F.col("id").alias("d_id"), F.col("mark").alias("d_mark"), "dropped"),
        F.col("id").eqNullSafe(F.col("d_id")) & (F.col("mark") == F.col("d_mark")),
        "left",
    )
    dropped = F.coalesce("dropped", F.array().cast("array<int>"))
    positions = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), dropped)
    return joined.select(
        "row",
        F.size("lines").cast("long").alias("n_lines"),
        F.size(dropped).cast("long").alias("n_dropped"),
        F.array_join(
            F.transform(positions, lambda p: F.get(F.col("lines"), p)), "\n"
        ).alias("kept"),
    )


def drop_repeated_lines(
    docs: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS
) -> DataFrame:
    """The documents, same columns, with the kept text and its ``n_chars``."""
    changed = {"text": F.col("kept")}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.char_length("kept").cast("long")
    return unpacked(line_verdicts(docs, min_docs, min_chars), "row", docs, **changed)
