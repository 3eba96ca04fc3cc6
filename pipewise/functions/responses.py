"""Getting a JSON object out of a free-text response."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from pipewise.functions.text import is_blank, let, trim_all

CHANGE = "array<struct<cell_id:string,new_code:string,celda_id:string,codigo_nuevo:string>>"
DONE = (
    "array<struct<description:string,estimated_savings:string,"
    "descripcion:string,ahorro_estimado:string>>"
)


def json_texts(raw: Column) -> list[Column]:
    """The four readings of a response, first choice first.

    Whole text; fences cut from both ends; first fenced block; from the first
    ``{`` to the last ``}``.
    """
    text = trim_all(raw)
    unfenced = trim_all(
        F.regexp_replace(F.regexp_replace(text, r"^```(?:json)?\s*", ""), r"\s*```\s*\z", "")
    )
    block = F.regexp_extract(text, r"```(?:json)?\s*(\{[\s\S]*?\})\s*```", 1)
    outer = F.regexp_extract(text, r"(?s)\{.*\}", 0)
    return [text, unfenced, block, outer]


_REPEATED = "spark.sql.variant.allowDuplicateKeys"


@contextmanager
def repeated_keys(spark: SparkSession) -> Iterator[None]:
    """Variants parsed by plans made within may repeat keys: the last one counts.
    The session is left as it was."""
    before = spark.conf.get(_REPEATED)
    spark.conf.set(_REPEATED, "true")
    try:
        yield
    finally:
        spark.conf.set(_REPEATED, before)


_LOOSE_NUMBER = (
    r'(?s)\G((?:[^"NI-]++|"(?:[^"\\]++|\\.)*+"|-(?!Infinity)|N(?!aN)|I(?!nfinity))*+)(NaN|-?Infinity)'
)
"""Text up to the next NaN or Infinity outside of a string, and that number."""


def quoted_numbers(text: Column) -> Column:
    """NaN and the infinities, which JSON does not have, as strings of that name;
    inside strings nothing changes."""
    return F.when(
        text.contains("NaN") | text.contains("Infinity"),
        F.regexp_replace(text, _LOOSE_NUMBER, '$1"$2"'),
    ).otherwise(text)


def parsed_response(raw: Column) -> Column:
    """``struct(method, is_object, doc)`` of the first reading that is JSON as a
    whole; NULL if none is. Readings after it are not tried. NaN and the
    infinities are read as strings. Of a key that an object repeats the last
    counts if the session reads variants so (``repeated_keys``)."""

    def whole(text: Column) -> Column:
        # The parser stops after the first value. With more text behind it, the
        # value is no single element of a list, or no single field of an object.
        listed = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))
        field = F.try_parse_json(F.concat(F.lit('{"v":'), text, F.lit("}")))
        return let(
            listed, lambda found: F.when(field.isNotNull(), F.try_variant_get(found, "$[0]", "variant"))
        )

    def parse(method: int, text: Column) -> Column:
        # Failing to parse is the dear case, so what cannot be JSON is not tried.
        doc = F.when(text.rlike(r'^[\[{"\-0-9tfnNI]'), whole(quoted_numbers(text)))
        return let(
            doc,
            lambda d: F.when(
                d.isNotNull(),
                F.struct(
                    F.lit(method).alias("method"),
                    text.startswith("{").alias("is_object"),
                    d.alias("doc"),
                ),
            ),
        )

    def attempt(method: int, text: Column) -> Column:
        return let(text, lambda t: parse(method, t))

    return F.coalesce(*[attempt(i, text) for i, text in enumerate(json_texts(raw), 1)])


def _either(doc: Column, names: list[str], kind: str) -> Column:
    return F.coalesce(*[F.try_variant_get(doc, f"$.{n}", kind) for n in names])


def changes_of(doc: Column) -> Column:
    """Cell changes, under either spelling of the keys."""
    raw = _either(doc, ["cambios", "changes"], CHANGE)
    return F.transform(
        raw,
        lambda c: F.struct(
            F.coalesce(c["celda_id"], c["cell_id"]).alias("cell_id"),
            F.coalesce(c["codigo_nuevo"], c["new_code"]).alias("new_code"),
        ),
    )


def whole_script_of(doc: Column) -> Column:
    return _either(doc, ["codigo_optimizado", "optimized_code"], "string")


def analysis_of(doc: Column) -> Column:
    """The analysis object as JSON text; ``{}`` without one."""
    found = [F.to_json(F.try_variant_get(doc, f"$.{n}", "variant")) for n in ("analisis", "analysis")]
    return F.coalesce(*found, F.lit("{}"))


def summary_of(analysis_json: Column) -> Column:
    """What the script does, in the words of the analysis; NULL without any."""
    names = ["que_hace", "what_it_does"]
    return let(
        F.try_parse_json(analysis_json),
        lambda doc: F.coalesce(
            *[_full(F.try_variant_get(doc, f"$.{n}", "string")) for n in names]
        ),
    )


def applied_changes_of(analysis_json: Column) -> Column:
    """``array<struct<description, savings>>`` of an analysis; empty if bad JSON."""
    doc = F.try_parse_json(analysis_json)
    raw = _either(doc, ["cambios_aplicados", "changes_applied"], DONE)
    return F.transform(
        F.coalesce(raw, F.array().cast(DONE)),
        lambda c: F.struct(
            F.coalesce(_full(c["descripcion"]), c["description"], F.lit("")).alias("description"),
            F.lower(
                F.coalesce(_full(c["ahorro_estimado"]), c["estimated_savings"], F.lit(""))
            ).alias("savings"),
        ),
    )


def _full(text: Column) -> Column:
    return F.when(text != "", text)


def rewrite_kind(changes: Column, whole: Column) -> Column:
    """Which part of a response makes the new text."""
    return (
        F.when(F.coalesce(F.size(changes), F.lit(0)) > 0, "changes")
        .when(~is_blank(whole), "whole_script")
        .otherwise("none")
    )
