"""Does a rewritten table equal the original? Schema, row count, numeric sums."""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_EXACT = float(1 << 53)
"""Below this every whole number is a double of its own."""
_LARGE = 1e26
"""Below this 10**12 doubles add up within a decimal."""


@dataclass(frozen=True)
class Pair:
    """A candidate to hold against its reference; ``proposal`` groups pairs."""

    proposal: str
    table: str
    reference: DataFrame
    candidate: DataFrame


# --- schema -----------------------------------------------------------------


def schema_diff(spark: SparkSession, pairs: list[Pair]) -> DataFrame:
    """Every column of either side of every pair, with its type on both.

    ``status``: same, missing (only the reference has it), added, changed.
    Order and nullability do not count; names are case-sensitive. Metadata
    only: no job reads data.
    """

    def columns(side: str) -> DataFrame:
        rows = [
            (p.proposal, p.table, f.name, f.dataType.simpleString())
            for p in pairs
            for f in (p.reference if side == "ref" else p.candidate).schema.fields
        ]
        return spark.createDataFrame(
            rows, f"proposal string, table string, column string, {side}_type string"
        )

    both = columns("ref").join(columns("cand"), ["proposal", "table", "column"], "full")
    status = (
        F.when(F.col("cand_type").isNull(), "missing")
        .when(F.col("ref_type").isNull(), "added")
        .when(F.col("ref_type") != F.col("cand_type"), "changed")
        .otherwise("same")
    )
    return both.withColumn("status", status)


def schema_summary(diff: DataFrame) -> DataFrame:
    """Per pair: does the schema match, and which columns do not."""

    def names(status: str) -> Column:
        mine = F.when(F.col("status") == status, F.col("column"))
        return F.array_sort(F.collect_list(mine)).alias(f"{status}_columns")

    return diff.groupBy("proposal", "table").agg(
        F.bool_and(F.col("status") == "same").alias("schema_match"),
        names("missing"), names("added"), names("changed"),
    )


# --- sums -------------------------------------------------------------------


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def _slices(bits: int) -> list[int]:
    """Where a signed number of so many bits is cut: slices so narrow that their
    long sums stay in range for 2**40 rows."""
    cuts = [0]
    while bits - cuts[-1] > 23:
        cuts.append(cuts[-1] + 22)
    return cuts


def _sliced_sums(value: str, bits: int, name: str) -> list[str]:
    """Sums of bit slices of a bigint, lowest first; the top one has the sign.

    Plain long additions, where one long sum could overflow and a decimal per
    row costs about twice as much.
    """
    cuts = _slices(bits)
    sums = []
    for i, low in enumerate(cuts):
        part = f"shiftright({value}, {low})" if low else value
        if i + 1 < len(cuts):
            part = f"({part} & {(1 << (cuts[i + 1] - low)) - 1}L)"
        sums.append(f"sum({part}) AS {name}_{i}")
    return sums


def _whole_sum(bits: int, name: str) -> str:
    """The sum again from its slices."""
    cuts = _slices(bits)
    parts = [f"CAST({name}_{i} AS DECIMAL(20,0))" for i in range(len(cuts))]
    total = parts[-1]
    for i in reversed(range(len(cuts) - 1)):
        base = f"{1 << (cuts[i + 1] - cuts[i])}BD"
        total = f"CAST(CAST({total} AS DECIMAL(30,0)) * {base} + {parts[i]} AS DECIMAL(38,0))"
    return total


_BITS = {T.ByteType: 8, T.ShortType: 16, T.IntegerType: 32, T.LongType: 64}


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _column_sums(field: T.StructField, i: int, digits: int) -> list[str]:
    col, name, kind = _quoted(field.name), f"c{i}", field.dataType
    if isinstance(kind, T.IntegralType):
        return _sliced_sums(f"CAST({col} AS BIGINT)", _BITS[type(kind)], name)
    if isinstance(kind, T.DecimalType):
        return [f"sum({col}) AS {name}_sum"]
    x = f"CAST({col} AS DOUBLE)"
    fits = f"abs({x}) < {_EXACT}D"
    whole = f"CASE WHEN {fits} THEN floor({x}) END"
    fraction = f"CAST(rint(({x} - {whole}) * 1e{digits}D) AS BIGINT)"
    return [
        *_sliced_sums(whole, 54, name),
        f"sum({fraction}) AS {name}_fraction",
        f"sum(CASE WHEN NOT {fits} AND abs({x}) < {_LARGE}D THEN CAST({x} AS DECIMAL(38,0)) END) AS {name}_large",
        f"sum(CASE WHEN NOT {fits} AND NOT abs({x}) < {_LARGE}D THEN {x} END) AS {name}_rough",
    ]


def _column_record(field: T.StructField, i: int, digits: int) -> str:
    """``struct(i, exact, large, rough)``: the sum of column i is their total.

    ``exact`` and ``large`` (doubles from 2**53, which are whole) are decimals
    as text and do not depend on the order of addition. Doubles from 1e26,
    infinities and NaN are added as doubles in ``rough``. Each is NULL when
    there is nothing to add.
    """
    name, kind = f"c{i}", field.dataType
    wide = f"DECIMAL(38,{digits})"
    large, rough = "CAST(NULL AS STRING)", "CAST(NULL AS DOUBLE)"
    if isinstance(kind, T.IntegralType):
        exact = f"CAST(CAST({_whole_sum(_BITS[type(kind)], name)} AS {wide}) AS STRING)"
    elif isinstance(kind, T.DecimalType):
        exact = f"CAST({name}_sum AS STRING)"
        if kind.scale <= digits:
            exact = f"coalesce(CAST(try_cast({name}_sum AS {wide}) AS STRING), {exact})"
    else:
        unit = f"{Decimal(1).scaleb(-digits):f}BD"
        fraction = f"CAST({name}_fraction AS DECIMAL(20,0)) * {unit}"
        whole = f"CAST({_whole_sum(54, name)} AS {wide})"
        exact = f"CAST(CAST({whole} + {fraction} AS {wide}) AS STRING)"
        large, rough = f"CAST({name}_large AS STRING)", f"{name}_rough"
    return f"named_struct('i', {i}, 'exact', {exact}, 'large', {large}, 'rough', {rough})"


def table_profile(df: DataFrame, columns: list[str] | None = None,
                  digits: int = 6) -> DataFrame:
    """Row count and the sum of each numeric column, one row per column.

    One aggregation over the columns that are summed and no others. ``column``
    is NULL in the row that has the number of rows.
    """
    wanted = numeric_columns(df) if columns is None else columns
    fields = [f for f in df.schema.fields if f.name in wanted]
    sums = [s for i, f in enumerate(fields) for s in _column_sums(f, i, digits)]
    rows = (
        f"named_struct('i', -1, 'exact', CAST(CAST(n_rows AS DECIMAL(38,{digits})) AS STRING), "
        "'large', CAST(NULL AS STRING), 'rough', CAST(NULL AS DOUBLE))"
    )
    records = [rows] + [_column_record(f, i, digits) for i, f in enumerate(fields)]
    names = F.array(*[F.lit(f.name) for f in fields])
    sums_row = df.selectExpr("count(*) AS n_rows", *sums)
    return sums_row.selectExpr(f"inline(array({', '.join(records)}))").select(
        F.when(F.col("i") >= 0, F.get(names, F.col("i"))).alias("column"),
        "exact",
        "large",
        "rough",
        F.expr(
            "CASE WHEN coalesce(exact, large, CAST(rough AS STRING)) IS NOT NULL THEN "
            "coalesce(CAST(exact AS DOUBLE), 0D) + coalesce(CAST(large AS DOUBLE), 0D) + coalesce(rough, 0D) END"
        ).alias("total"),
    )


def table_diff(reference: DataFrame, candidate: DataFrame, rel_tol: float = 0.0,
               digits: int = 6) -> DataFrame:
    """Row counts and sums of the common numeric columns, side by side.

    Two NULL sums match and so do two NaN; otherwise sums must be equal, or
    within ``rel_tol`` of each other for floating-point columns. At 0 doubles
    are held against each other at ``digits`` decimals, whatever their size.
    """
    theirs = set(numeric_columns(candidate))
    common = [c for c in numeric_columns(reference) if c in theirs]
    floats = [
        f.name for df in (reference, candidate) for f in df.schema.fields
        if f.name in common and isinstance(f.dataType, T.FractionalType)
        and not isinstance(f.dataType, T.DecimalType)
    ]

    def side(df: DataFrame, prefix: str) -> DataFrame:
        return table_profile(df, common, digits).select(
            F.coalesce("column", F.lit("")).alias("column"),
            *[F.col(c).alias(f"{prefix}_{c}") for c in ("exact", "large", "rough", "total")],
        )

    both = side(reference, "ref").join(side(candidate, "cand"), "column")
    match = F.lit(True)
    for part in ("exact", "large", "rough"):
        match = match & F.col(f"ref_{part}").eqNullSafe(F.col(f"cand_{part}"))
    if rel_tol > 0 and floats:
        near = F.abs(F.col("ref_total") - F.col("cand_total")) <= rel_tol * F.greatest(
            F.abs("ref_total"), F.abs("cand_total")
        )
        match = match | (F.col("column").isin(floats) & F.coalesce(near, F.lit(False)))
    return both.select(
        F.when(F.col("column") != "", F.col("column")).alias("column"),
        F.col("ref_total").alias("ref_sum"), F.col("cand_total").alias("cand_sum"),
        match.alias("match"),
    )


# --- verdicts ---------------------------------------------------------------


def ladder(checks: DataFrame) -> DataFrame:
    """Status of each proposal from the checks of its pairs.

    ``checks`` has proposal, smoke_ok, smoke_only, schema_match, data_match and
    broken (the comparison itself raised), one row per pair; a proposal without
    targets has one row with NULL matches. A proposal with a broken check has
    failed, whatever its other pairs say.
    """
    verdict = (
        F.when(F.col("broken"), "failed")
        .when(~F.col("smoke_ok"), "smoke_failed")
        .when(F.col("smoke_only"), "smoke_passed")
        .when(~F.col("schemas_ok"), "schema_mismatch")
        .when(~F.col("data_ok") | (F.col("n_pairs") == 0), "data_mismatch")
        .otherwise("passed")
    )
    return (
        checks.groupBy("proposal")
        .agg(
            F.bool_or("broken").alias("broken"),
            F.bool_and("smoke_ok").alias("smoke_ok"),
            F.bool_or("smoke_only").alias("smoke_only"),
            F.bool_and(F.coalesce("schema_match", F.col("table").isNull())).alias("schemas_ok"),
            F.bool_and(F.coalesce("data_match", F.lit(False))).alias("data_ok"),
            F.count("table").alias("n_pairs"),
        )
        .select("proposal", "n_pairs", verdict.alias("validation_status"))
    )
