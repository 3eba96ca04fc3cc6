import math
from decimal import Decimal

import pytest

from pipewise.operators.equivalence import Pair, schema_diff, table_diff, table_profile
from pipewise.plans.validation import schema_report, smoke, validate_tables


def profile(df, **kw):
    return {r["column"]: r for r in table_profile(df, **kw).collect()}


def test_sums_do_not_depend_on_partitions(spark, sf):
    df = spark.read.parquet(f"{sf}/lineitem.parquet")
    seen = {
        tuple(sorted((c or "", r.exact) for c, r in profile(df.repartition(n)).items()))
        for n in (1, 3, 8)
    }
    assert len(seen) == 1
    assert all(r.match for r in table_diff(df, df.repartition(5)).collect())


def test_sums_are_exact(spark):
    big = 2**62
    rows = [
        (127, -32768, 2**31 - 1, big, 0.1, Decimal("1.25")), (-128, 32767, -(2**31), big, 0.2, Decimal("-3.50")),
        (1, 1, -1, big, -5e12, None), (None, None, None, -5, 5e15 + 1, Decimal("0.01")),
        (3, 3, 3, big, -0.0000004, Decimal("2.00")), (0, 0, 0, -big, -1.5, Decimal("2.00")),
    ]
    df = spark.createDataFrame(
        rows, "b byte, s short, i int, l bigint, d double, n decimal(10,2)"
    ).repartition(3)
    got = profile(df)
    for k, c in enumerate("bsil"):
        assert Decimal(got[c].exact) == sum(r[k] for r in rows if r[k] is not None), c
    assert Decimal(got["d"].exact) == Decimal(5e15 + 1) - Decimal(5e12) + Decimal("-1.2")
    assert Decimal(got["n"].exact) == Decimal("1.76")
    assert Decimal(got[None].exact) == 6


@pytest.mark.parametrize("odd", [math.nan, math.inf, -math.inf, 1e300, None])
def test_odd_doubles_match_themselves(spark, odd):
    a = spark.createDataFrame([(1.0,), (odd,)], "x double")
    b = spark.createDataFrame([(odd,), (1.0,)], "x double")
    plain = spark.createDataFrame([(1.0,), (2.0,)], "x double")
    assert all(r.match for r in table_diff(a, b).collect())
    assert not all(r.match for r in table_diff(a, plain).collect())


def test_opposite_infinities_are_nan(spark):
    df = spark.createDataFrame([(math.inf,), (-math.inf,)], "x double")
    assert math.isnan(profile(df)["x"].total)


def test_empty_and_all_null_match(spark):
    nulls = spark.createDataFrame([(None, None)], "x double, y int")
    empty = spark.createDataFrame([], "x double, y int")
    got = {r["column"]: r.match for r in table_diff(nulls, empty).collect()}
    assert got == {None: False, "x": True, "y": True}


def test_tolerance_is_for_doubles_only(spark):
    a = spark.createDataFrame([(1000000.0, 1000000)], "x double, y int")
    b = spark.createDataFrame([(1000000.5, 1000001)], "x double, y int")
    def match(tol):
        return {r["column"]: r.match for r in table_diff(a, b, rel_tol=tol).collect()}
    assert match(0.0) == {None: True, "x": False, "y": False}
    assert match(1e-5) == {None: True, "x": True, "y": False}


def test_only_summed_columns_are_read(spark, sf):
    df = spark.read.parquet(f"{sf}/lineitem.parquet")
    plan = table_profile(df, ["l_quantity"])._jdf.queryExecution().toString()
    assert "ReadSchema: struct<l_quantity:double>" in plan


def test_odd_column_names(spark):
    df = spark.createDataFrame([(1, 2.5)], "`a b` int, `c``d'e` double")
    assert Decimal(profile(df)["a b"].exact) == 1
    assert Decimal(profile(df)["c`d'e"].exact) == Decimal("2.5")


def test_schema_ignores_order_and_nullability(spark):
    a = spark.createDataFrame([], "x int, y string, z array<int>")
    b = spark.createDataFrame([], "z array<int>, y string not null, x int")
    c = spark.createDataFrame([], "X int, y binary, z array<bigint>")
    pairs = [Pair("b", "t", a, b), Pair("c", "t", a, c)]
    got = {r.proposal: r for r in schema_report(spark, pairs).collect()}
    assert got["b"].schema_match and not got["c"].schema_match
    assert (got["c"].missing_columns, got["c"].added_columns, got["c"].changed_columns) == (
        ["x"], ["X"], ["y", "z"],
    )
    assert schema_diff(spark, pairs).count() == 3 + 4


def test_ladder(spark):
    one = spark.createDataFrame([(1,)], "x int")
    two = spark.createDataFrame([(2,)], "x int")
    other = spark.createDataFrame([("1",)], "x string")
    pairs = [
        Pair("good", "a", one, one), Pair("good", "b", two, two),
        Pair("half", "a", one, one), Pair("half", "b", one, two),
        Pair("shape", "a", one, two), Pair("shape", "b", one, other),
        Pair("crashed", "a", one, other), Pair("smoke", "a", one, other),
    ]
    got = validate_tables(
        spark, pairs, smoke_failed={"crashed"}, smoke_only={"smoke", "crashed"}, proposals=["none"]
    )
    assert {r.proposal: r.validation_status for r in got.collect()} == {
        "good": "passed", "half": "data_mismatch", "shape": "schema_mismatch",
        "crashed": "smoke_failed", "smoke": "smoke_passed", "none": "data_mismatch",
    }


def test_smoke_and_isolated_checks(spark):
    good = spark.createDataFrame([(1, Decimal("9" * 38))], "x int, y decimal(38,0)")
    twice = good.unionAll(good)
    broken = good.selectExpr("CAST(raise_error('no') AS INT) AS x", "y")
    pairs = [Pair("ok", "a", good, good), Pair("crash", "a", good, broken),
             Pair("overflow", "a", twice, twice)]
    written, failed = smoke(pairs)
    assert failed == {"crash"}
    got = validate_tables(spark, written, smoke_failed=failed)
    assert {r.proposal: r.validation_status for r in got.collect()} == {
        "ok": "passed", "crash": "smoke_failed", "overflow": "failed",
    }
