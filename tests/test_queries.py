"""Every registered query against its SQL on the given tables."""

import pytest

import __spark_entry__ as entry
from checks import registry
from checks.compare import difference

QUERIES = registry.QUERIES
ORACLES = {name: registry.oracle_sql(name) for name in registry.ORACLES}


def test_entry_gives_rows(spark):
    df = entry.entry(spark)
    assert {"job_id", "task_key", "score", "rank"} <= set(df.columns)
    assert df.count() > 0


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, sf, name):
    assert difference(spark, sf, QUERIES[name], ORACLES[name]) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_without_sql_gives_rows(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0
