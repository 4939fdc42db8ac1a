"""Every registered query against its SQL, and those without SQL for rows."""

import pytest

from cairn.plans import registry
from tests.oracle import compare

SF = "/root/testdata/sf0.001"
QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql(spark, name):
    compare(spark, QUERIES[name], SQL[name], SF)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_rows(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["unique_objects", "hits", "logical_bytes", "stored_bytes", "ratio"]
    assert set(SQL) <= set(e.oracle_sql()) and set(QUERIES) <= set(e.queries())
