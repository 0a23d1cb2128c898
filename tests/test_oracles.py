"""Every registered query with SQL gives the same rows as the SQL does."""

import compare
import pytest

import __spark_entry__ as entry
from loopsight.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture
def con():
    """One connection a test, so that one failure stays one."""
    with compare.connect(SF) as con:
        yield con


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_sql(spark, con, name):
    assert not compare.differences(registry.QUERIES[name](spark, SF), con, registry.ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_query_without_sql_runs(spark, name):
    assert registry.QUERIES[name](spark, SF).count() > 0


def test_flagship(spark):
    assert entry.entry(spark).count() > 0
