"""Every registered query against its SQL on the smallest driver tables."""

import os

import pytest

import workload
from workload import compare

SF = os.environ.get("ADWATCH_TEST_SF", "/root/testdata/sf0.001")
workload.load_all()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")


@pytest.fixture(scope="module")
def con():
    return compare.connect(SF)


@pytest.mark.parametrize("name", sorted(workload.SQL))
def test_query_equals_sql(spark, con, name):
    assert compare.difference(workload.QUERIES[name](spark, SF), con, workload.SQL[name]) is None


@pytest.mark.parametrize("name", sorted(set(workload.QUERIES) - set(workload.SQL)))
def test_query_runs(spark, name):
    assert workload.QUERIES[name](spark, SF).count() > 0


def test_driver_contract(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
