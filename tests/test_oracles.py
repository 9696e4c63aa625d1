"""Every registered query against its DuckDB twin on the smallest tables."""

import os

import pytest

import __spark_entry__ as contract
from check import compare, duck

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return duck(SF_DIR)


@pytest.mark.parametrize("name", sorted(contract.queries()))
def test_query(spark, con, name):
    """Rows as the twin's, and no plan that pairs everything with everything, also with nothing to broadcast."""
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = contract.queries()[name](spark, SF_DIR)
        plan = df._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    ok, message = compare(spark, con, SF_DIR, name, df)
    assert ok, message
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_entry_has_rows(spark):
    assert contract.entry(spark).count() > 0


def test_oracles_belong_to_queries():
    assert set(contract.oracle_sql()) <= set(contract.queries())
