"""Every registered query against its SQL on the smallest tables, and without Python in its plan."""

import os
import re

import pytest

from checks import load
from checks.run import compare, connect

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = load()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the given tables")


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


def test_entry(spark):
    import __spark_entry__ as e
    assert e.entry(spark).count() > 0
    assert set(e.queries()) >= set(QUERIES)
    assert set(e.oracle_sql()) >= set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|CartesianProduct|BroadcastNestedLoopJoin", plan)
    said, _ = compare(df, con, ORACLES[name])
    assert said == ""
