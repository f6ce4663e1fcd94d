"""Every named query on the smallest tables; against SQL where there is a counterpart."""

import pytest
from conftest import SMALL
from oracle_check import compare, connect

from tidecast.plans.catalog import QUERIES
from tidecast.plans.oracle import ORACLE

# Joins of everything with everything, Python per row, and whole groups in one Python call.
BANNED = ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython", "FlatMapGroupsInPandas")


@pytest.fixture(scope="module")
def con():
    return connect(SMALL)


def run(spark, name):
    df = QUERIES[name](spark, SMALL)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not [node for node in BANNED if node in plan]
    return df.toPandas()


def test_every_statement_belongs_to_a_query():
    assert set(ORACLE) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_against_sql(spark, con, name):
    assert compare(run(spark, name), con.execute(ORACLE[name]).df()) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_runs(spark, name):
    rows = run(spark, name)
    assert len(rows) > 0 and rows.columns.is_unique
