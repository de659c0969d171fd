"""Every registered query against its SQL, and the shape of its plan."""

from __future__ import annotations

import pytest
from conftest import FOLDER

import __spark_entry__ as entry
from remitra.checks.compare import compare, connect

EMPTY_AT_THIS_SIZE = {"O6_having", "X1_fx_by_year_bank", "X8_dup_tier_c", "X11_dup_rows_c"}
# The text operators have tests of their own.
QUERIES = {name: query for name, query in entry.queries().items() if name not in entry.TEXT_QUERIES}
ORACLES = {name: sql for name, sql in entry.oracle_sql().items() if name not in entry.TEXT_ORACLES}


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", QUERIES)
def test_matches_sql(spark, con, name):
    df = QUERIES[name](spark, FOLDER)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan
    outcome = compare(df, con, ORACLES.get(name))
    assert not outcome.problems
    assert outcome.rows > 0 or name in EMPTY_AT_THIS_SIZE


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["month_ix", "flow_ix", "pur2_ix", "use_ix", "bank_ix", "n", "usd_m"]
    assert df.count() > 0


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)
