"""Every registered query against its SQL on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry
from check_queries import compare, connect

#: Queries that pair their rows with one total, one price row or one threshold.
ONE_ROW_SIDES = {"cost_scenarios", "cost_active", "profile_counts", "profile_document", "prompt_guidelines"}
SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
QUERIES = {name: fn for name, fn in entry.queries().items() if name not in entry.LLM_QUERIES}
ORACLES = {name: sql for name, sql in entry.oracle_sql().items() if name in QUERIES}


@pytest.fixture(scope="module")
def duck():
    return connect(SF_DIR)


def test_every_query_has_sql():
    assert set(ORACLES) == set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, duck, name):
    made = []
    problem, _ = compare(spark, duck, lambda s, d: made.append(QUERIES[name](s, d)) or made[0], ORACLES[name], SF_DIR)
    assert problem is None, problem
    plan = made[0]._jdf.queryExecution().optimizedPlan().toString()
    assert "CartesianProduct" not in made[0]._jdf.queryExecution().executedPlan().toString()
    # A join without a condition pairs one row only: an aggregate without keys, or a literal table.
    for line in plan.splitlines():
        assert "Join Cross" not in line or name in ONE_ROW_SIDES, line


def test_entry_returns_rows(spark):
    assert entry.entry(spark).count() > 0
