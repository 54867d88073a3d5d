"""Every registered query against its SQL twin, or at least to a non-empty answer."""

from __future__ import annotations

import os

import pytest

import __spark_entry__ as driver
from compare import connection, differences
from flowsieve.operators import duplicates
from flowsieve.queries.standin import KEY, flows, plain_flows

SF = os.environ.get("FLOWSIEVE_SF", "/root/testdata/sf0.001")
ORACLES, QUERIES = driver.oracle_sql(), driver.queries()


@pytest.fixture(scope="module")
def con():
    return connection(SF)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, con, name):
    assert differences(QUERIES[name](spark, SF), ORACLES[name], con) == []


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_gives_rows(spark, name):
    result = QUERIES[name](spark, SF)
    assert result.columns and result.count() > 0


def test_entry(spark):
    rows = driver.entry(spark).collect()
    assert [r["n"] for r in rows] == sorted((r["n"] for r in rows), reverse=True)
    assert abs(sum(r["share"] for r in rows) - 100) < 1e-4


def test_records_are_derived_for_the_columns_used(spark):
    """No table of 68 columns is written first: a query of two columns reads what these need."""
    plan = flows(spark, SF).select(KEY)._jdf.queryExecution().executedPlan().toString()
    assert "lineitem.parquet" in plan and "l_tax" not in plan and "l_returnflag" not in plan


def test_copied_records_are_compared_by_value(spark):
    """The optimizer must not decide from the formulas that copies are equal."""
    pair = duplicates.duplicate_verification(plain_flows(spark, SF), [("Subflow Fwd Pkts", "Tot Fwd Pkts")])
    assert "l_partkey" in pair._jdf.queryExecution().optimizedPlan().toString()
