"""Every registered query gives the rows of its SQL twin on the smallest test data."""

import os

import pytest

import __spark_entry__ as entry
from shelfmark.plans.queries import QUERIES
from tests.compare import connect, differences

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


def test_every_query_has_a_twin():
    assert set(QUERIES) <= set(entry.oracle_sql())
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, con, name):
    problem = differences(entry.queries()[name](spark, SF_DIR), con.sql(entry.oracle_sql()[name]))
    assert problem is None, problem


def test_entry(spark):
    assert "reclaimable_bytes" in entry.entry(spark).columns
