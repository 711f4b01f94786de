"""Every registered query against its SQL twin."""

from __future__ import annotations

import pytest
from oracle import compare, connect

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
ORACLE = entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_sql(spark, con, name):
    df = entry.queries()[name](spark, SF)
    assert compare(df, con, ORACLE[name]) is None


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0
