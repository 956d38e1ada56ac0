"""The registered queries against their SQL twins."""

from __future__ import annotations

import pytest
from compare import compare, connect

import __spark_entry__ as contract
from fairlead.plans import catalog, oracle

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def connection():
    return connect(FOLDER)


def test_names_agree():
    assert set(catalog.QUERIES) == set(oracle.statements())
    assert set(catalog.QUERIES) <= set(contract.queries())
    assert set(contract.oracle_sql()) <= set(contract.queries())


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_query_equals_sql(spark, connection, name):
    rows, difference = compare(spark, connection, catalog.QUERIES[name], oracle.statements()[name], FOLDER)
    assert not difference
    assert rows or name == "conflicting_positions"


def test_entry(spark):
    assert [row.collision_count for row in contract.entry(spark).collect()] == [2, 2]
