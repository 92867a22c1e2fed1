"""Every query of the core runs, and agrees with its SQL."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry_points
from graphloom.plans import data_queries, file_queries, graph_queries
from tests.compare import check, connect
from tests.conftest import SF

ALL = graph_queries.REGISTRY.queries | data_queries.REGISTRY.queries | file_queries.REGISTRY.queries
SQL = graph_queries.REGISTRY.sql | data_queries.REGISTRY.sql | file_queries.REGISTRY.sql


@pytest.fixture(scope="module")
def db():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_agrees_with_sql(spark, db, name):
    check(spark, db, SF, ALL[name], SQL[name])


@pytest.mark.parametrize("name", sorted(set(ALL) - set(SQL)))
def test_query_runs(spark, name):
    assert ALL[name](spark, SF).count() > 0


def test_entry_points(spark):
    assert set(entry_points.oracle_sql()) <= set(entry_points.queries())
    assert set(ALL) <= set(entry_points.queries())
    assert entry_points.entry(spark).count() > 0
