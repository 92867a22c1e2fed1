"""Every query of the training-data operators runs, and agrees with its SQL where it has any."""

from __future__ import annotations

import pytest

from graphloom.llm.queries import REGISTRY
from tests.compare import check, connect
from tests.conftest import SF


@pytest.fixture(scope="module")
def db():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(REGISTRY.sql))
def test_query_agrees_with_sql(spark, db, name):
    check(spark, db, SF, REGISTRY.queries[name], REGISTRY.sql[name])


@pytest.mark.parametrize("name", sorted(set(REGISTRY.queries) - set(REGISTRY.sql)))
def test_query_runs(spark, name):
    assert REGISTRY.queries[name](spark, SF).count() > 0
