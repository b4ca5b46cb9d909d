"""Every query with SQL gives the same rows as the SQL."""

from __future__ import annotations

import pytest
from helpers import DATA, assert_same

from pulsegrid.plans import registry


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_equals_sql(spark, name):
    assert_same(registry.QUERIES[name](spark, DATA), registry.SQL[name])


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.SQL)))
def test_query_without_sql_has_rows(spark, name):
    assert registry.QUERIES[name](spark, DATA).count() > 0
