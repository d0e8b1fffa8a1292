"""Queries beside their SQL in DuckDB, on the smallest tables."""

from __future__ import annotations

import pytest
from compare import differences

from panelith import exchange_queries, market_queries, panel_queries  # noqa: F401
from panelith import queries as core


@pytest.mark.parametrize("name", sorted(core.SQL))
def test_rows_equal_the_oracles(spark, small, name):
    assert differences(spark, small, name) == ""


@pytest.mark.parametrize("name", sorted(set(core.QUERIES) - set(core.SQL)))
def test_queries_without_sql_run(spark, small, name):
    assert core.QUERIES[name](spark, small).count() > 0
