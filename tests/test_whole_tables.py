"""Queries over whole tables against their SQL."""

import pytest
from test_registry import duck, table  # noqa: F401

import __spark_entry__ as entry_points


@pytest.mark.parametrize("name", ["legacy_union_all", "dashboard_full", "dashboard_summary"])
def test_query(spark, duck, data, name):  # noqa: F811
    got = entry_points.queries()[name](spark, data).toPandas()
    want = duck.execute(entry_points.oracle_sql()[name]).df()
    assert table(got) == table(want)
