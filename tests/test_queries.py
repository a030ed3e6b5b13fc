"""Every query with a SQL form gives what DuckDB gives; the others run and keep their columns."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry_points
from tests.oracle import differences
from tidemark.plans import registry

SQL = registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, sf_dir, name):
    assert not differences(registry.queries()[name], SQL[name], spark, sf_dir)


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(SQL)))
def test_runs(spark, sf_dir, name):
    df = registry.queries()[name](spark, sf_dir)
    assert df.columns and df.count() >= 0


def test_entry_points(spark):
    known = entry_points.queries()
    assert set(registry.queries()) <= set(known)
    assert set(entry_points.oracle_sql()) <= set(known)
    assert entry_points.entry(spark).limit(1).count() == 1
