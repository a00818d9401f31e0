"""Every registered query against its SQL on the smallest tables."""

import pytest

import __spark_entry__ as entry
from tools.check_sql import compare, connect


@pytest.fixture(scope="session")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, con, sf, name):
    verdict = compare(spark, con, sf, name)
    assert verdict.startswith(("ok", "rows only")) or verdict == "EMPTY" and name in MAY_BE_EMPTY, verdict


# Nothing qualifies at this size; the larger sizes have rows.
MAY_BE_EMPTY = {"priority_users", "resampled_kcore", "semi_join_users"}


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert {r["split"] for r in rows} == {"valid", "test"}


def test_sql_has_no_stray_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())
