"""Every registered query against its SQL on another engine."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
from tests.compare import connect, difference

ORACLES = entry.oracle_sql()


@pytest.fixture(scope="module")
def con(folder):
    return connect(folder)


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(name, spark, folder, con):
    got = entry.queries()[name](spark, folder).toPandas()
    assert difference(got, con.execute(ORACLES[name]).df()) is None


def test_entry(spark):
    rows = {r["severity"]: r["n"] for r in entry.entry(spark).collect()}
    assert set(rows) == {"low", "medium", "high", "critical"} and sum(rows.values()) > 0
