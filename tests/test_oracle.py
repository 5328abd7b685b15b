"""Every query with oracle SQL must equal DuckDB's result exactly."""

import pytest

import __spark_entry__ as entry
from tests.compare import connect, diff
from tests.conftest import SF

SQL = entry.oracle_sql()
QUERIES = entry.queries()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_every_oracle_has_a_query():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_oracle(spark, con, name):
    assert diff(QUERIES[name](spark, SF), con, SQL[name]) is None


def test_flagship(spark):
    row = entry.entry(spark).first()
    assert (row["n_niche_creators"], row["creators_with_positive_gap"]) == (294, 183)
    assert row["total_gap_usd"] == pytest.approx(16852334, abs=2)
    assert row["gap_as_pct_of_platform_revenue"] == 5.6
