"""Every registered query against its oracle SQL (rows only where there is none)."""

import pytest

import __spark_entry__ as entry
import check

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, oracle, sf):
    ok, note = check.compare(spark, oracle, name, QUERIES[name], ORACLES.get(name), sf)
    assert ok, note


def test_entry(spark):
    df = entry.entry(spark)
    assert set(df.columns) == {"role", "verdict", "n", "avg_confidence"}
    assert df.count() > 0


def test_oracles_name_known_queries():
    assert set(ORACLES) <= set(QUERIES)
