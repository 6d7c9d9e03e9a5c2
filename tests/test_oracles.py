"""Every core query that SQL can express, against DuckDB on whole tables; the others must run."""

import pytest

from chunkwright.plans.core_queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(name, agree):
    agree(QUERIES[name], ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(name, spark, folder):
    assert QUERIES[name](spark, folder).count() >= 0


def test_entry_has_all(spark):
    import __spark_entry__ as e

    assert set(QUERIES) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0
