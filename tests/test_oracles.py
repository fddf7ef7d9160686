"""Every query with SQL gives what DuckDB gives; the others run."""

import pytest

from accordant import entry

from .oracle import assert_same


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, sf, name):
    df = entry.queries()[name](spark, sf)
    if name in entry.oracle_sql():
        assert_same(df, entry.oracle_sql()[name], sf)
    else:  # draws and held-out models; tests/test_nulls.py and tests/test_operators.py hold their numbers
        rows = df.toPandas()
        assert len(rows) and not rows.isna().all().any()


def test_entry_point(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
