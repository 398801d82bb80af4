"""Every core query against its oracle SQL, or at least to a result."""

import oracle
import pytest

from tesselle.plans import registry

SQL = registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(name, spark, sf, con):
    df = registry.queries()[name](spark, sf)
    assert oracle.compare(df, con, SQL[name]) is None if name in SQL else df.count() >= 0


def test_entry(spark, sf):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
