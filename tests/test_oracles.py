"""Every accounting query against its oracle on the smallest tables; those without one must run."""

import pytest
from oracles import same_rows

from tallyforge import catalog


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_query(spark, sf, name):
    df = catalog.QUERIES[name](spark, sf)
    if name in catalog.ORACLES:
        same_rows(df, catalog.ORACLES[name], sf)
    else:
        assert df.count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
