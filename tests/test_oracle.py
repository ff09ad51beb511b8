"""Every core query with SQL gives the SQL's rows on the smallest tables; the others give rows."""

import pytest
from oracle import SF, differences

import __spark_entry__ as entry
from lumentab.plans import all_queries

CATALOG = all_queries()


@pytest.mark.parametrize("name", sorted(CATALOG.queries))
def test_query(spark, name):
    df = CATALOG.queries[name](spark, SF)
    if name in CATALOG.sql:
        assert differences(name, df, CATALOG.sql[name]) is None
    else:
        assert df.count() >= 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
