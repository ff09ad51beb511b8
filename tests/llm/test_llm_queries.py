"""Every query of the subpackage with SQL gives the SQL's rows on the smallest tables; the others give rows."""

import pytest
from oracle import SF, differences

from lumentab.llm.queries import llm


@pytest.mark.parametrize("name", sorted(llm.queries))
def test_query(spark, name):
    df = llm.queries[name](spark, SF)
    if name in llm.sql:
        assert differences(name, df, llm.sql[name]) is None
    assert df.count() > 0
