"""Every query that SQL can express gives the SQL's rows."""

import pytest
from compare import DATA, differences

from palimpsest.plans import catalog


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_gives_the_rows_of_its_sql(spark, name):
    sf_dir = f"{DATA}/sf0.001"
    assert differences(catalog.QUERIES[name](spark, sf_dir), catalog.ORACLES[name], sf_dir) == ""


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_query_without_sql_gives_rows(spark, name):
    df = catalog.QUERIES[name](spark, f"{DATA}/sf0.001")
    assert df.count() > 0 and df.columns
