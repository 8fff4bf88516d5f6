import pytest
from strataline import plans

from tests.oracle import rows, sql_rows

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query_agrees_with_sql(spark, name):
    found = rows(plans.QUERIES[name](spark, SF).toPandas())
    if name in plans.SQL:
        assert found == sql_rows(SF, plans.SQL[name])
    else:
        assert found[0]


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["item_a", "item_b", "shared", "revs_a", "revs_b"]
    assert set(e.oracle_sql()) <= set(e.queries())
