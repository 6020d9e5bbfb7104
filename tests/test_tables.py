import pytest

from quarry.plans import catalog
from tests.compare import assert_same

SQL = catalog.oracle_sql()


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query_equals_sql(spark, name):
    assert_same(spark, catalog.queries()[name], SQL[name], "/root/testdata/sf0.001")


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
