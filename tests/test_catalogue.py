import pytest
from compare import data, differences, duck

import __spark_entry__
from tallyweave.plans import catalogue


@pytest.fixture(scope="module")
def con():
    return duck(data())


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query_equals_sql(spark, con, name):
    assert differences(catalogue.QUERIES[name](spark, data()), con, catalogue.SQL[name]) == ""


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
