"""Every registered query against its SQL at the smallest scale."""

import pytest

import __spark_entry__ as entry
from spanmill.catalog.oracles import ORACLES
from spanmill.catalog.queries import QUERIES
from oracle_check import connect, difference

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() == 4


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_equals_sql(spark, duck, name):
    got = QUERIES[name](spark, SF).toPandas()
    assert difference(got, duck.sql(ORACLES[name]).df()) is None
