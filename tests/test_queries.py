"""Every registered query against its SQL on whole tables."""

import pytest
from compare import connect, difference

import __spark_entry__ as contract
from larder import catalogue

QUERIES, ORACLES = contract.queries(), contract.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf_dir):
    return connect(sf_dir)


def test_every_query_has_sql():
    assert set(catalogue.load()) <= set(QUERIES) & set(ORACLES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(name, spark, duck, sf_dir):
    assert difference(QUERIES[name](spark, sf_dir), duck, ORACLES[name]) is None


def test_entry(spark):
    assert contract.entry(spark).count() > 0
