"""Every registered query against its SQL on the smallest tables."""

import pytest

import __spark_entry__ as entry_points
from catalog.oracles import ORACLES
from catalog.queries import QUERIES
from compare import connect, differences

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(entry_points.queries())


def test_entry(spark):
    assert entry_points.entry(spark).count() == 8


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    found = QUERIES[name](spark, SF)
    assert differences(found, con, ORACLES[name]) == []
