"""Every registered query on the small tables, against its SQL where it has one."""

import os

import pytest

import __spark_entry__ as entry
import oracle

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables not present")


@pytest.fixture(scope="module")
def con():
    return oracle.connect(FOLDER)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_equals_sql(spark, con, name):
    mine, theirs, same_names, diff = oracle.compare(entry.queries()[name](spark, FOLDER), con, entry.oracle_sql()[name])
    assert same_names and diff is None and mine == theirs > 0


def test_every_query_has_sql():
    from clausework.plans.catalog import ORACLES, QUERIES

    assert QUERIES.keys() == ORACLES.keys()


def test_entry(spark):
    assert entry.entry(spark).count() == 5
