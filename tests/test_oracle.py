"""Every registered query next to its SQL on the small test tables."""

import pytest
from compare import connect, differences
from support import TESTDATA

import __spark_entry__ as entry
from tenderloom.plans.oracle import oracle_queries
from tenderloom.plans.registry import QUERIES


@pytest.fixture(scope="module")
def database():
    return connect(TESTDATA)


def test_every_query_has_sql():
    """Of the library's own queries; some corpus operators have no SQL form."""
    assert set(QUERIES) == set(oracle_queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_sql(spark, database, name):
    assert differences(spark, name, TESTDATA, database) == ""


def test_entry_has_rows(spark):
    assert entry.entry(spark).limit(1).count() == 1
