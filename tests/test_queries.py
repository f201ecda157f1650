"""Every registered query with SQL gives the same rows on the smallest tables; the others run."""

import pytest

import __spark_entry__ as entry
from tests.compare import differences

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, name):
    query, sql = entry.queries()[name], entry.oracle_sql().get(name)
    if sql:
        assert differences(spark, query, sql, FOLDER) == []
    else:
        assert query(spark, FOLDER).count() >= 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
