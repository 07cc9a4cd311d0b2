"""Every registered query with an SQL text equals it on the smallest tables."""

import oracle
import pytest

import __spark_entry__ as entry_module
from millrace.catalog import QUERIES


@pytest.fixture(scope="module")
def con(sf_dir):
    return oracle.connect(sf_dir)


@pytest.mark.parametrize("name", [n for n, q in QUERIES.items() if q.sql])
def test_query_equals_sql(spark, sf_dir, con, name):
    q = QUERIES[name]
    assert oracle.compare(q.run(spark, sf_dir), con, q.sql) is None


def test_entry_points(spark):
    assert entry_module.entry(spark).limit(1).count() == 1
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())
