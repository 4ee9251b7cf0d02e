"""Every registered query against its SQL on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry
from tests.oracle import compare, connect
from tidemark.plans import load_queries

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables are absent")


@pytest.fixture(scope="module")
def duck():
    return connect(SF_DIR)


def test_entry_has_rows_and_schema(spark):
    df = entry.entry(spark)
    assert df.columns == ["config", "horizon", "ic", "n"]
    assert df.count() > 0


def test_every_query_has_sql():
    book = load_queries()
    assert set(book.queries) == set(book.sql)


@pytest.mark.parametrize("name", sorted(load_queries().queries))
def test_query_matches_sql(spark, duck, name):
    df = entry.queries()[name](spark, SF_DIR)
    rows = [tuple(r) for r in df.collect()]
    result = duck.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in result.description]
    assert compare(rows, df.columns, result.fetchall(), columns) is None
