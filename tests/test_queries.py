"""Every registered query with a SQL text must give exactly the same rows."""

import pytest

from compare import compare, connect
from conftest import SMALL

from __spark_entry__ import entry, oracle_sql, queries

RUN, TEXT = queries(), oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SMALL)


@pytest.mark.parametrize("name", sorted(TEXT))
def test_query_equals_sql(spark, con, name):
    diff, rows = compare(spark, con, RUN[name], TEXT[name], SMALL)
    assert diff is None
    assert rows > 0


def test_every_text_has_a_query():
    assert set(TEXT) <= set(RUN)


def test_entry(spark):
    assert entry(spark).count() == 1
