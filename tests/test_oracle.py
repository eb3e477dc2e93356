"""Every registered query with SQL agrees with DuckDB on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry
from tests import oracle

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="given tables are absent")


@pytest.fixture(scope="module")
def db():
    return oracle.connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query(spark, db, name):
    result = entry.queries()[name](spark, SF_DIR).toArrow()
    expected = db.sql(entry.oracle_sql()[name]).to_arrow_table()
    assert oracle.difference(result, expected) is None


def test_entry(spark):
    result = entry.entry(spark)
    assert result.columns[:2] == ["code_text", "term_text"]
    assert result.count() > 0
