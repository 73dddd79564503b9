"""Every registered query over whole tables, next to its SQL in DuckDB."""

import os

import pytest
import sqlcheck

import __spark_entry__ as entry

SF_DIR = os.environ.get("CHECK_SF_DIR", "/root/testdata/sf0.001")

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables here")


@pytest.fixture(scope="module")
def con():
    return sqlcheck.connect(SF_DIR)


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, con, name):
    df = entry.queries()[name](spark, SF_DIR)
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert len(df.columns) == len(set(df.columns))
        df.collect()
    else:
        assert sqlcheck.compare(df, con, sql) == []


def test_entry(spark):
    assert entry.entry(spark).count() > 0
