"""Every registered query against its DuckDB statement."""

import pytest

import __spark_entry__ as entry
from check_oracles import compare, duck

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF_DIR)


@pytest.mark.parametrize("name", sorted(entry.ENTRIES))
def test_query_matches_sql(spark, con, name):
    problem = compare(spark, con, SF_DIR, name)
    assert problem in ("", "agree, but on no rows")


def test_entry_has_rows(spark):
    df = entry.entry(spark)
    assert df.count() > 0
    assert "total" in df.columns


def test_oracles_belong_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())
