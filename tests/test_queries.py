"""Every registered query against its SQL, on the smallest tables."""

import pytest
from check_queries import compare, connect

from __spark_entry__ import entry, oracle_sql, queries
from catalog.oracles import ORACLES
from catalog.queries import QUERIES

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", QUERIES)
def test_query_agrees_with_sql(spark, db, name):
    _, problems = compare(spark, db, SF_DIR, name)
    assert problems == []


def test_sql_belongs_to_queries():
    assert set(oracle_sql()) <= set(queries())
    assert set(QUERIES) <= set(queries())
    assert set(QUERIES) - set(ORACLES) == {"folder_listing", "folder_status"}


def test_entry_has_findings(spark):
    assert entry(spark).count() > 0
