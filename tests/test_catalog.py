"""Every registered query against its SQL at the smallest scale."""

import os

import pytest
from oracle_check import compare, open_tables

import __spark_entry__ as spark_entry

FOLDER = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables not present")


@pytest.fixture(scope="module")
def connection():
    return open_tables(FOLDER)


@pytest.mark.parametrize("name", sorted(spark_entry.queries()))
def test_query_matches_sql(spark, connection, name):
    ok, note = compare(spark, connection, FOLDER, name)
    assert ok, note


def test_entry(spark):
    assert spark_entry.entry(spark).count() > 0
