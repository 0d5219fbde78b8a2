import pytest

from __spark_entry__ import entry, oracle_sql, queries
from check import compare, duck

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def connection():
    return duck(FOLDER)


@pytest.mark.parametrize("name", sorted(queries()))
def test_query_matches_its_sql(spark, connection, name):
    assert compare(spark, connection, FOLDER, name) == ""


def test_entry_has_rows(spark):
    assert entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert set(oracle_sql()) <= set(queries())
