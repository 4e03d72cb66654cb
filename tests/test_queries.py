"""Every registered query with SQL, on the smallest tables, against DuckDB."""

from pathlib import Path

import pytest

import __spark_entry__ as entry
from checks.compare import compare, connect

SMALLEST = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SMALLEST).exists(), reason="no table folder")


@pytest.fixture(scope="module")
def duck():
    return connect(SMALLEST)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_matches_sql(spark, duck, name):
    good, note = compare(spark, name, entry.queries()[name], entry.oracle_sql()[name], SMALLEST, duck)
    assert good, note


def test_entry_and_names(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
