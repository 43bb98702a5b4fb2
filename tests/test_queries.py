"""Every query with SQL against DuckDB on the smallest tables; those without run."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from folioflow.plans import registry
from verify import TABLES, compare

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, con, name):
    said = compare(spark, con, name, registry.QUERIES[name], registry.ORACLE.get(name), SF)
    assert said.startswith(("same", "rows")), said


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
