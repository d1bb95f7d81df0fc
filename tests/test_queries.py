"""Every registered query against its SQL, on the smallest tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry_module

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = [name[:-8] for name in sorted(os.listdir(SF_DIR)) if name.endswith(".parquet")]
QUERIES = entry_module.queries()
SQL = entry_module.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in TABLES:
        connection.sql(f"CREATE VIEW {name} AS SELECT * FROM '{SF_DIR}/{name}.parquet'")
    yield connection
    connection.close()


def canonical(frame):
    def cell(value):
        if value is None or (isinstance(value, float) and math.isnan(value)) or str(value) in ("NaT", "<NA>"):
            return None
        if hasattr(value, "item"):
            value = value.item()
        if isinstance(value, (int, float)) and not isinstance(value, bool):
            return float(f"{value:.10g}")
        return value

    frame = frame[sorted(frame.columns)]
    return sorted((tuple(map(cell, row)) for row in frame.itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, duck, name):
    result = QUERIES[name](spark, SF_DIR).toPandas()
    if name not in SQL:
        assert len(result) > 0
        return
    expected = duck.sql(SQL[name]).df()
    assert sorted(result.columns) == sorted(expected.columns)
    assert canonical(result) == canonical(expected)


def test_entry_runs(spark):
    assert entry_module.entry(spark).count() > 0
