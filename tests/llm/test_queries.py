"""The registered queries that SQL can express, beside that SQL in DuckDB, and the entry point without the package."""

import os
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as entry
from check_queries import TABLES, sorted_rows
from lakestrata.llm.queries import ORACLES, QUERIES

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def database():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SMALL}/{name}.parquet'")
    return connection


@pytest.mark.parametrize("name", ORACLES)
def test_query_against_its_sql(spark, database, name):
    found = QUERIES[name](spark, SMALL)
    cursor = database.execute(ORACLES[name])
    columns = [item[0] for item in cursor.description]
    assert sorted(found.columns) == sorted(columns)
    assert sorted_rows(found.columns, found.collect()) == sorted_rows(columns, cursor.fetchall())


def test_entry_has_them():
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLES) <= set(entry.oracle_sql())


def test_entry_without_the_package():
    hide = "import sys; sys.modules['lakestrata.llm'] = None\n"
    code = hide + "import __spark_entry__ as e; assert len(e.queries()) == len(e.oracle_sql()) > 50; assert 'pipeline' not in e.queries()"
    root = os.path.dirname(os.path.abspath(entry.__file__))
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True, timeout=120)
