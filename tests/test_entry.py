import duckdb
import pytest

import __spark_entry__ as entry
from check_queries import TABLES, sorted_rows
from lakestrata.session import clear_scratch
from registry.queries import ORACLES, QUERIES

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def database():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SMALL}/{name}.parquet'")
    return connection


def test_every_query_has_its_sql():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


def test_flagship_entry(spark):
    result = entry.entry(spark)
    assert result.columns == ["product_id", "order_date", "total_quantity", "total_aggregated_value_usd"]
    assert result.count() > 0


@pytest.mark.parametrize("name", QUERIES)
def test_query_against_its_sql(spark, database, name):
    found = entry.queries()[name](spark, SMALL)
    cursor = database.execute(entry.oracle_sql()[name])
    columns = [item[0] for item in cursor.description]
    assert sorted(found.columns) == sorted(columns)
    assert sorted_rows(found.columns, found.collect()) == sorted_rows(columns, cursor.fetchall())
    clear_scratch()
