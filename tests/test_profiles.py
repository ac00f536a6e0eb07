from datetime import date

import pytest
from pyspark.sql import functions as F

from lakestrata.operators.profiles import DISTINCT_ERROR, RANK_ERROR, profile, report, save_profiles, united

DAYS = [date(2025, 5, d) for d in (1, 2, 3, 4)]


@pytest.fixture
def table(spark):
    """Four days of 5,000 rows; the last has no values at all."""
    df = spark.range(20_000).withColumn("day", F.element_at(F.array(*map(F.lit, DAYS)), (F.col("id") % 4 + 1).cast("int")))
    some = F.col("day") != F.lit(DAYS[3])
    return df.select(
        "day",
        F.when(some & (F.col("id") % 10 > 0), F.col("id") % 3000).alias("n"),
        F.when(some, (F.col("id") / 7).cast("decimal(12,2)")).alias("price"),
        F.when(some, F.concat(F.lit("user"), F.col("id") % 700)).alias("my name"),
        F.when(some, F.col("day")).alias("on"),
    )


def exact(df, name):
    values = [row[0] for row in df.select(f"`{name}`").collect()]
    some = sorted(v for v in values if v is not None)
    return len(values), len(values) - len(some), some


@pytest.mark.parametrize("days", [DAYS[:1], DAYS[:2], DAYS, DAYS[3:]])
def test_any_range_as_counted_over_its_rows(table, tmp_path, days):
    path = str(tmp_path / "profiles")
    names = ["n", "price", "my name", "on"]
    assert save_profiles(table, names, path, ["day"]) == 16
    stored = table.sparkSession.read.parquet(path)
    found = {row.column_name: row for row in report(united(stored.where(F.col("day").isin(days)))).collect()}
    part = table.where(F.col("day").isin(days))
    assert set(found) == set(names)
    for name in names:
        total, nulls, some = exact(part, name)
        row = found[name]
        assert (row.total, row.nulls) == (total, nulls)
        assert abs(row.distinct_values - len(set(some))) <= max(1, 4 * DISTINCT_ERROR * len(set(some)))
        if name in ("n", "price"):
            assert (row.least_number, row.greatest_number) == ((float(some[0]), float(some[-1])) if some else (None, None))
            assert (row.quantiles is None) == (not some)
            for share, value in zip((0.25, 0.5, 0.75), row.quantiles or ()):
                below = sum(float(v) <= value for v in some) / len(some)
                assert abs(below - share) <= 3 * RANK_ERROR
        else:
            assert row.quantiles is None and row.least_number is None
            assert (row.least_text, row.greatest_text) == ((str(some[0]), str(some[-1])) if some else (None, None))


def test_a_day_profiled_again_replaces_its_profile(table, tmp_path):
    path = str(tmp_path / "profiles")
    save_profiles(table, ["n"], path, ["day"])
    save_profiles(table.where(F.col("day") == F.lit(DAYS[0])).limit(7), ["n"], path, ["day"])
    found = united(table.sparkSession.read.parquet(path)).first()
    assert found.total == 15_007


def test_all_columns_are_one_aggregate(table):
    tree = profile(table, ["n", "price", "my name"], ["day"])._jdf.queryExecution().optimizedPlan().toString()
    assert tree.count("Aggregate") == 1


def test_empty_table(spark):
    df = spark.createDataFrame([], "n int, price decimal(5,2)")
    assert [(row.total, row.distinct_values) for row in report(profile(df, ["n", "price"])).collect()] == [(0, 0), (0, 0)]
    assert united(profile(df, ["n"], ["price"])).collect() == []
