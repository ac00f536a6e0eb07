from datetime import date
from decimal import Decimal
from pathlib import Path

import pytest
from pyspark.sql import functions as F
from support import rows
from test_daily import AS_OF, D5, D6, D7, gold, job, land, line  # noqa: F401

from dataclasses import replace

from lakestrata.operators.governance import Retention
from lakestrata.operators.steps import AggSpec, Rollup
from lakestrata.plans import sales
from lakestrata.plans.backfill import run_days
from lakestrata.plans.stewardship import erase_from_lake, retain_lake

SPECS = [AggSpec("n", function, f"{function}_n") for function in ("sum", "avg", "count", "min", "max")]
SPECS += [AggSpec("price", function, f"{function}_price") for function in ("sum", "avg", "min")] + [AggSpec("price", "sum", "short", "decimal(9,1)")]


def test_parts_merge_to_the_whole(spark):
    data = [(k % 5 if k % 7 else None, None if k % 3 == 0 else k, Decimal(k * k) / 100 if k % 4 else None) for k in range(200)] + [(9, None, None)]
    df = spark.createDataFrame(data, "g int, n int, price decimal(10,2)")
    rollup = Rollup(["g"], SPECS)
    whole = rollup.step()(df)
    parts = [rollup.partial(df.where(F.coalesce(F.col("n") % 4, F.lit(0)) == k)) for k in range(4)]
    merged = rollup.merge(parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3]))
    assert rows(merged) == rows(whole)
    kinds = [("avg_n", merged.schema), ("avg_price", merged.schema), ("sum_n", merged.schema)]
    assert all(schema[name].dataType == whole.schema[name].dataType for name, schema in kinds)
    assert rollup.merge(rollup.partial(df.where("false"))).collect() == []


@pytest.mark.parametrize("together", [False, True])
def test_late_rows_merge_without_reading_earlier_silver(spark, job, together):  # noqa: F811
    job = replace(job, rollup=sales.DAILY_ROLLUP)
    land(job, D5, line("O1", "A", 2, 100.0, "2025-05-05T10:00:00Z"), line("O2", "B", 1, 50.0, "2025-05-05T10:00:00Z"))
    job.run(spark, D5, AS_OF)
    for file in Path(job.path("silver")).rglob("part-*.parquet"):
        file.write_bytes(b"unreadable")
    land(job, D6, line("O3", "A", 1, 100.0, "2025-05-05T22:00:00Z"), line("O4", "A", 1, 100.0, "2025-05-06T22:00:00Z"))
    run_days(job, spark, [D6], AS_OF) if together else job.run(spark, D6, AS_OF)
    assert gold(job, spark) == [("A", D5, 3, Decimal("60.00")), ("A", D6, 1, Decimal("20.00")), ("B", D5, 1, Decimal("10.00"))]


def test_corrected_archived_and_erased_loads(spark, job):  # noqa: F811
    job = replace(job, rollup=sales.DAILY_ROLLUP)
    land(job, D5, line("O1", "A", 2, 100.0, "2025-05-05T10:00:00Z", email="gone@x"), line("O2", "A", 1, 100.0, "2025-05-05T11:00:00Z"), line("O9", "A", 1, 100.0, "2025-05-04T11:00:00Z"))
    land(job, D6, line("O3", "A", 1, 100.0, "2025-05-05T22:00:00Z"))
    for day in (D5, D6):
        job.run(spark, day, AS_OF)
    assert gold(job, spark) == [("A", date(2025, 5, 4), 1, Decimal("20.00")), ("A", D5, 4, Decimal("80.00"))]
    # a corrected load has no rows of the fourth any more
    land(job, D5, line("O1", "A", 5, 100.0, "2025-05-05T10:00:00Z", email="gone@x"), line("O2", "A", 1, 100.0, "2025-05-05T11:00:00Z"))
    job.run(spark, D5, AS_OF)
    assert gold(job, spark) == [("A", D5, 7, Decimal("140.00"))]
    retain_lake(job, spark, {"silver": Retention("1d", "archive_local")}, D7)
    job.refresh_gold(spark)
    assert gold(job, spark) == [("A", D5, 7, Decimal("140.00"))]
    erase_from_lake(job, spark, spark.createDataFrame([("gone@x",)], "customer_email string"), "customer_email")
    assert gold(job, spark) == [("A", D5, 2, Decimal("40.00"))]
    job.refresh_gold(spark)
    assert gold(job, spark) == [("A", D5, 2, Decimal("40.00"))]
