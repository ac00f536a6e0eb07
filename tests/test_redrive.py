from dataclasses import replace
from datetime import datetime
from decimal import Decimal

import pytest
from support import plan, rows
from test_daily import AS_OF, D5, gold, job, land, line  # noqa: F401

from lakestrata.operators.quality import DataQualityError
from lakestrata.plans.redrive import last_versions, redrive, upserted
from lakestrata.plans.stewardship import erase_from_lake

LANDED = "order_id string, product_id string, quantity int, unit_price_brl string, order_timestamp string, customer_email string, status string, corrected_at timestamp"
GOOD = [line("O1", "A", 2, 100.0, "2025-05-05T10:00:00Z"), line("O2", "B", 3, 50.0, "2025-05-04T10:00:00Z")]
BAD = [line("O1", "A", -2, 100.0, "2025-05-05T10:00:00Z"), line("O2", "B", 3, 50.0, "2025-05-04T10:00:00Z")]
CLEAN = [("A", D5, 2, Decimal("40.00")), ("B", D5.replace(day=4), 3, Decimal("30.00"))]


def correction(spark, *given):
    made = [(k, p, n, "100.0", "2025-05-05T10:00:00Z", f"{k}@x", "completed", datetime(2025, 5, 6, hour)) for k, p, n, hour in given]
    return spark.createDataFrame(made, LANDED)


def test_equals_a_clean_load(spark, job):  # noqa: F811
    job = replace(job, drop_quarantined=True)
    land(job, D5, *BAD)
    with pytest.raises(DataQualityError):
        job.run(spark, D5, AS_OF)
    given = correction(spark, ("O1", "A", 2, 9), ("O1", "Z", -7, 8), (None, "N", 1, 9)).withColumn("rule_id", given_rule())
    assert redrive(job, spark, D5, given, ["order_id"], AS_OF) == "PASS"
    assert rows(job.gold(spark), "product_id", "order_date", "total_quantity", "total_aggregated_value_usd") == CLEAN
    found = rows(job.silver(spark).drop("customer_email", "load_date"))
    clean = replace(job, root=job.root + "-clean", landing=job.landing.replace("landing", "landing-clean"))
    land(clean, D5, *GOOD)
    clean.run(spark, D5, AS_OF)
    assert found == rows(clean.silver(spark).drop("customer_email", "load_date"))
    # a reload of the files brings the bad row back, another call puts it right again
    with pytest.raises(DataQualityError):
        job.run(spark, D5, AS_OF)
    assert redrive(job, spark, D5, None, ["order_id"], AS_OF) == "PASS"
    assert gold(job, spark) == CLEAN
    assert redrive(job, spark, D5, correction(spark, ("O3", "C", 1, 10)), ["order_id"], AS_OF) == "PASS"
    assert len(gold(job, spark)) == 3
    erase_from_lake(job, spark, spark.createDataFrame([("O3@x",)], "customer_email string"), "customer_email")
    assert redrive(job, spark, D5, None, ["order_id"], AS_OF) == "PASS"
    assert gold(job, spark) == CLEAN


def given_rule():
    from pyspark.sql import functions as F

    return F.lit("DQ-SALES-001")


def test_a_day_never_loaded(spark, job):  # noqa: F811
    with pytest.raises(FileNotFoundError, match="no bronze rows"):
        redrive(job, spark, D5, None, ["order_id"], AS_OF)


def test_last_versions_and_ties(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, "x"), ("a", 2, "y"), (None, 9, "z"), ("b", None, "q")], "k string, t int, v string")
    assert rows(last_versions(df, ["k"], "t")) == [("a", 2, "y"), ("b", None, "q")]
    text = plan(last_versions(df, ["k"], "t"))
    assert "partial_max" in text and "Window" not in text
    assert rows(last_versions(df.where("false"), ["k"], "t")) == []


def test_upserted(spark, settings):
    settings(spark__sql__autoBroadcastJoinThreshold="-1")
    target = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1), (None, 5)], "k string, v int")
    updates = spark.createDataFrame([(7, "a", "extra"), (8, "c", "extra")], "v int, k string, more string")
    assert rows(upserted(target, updates, ["k"])) == sorted([("a", 7), ("b", 1), ("c", 8), (None, 5)], key=repr)
    assert rows(upserted(target, updates.where("false"), ["k"])) == rows(target)
