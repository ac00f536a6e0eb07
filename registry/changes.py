"""Queries over what happened to tables and jobs: totals of all levels, gaps between loads, attempts of steps, drift between versions, corrections."""

from __future__ import annotations

from dataclasses import replace
from datetime import date, datetime

from pyspark.sql import functions as F

from lakestrata.operators import contract as contracts
from lakestrata.operators import drift, runlog
from lakestrata.operators.quality import DataQualityError
from lakestrata.operators.steps import AggSpec, totals
from lakestrata.plans.incremental import load_new_days
from lakestrata.plans.redrive import redrive
from lakestrata.session import scratch_dir
from lakestrata.sources.landing import landing_path
from registry.queries import EVENT_GOLD_SQL, LOG_SQL, _log_events, _sales_job, event_sales, query, shown
from registry.sales_view import SALES_SQL, sales, table


@query(f"""
WITH {SALES_SQL}, dated AS (SELECT status, product_id, CAST(order_timestamp AS DATE) AS order_date, quantity, unit_price_brl FROM sales)
SELECT status, product_id, order_date, CAST(GROUPING(status, product_id, order_date) AS BIGINT) AS total_level,
       CAST(SUM(quantity) AS BIGINT) AS total_quantity, COUNT(unit_price_brl) AS priced,
       CAST(SUM(unit_price_brl) AS DOUBLE) AS total_price, CAST(MAX(unit_price_brl) AS DOUBLE) AS top_price
FROM dated GROUP BY GROUPING SETS ((status, product_id), (status, order_date), (product_id), (order_date), (status), ())""")
def agg_totals(spark, sf_dir):
    """Products, days and statuses with their totals and the grand total, in one pass."""
    step = totals(
        ["status", "product_id", "order_date"],
        [
            AggSpec("quantity", "sum", "total_quantity"),
            AggSpec("unit_price_brl", "count", "priced"),
            AggSpec("unit_price_brl", "sum", "total_price"),
            AggSpec("unit_price_brl", "max", "top_price"),
        ],
        levels=[["status", "product_id"], ["status", "order_date"], ["product_id"], ["order_date"], ["status"], []],
        date_from="order_timestamp",
    )
    return shown(step(sales(spark, sf_dir)))


@query("""
WITH loads AS (SELECT DISTINCT CAST(floor(epoch(ts) / 3600) * 3600 AS BIGINT) AS load FROM events WHERE value >= 150),
gaps AS (SELECT load, LAG(load) OVER (ORDER BY load) AS previous FROM loads)
SELECT load AS loaded_s, previous AS previous_s, CAST((load - previous) // 3600 AS BIGINT) AS gap_hours
FROM gaps WHERE load - previous > 3600""")
def contract_load_gaps_whole(spark, sf_dir):
    """Hours without any event of a large value, over the whole table."""
    found = contracts.load_gaps(table(spark, sf_dir, "events").where(F.col("value") >= 150), "ts", 1)
    return found.select(F.unix_seconds("loaded_at").alias("loaded_s"), F.unix_seconds("previous_at").alias("previous_s"), "gap_hours")


@query(f"""
WITH {LOG_SQL}, marked AS (
  SELECT *, CASE WHEN ts - LAG(ts) OVER (PARTITION BY step_name ORDER BY ts) <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS first FROM log
), numbered AS (
  SELECT *, SUM(first) OVER (PARTITION BY step_name ORDER BY ts ROWS UNBOUNDED PRECEDING) AS run FROM marked
), runs AS (
  SELECT step_name, run, epoch_us(MIN(ts)) AS started_us, epoch_us(MAX(ts)) AS ended_us, COUNT(*) AS events,
         COUNT(*) FILTER (WHERE status = 'STARTING') AS attempts, COUNT(*) FILTER (WHERE status = 'FAILED') AS failures,
         (array_agg(status ORDER BY ts DESC, status DESC) FILTER (WHERE status IN ('SUCCEEDED', 'FAILED')))[1] AS outcome,
         epoch_us(MAX(ts) FILTER (WHERE status = 'STARTING')) - epoch_us(MIN(ts) FILTER (WHERE status = 'STARTING')) AS apart
  FROM numbered GROUP BY 1, 2
)
SELECT step_name, started_us, ended_us, events, attempts, failures, outcome,
       CASE WHEN attempts > 1 THEN CAST(floor(apart / (attempts - 1)) AS BIGINT) END AS micros_between
FROM runs""")
def run_attempts(spark, sf_dir):
    """Runs of each step with their retries."""
    found = runlog.step_attempts(_log_events(spark, sf_dir), "30 minutes")
    return found.select(
        "step_name",
        F.unix_micros("started_at").alias("started_us"),
        F.unix_micros("ended_at").alias("ended_us"),
        "events",
        "attempts",
        "failures",
        "outcome",
        F.floor(F.round(F.col("seconds_between") * 1e6, 3)).alias("micros_between"),
    )


OLD_NEW_SQL = f"""
WITH {SALES_SQL},
old AS (SELECT order_id, product_id, quantity, unit_price_brl, status FROM sales WHERE quantity >= 0),
new AS (
  SELECT order_id, product_id, abs(quantity) AS quantity,
         CASE WHEN status = 'pending' AND unit_price_brl > 50000 THEN NULL ELSE unit_price_brl END AS unit_price_brl,
         CASE WHEN status = 'shipped' THEN 'completed' WHEN quantity > 40 THEN 'checked' ELSE status END AS status
  FROM sales WHERE NOT (status = 'pending' AND quantity = 7)
),
cells AS (
  SELECT order_id, product_id, quantity, unit_price_brl, status, SUM(sign) AS n
  FROM (SELECT *, -1 AS sign FROM old UNION ALL SELECT *, 1 FROM new) GROUP BY ALL HAVING SUM(sign) <> 0
),
keyed AS (
  SELECT order_id, CAST(SUM(CASE WHEN n < 0 THEN -n ELSE 0 END) AS BIGINT) AS old_rows, CAST(SUM(CASE WHEN n > 0 THEN n ELSE 0 END) AS BIGINT) AS new_rows,
         MAX(product_id) FILTER (WHERE n < 0) IS DISTINCT FROM MAX(product_id) FILTER (WHERE n > 0) AS i,
         MAX(quantity) FILTER (WHERE n < 0) IS DISTINCT FROM MAX(quantity) FILTER (WHERE n > 0) AS q,
         MAX(unit_price_brl) FILTER (WHERE n < 0) IS DISTINCT FROM MAX(unit_price_brl) FILTER (WHERE n > 0) AS p,
         MAX(status) FILTER (WHERE n < 0) IS DISTINCT FROM MAX(status) FILTER (WHERE n > 0) AS s
  FROM cells GROUP BY order_id
),
drift AS (
  SELECT order_id, CASE WHEN old_rows = 0 THEN 'added' WHEN new_rows = 0 THEN 'removed' ELSE 'changed' END AS change, old_rows, new_rows,
         CASE WHEN old_rows = 1 AND new_rows = 1 THEN
           concat_ws(',', CASE WHEN i THEN 'product_id' END, CASE WHEN q THEN 'quantity' END, CASE WHEN p THEN 'unit_price_brl' END, CASE WHEN s THEN 'status' END)
         END AS changed_columns
  FROM keyed
)
"""


def _versions(spark, sf_dir):
    rows = sales(spark, sf_dir).select("order_id", "product_id", "quantity", "unit_price_brl", "status")
    status, quantity, price = F.col("status"), F.col("quantity"), F.col("unit_price_brl")
    new = rows.where(~((status == "pending") & (quantity == 7))).select(
        "order_id",
        "product_id",
        F.abs(quantity).alias("quantity"),
        F.when((status == "pending") & (price > 50000), None).otherwise(price).alias("unit_price_brl"),
        F.when(status == "shipped", "completed").when(quantity > 40, "checked").otherwise(status).alias("status"),
    )
    return rows.where(quantity >= 0), new


@query(f"{OLD_NEW_SQL} SELECT * FROM drift")
def version_drift(spark, sf_dir):
    """Orders added, removed and changed between two versions."""
    return drift.version_drift(*_versions(spark, sf_dir), ["order_id"]).withColumn("changed_columns", F.array_join("changed_columns", ","))


@query(f"""{OLD_NEW_SQL}
SELECT change, column_name, COUNT(*) AS keys, CAST(SUM(old_rows) AS BIGINT) AS old_rows, CAST(SUM(new_rows) AS BIGINT) AS new_rows
FROM (SELECT change, old_rows, new_rows, unnest(list_concat([NULL], string_split(COALESCE(changed_columns, ''), ','))) AS column_name FROM drift)
WHERE column_name IS DISTINCT FROM '' GROUP BY 1, 2""")
def version_drift_summary(spark, sf_dir):
    return drift.drift_summary(drift.version_drift(*_versions(spark, sf_dir), ["order_id"]))


@query(f"""
WITH {EVENT_GOLD_SQL}
SELECT product_id, order_date, total_quantity, CAST(total_aggregated_value_usd AS DOUBLE) AS total_aggregated_value_usd
FROM event_gold""")
def redrive_quarantine(spark, sf_dir):
    """Every second quantity arrives negated, the check stops the day, and its quarantined rows come back corrected, twice."""
    root = scratch_dir(spark, "redrive")
    job, day = replace(_sales_job(root, root + "/landing/{yyyy}/{MM}/{dd}/"), drop_quarantined=True), date(2024, 1, 31)
    rows = event_sales(spark, sf_dir)
    negated = F.when(F.col("quantity") % 2 == 0, -F.col("quantity")).otherwise(F.col("quantity"))
    rows.withColumn("quantity", negated).write.option("header", True).csv(landing_path(job.landing, day))
    try:
        job.run(spark, day, datetime(2024, 2, 1))
    except DataQualityError:
        pass
    failed = spark.read.parquet(job.path("quarantine")).where(F.col("rule_id") == "DQ-SALES-001")
    versions = ((F.lit(1), datetime(2024, 2, 1, 8)), (F.abs("quantity"), datetime(2024, 2, 1, 9)))
    first, last = (failed.withColumn("quantity", value).withColumn("corrected_at", F.lit(at)) for value, at in versions)
    redrive(job, spark, day, last.unionByName(first), ["order_id"], datetime(2024, 2, 2))
    return shown(job.gold(spark).select("product_id", "order_date", "total_quantity", "total_aggregated_value_usd"))


@query(f"""
WITH {EVENT_GOLD_SQL}
SELECT product_id, order_date, total_quantity, CAST(total_aggregated_value_usd AS DOUBLE) AS total_aggregated_value_usd
FROM event_gold""")
def daily_incremental(spark, sf_dir):
    """Files of two load days arrive one after the other, then a late file for the first of them; each call loads what is new."""
    root = scratch_dir(spark, "incremental")
    job = _sales_job(root, root + "/landing/{yyyy}/{MM}/{dd}/")
    rows, hour = event_sales(spark, sf_dir), F.hour("order_timestamp")
    arrivals = ((date(2024, 1, 31), hour < 12), (date(2024, 2, 1), hour >= 18), (date(2024, 1, 31), (hour >= 12) & (hour < 18)))
    for day, part in arrivals:
        rows.where(part).write.mode("append").option("header", True).csv(landing_path(job.landing, day))
        load_new_days(job, spark, datetime(2024, 2, 14, 12))
    return shown(job.gold(spark).select("product_id", "order_date", "total_quantity", "total_aggregated_value_usd"))
