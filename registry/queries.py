"""Every operator as a query over the test tables, each with the SQL that gives the same rows.

Money is computed in decimals and returned as double, and timestamps are returned as dates or
text, so that both engines hand out the same types.
"""

from __future__ import annotations

import tempfile
from collections.abc import Callable
from dataclasses import replace
from datetime import date, datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakestrata.operators import contract as contracts
from lakestrata.operators import governance, quality, runlog
from lakestrata.operators.duplicates import DuplicatedKeys, rows_with_duplicated_key, rows_without_duplicated_key
from lakestrata.operators.quality import Rule
from lakestrata.operators.steps import (
    AggSpec,
    aggregate,
    chain,
    sql_step,
    steps_for,
    template_step,
    with_date,
    with_ingestion_timestamp,
)
from lakestrata.plans import sales as domain
from lakestrata.plans.backfill import run_days
from lakestrata.plans.daily import DailyJob
from lakestrata.plans.documents import job_from_documents, step_from_template
from lakestrata.plans.stewardship import erase_from_lake as erase_everywhere
from lakestrata.plans.stewardship import retain_lake
from lakestrata.session import has_folder, scratch_dir, use_folder, use_utc
from lakestrata.sources import lake, landing
from registry.sales_view import GOLD_SQL, SALES_SQL, SILVER_SQL, sales, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

AS_OF = "2024-02-14 12:00:00"


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    def register(function: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            if not has_folder(spark) and spark.sparkContext.master.startswith("local"):
                use_folder(spark, tempfile.mkdtemp(prefix="lakestrata-"))  # a local check that names none
            return function(use_utc(spark), sf_dir)

        QUERIES[name or function.__name__] = run
        if sql:
            ORACLES[name or function.__name__] = sql
        return function

    return register


def shown(df: DataFrame) -> DataFrame:
    """Decimals as double, so that the types do not depend on the engine."""
    decimals = [f.name for f in df.schema.fields if isinstance(f.dataType, T.DecimalType)]
    return df.withColumns({name: F.col(name).cast("double") for name in decimals})


def silver(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chain(sales(spark, sf_dir), steps_for("silver", domain.STEPS))


def stored_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sales as a stored table, which is what checks read that go over their input again."""
    path = scratch_dir(spark, "sales")
    lake.overwrite_table(sales(spark, sf_dir), path)
    return spark.read.parquet(path)


def gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chain(silver(spark, sf_dir), steps_for("gold", domain.STEPS))


# Landing columns as both engines return them.
SALES_OUT = """order_id, product_id, quantity, CAST(unit_price_brl AS DOUBLE) AS unit_price_brl,
       CAST(order_timestamp AS DATE) AS order_date, customer_email, status"""


def sales_out(df: DataFrame) -> DataFrame:
    return shown(with_date("order_timestamp")(df).drop("order_timestamp").select(
        "order_id", "product_id", "quantity", "unit_price_brl", "order_date", "customer_email", "status"
    ))


def event_sales(spark, sf_dir) -> DataFrame:
    """Events as sales: thirty days, with times of day. Purchases are the completed ones."""
    return table(spark, sf_dir, "events").select(
        F.concat(F.lit("ORD"), "event_id").alias("order_id"),
        F.concat(F.lit("PROD_"), "user_id").alias("product_id"),
        (F.col("event_id") % 20 + 1).cast("int").alias("quantity"),
        F.col("value").cast("decimal(18,2)").alias("unit_price_brl"),
        F.col("ts").cast("timestamp").alias("order_timestamp"),
        F.concat(F.lit("user"), "user_id", F.lit("@example.com")).alias("customer_email"),
        F.when(F.col("event_type") == "purchase", "completed").otherwise("pending").alias("status"),
    )


def event_gold(spark, sf_dir) -> DataFrame:
    rows = chain(event_sales(spark, sf_dir), steps_for("silver", domain.STEPS))
    return chain(rows, steps_for("gold", domain.STEPS))


EVENT_GOLD_SQL = """
event_sales AS (
  SELECT concat('PROD_', CAST(user_id AS VARCHAR)) AS product_id, CAST(ts AS DATE) AS order_date,
         CAST(event_id % 20 + 1 AS INTEGER) AS quantity, CAST(value AS DECIMAL(18,2)) AS unit_price_brl
  FROM events WHERE event_type = 'purchase'
),
event_silver AS (
  SELECT *, CAST(quantity * CAST(unit_price_brl / 5.0 AS DECIMAL(18,2)) AS DECIMAL(18,2)) AS total_value_usd FROM event_sales
),
event_gold AS (
  SELECT product_id, order_date, CAST(SUM(quantity) AS BIGINT) AS total_quantity,
         CAST(SUM(total_value_usd) AS DECIMAL(20,2)) AS total_aggregated_value_usd
  FROM event_silver GROUP BY 1, 2
)"""


# --- The whole chain -------------------------------------------------------------------------


@query(f"""
WITH {GOLD_SQL}
SELECT product_id, order_date, total_quantity,
       CAST(total_aggregated_value_usd AS DOUBLE) AS total_aggregated_value_usd
FROM gold""")
def flagship_daily_sales(spark, sf_dir):
    return shown(gold(spark, sf_dir))


# --- Sources ---------------------------------------------------------------------------------


MICROS = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"


def _written_landing(df: DataFrame, time, file_format: str, path: str, template: str) -> str:
    """Write landing files in the folders of a template such as `year={yyyy}/month={MM}`."""
    patterns = {"{yyyy}": "yyyy", "{MM}": "MM", "{dd}": "dd"}
    parts = dict(part.split("=") for part in template.split("/"))
    by_day = df.withColumns({name: F.date_format(time, patterns[key]) for name, key in parts.items()})
    writer = by_day.hint("rebalance", *parts).write.partitionBy(*parts).option("timestampFormat", MICROS)
    writer.option("header", True).format(file_format).save(path)
    return f"{path}/{template}"


DAILY, MONTHLY = "year={yyyy}/month={MM}/day={dd}", "year={yyyy}/month={MM}"


def _days_of(df: DataFrame, timestamp: str) -> list[date]:
    first, last = df.agg(F.min(F.to_date(timestamp)), F.max(F.to_date(timestamp))).first()
    return landing.days_between(first, last)


@query(f"WITH {SALES_SQL} SELECT {SALES_OUT} FROM sales")
def src_csv_roundtrip(spark, sf_dir):
    """Landing folders per month here; the JSON query has them per day."""
    rows = sales(spark, sf_dir)
    template = _written_landing(rows, F.col("order_timestamp"), "csv", scratch_dir(spark, "landing-csv"), MONTHLY)
    days = _days_of(table(spark, sf_dir, "lineitem"), "l_shipdate")
    paths = landing.landing_paths(spark, template, days, skip_missing=True)
    return sales_out(landing.read_files(spark, paths, "csv", domain.CONTRACT.schema("landing")))


EVENT_SCHEMA = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"


@query("SELECT event_id, epoch_us(ts) AS ts_us, user_id, event_type, value, props FROM events")
def src_json_roundtrip(spark, sf_dir):
    rows = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    template = _written_landing(rows, F.col("ts"), "json", scratch_dir(spark, "landing-json"), DAILY)
    paths = landing.landing_paths(spark, template, _days_of(rows, "ts"), skip_missing=True)
    read = landing.read_files(spark, paths, "json", EVENT_SCHEMA)
    return read.select("event_id", F.unix_micros("ts").alias("ts_us"), "user_id", "event_type", "value", "props")


@query("""
SELECT CAST(ts AS DATE) AS event_date, COUNT(*) AS row_count FROM events GROUP BY 1
UNION ALL
SELECT CAST(MAX(ts) AS DATE) + 1, 0 FROM events
UNION ALL
SELECT CAST(MAX(ts) AS DATE) + 2, -1 FROM events""")
def src_missing_or_empty(spark, sf_dir):
    """Rows read per day: the day after the last has a file without rows (0), the next no file (-1)."""
    rows = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    path = scratch_dir(spark, "landing-empty")
    template = _written_landing(rows, F.col("ts"), "csv", path, DAILY)
    days = _days_of(rows, "ts")
    empty, missing = days[-1] + timedelta(days=1), days[-1] + timedelta(days=2)
    rows.where(F.lit(False)).write.option("header", True).csv(landing.landing_path(template, empty))
    paths = landing.landing_paths(spark, template, [*days, empty, missing], skip_missing=True)
    counted = (
        landing.read_files(spark, paths, "csv", EVENT_SCHEMA)
        .groupBy(F.to_date("ts").alias("event_date"))
        .agg(F.count(F.lit(1)).alias("row_count"))
    )
    extra = []
    for day in (empty, missing):
        try:
            one = landing.read_files(spark, landing.landing_path(template, day), "csv", EVENT_SCHEMA)
            extra.append((day, 0 if one.isEmpty() else 1))
        except FileNotFoundError:
            extra.append((day, -1))
    return counted.unionByName(spark.createDataFrame(extra, "event_date date, row_count bigint"))


# --- Sinks -----------------------------------------------------------------------------------


@query("""
SELECT CAST(ts AS DATE) AS event_date, COUNT(*) AS row_count, SUM(value) > 0 AS has_value,
       MIN(CASE WHEN CAST(ts AS DATE) = (SELECT CAST(MAX(ts) AS DATE) FROM events)
                THEN '2024-02-15 12:00:00' ELSE '2024-02-14 12:00:00' END) AS ingested_at
FROM events GROUP BY 1""")
def bronze_overwrite_day(spark, sf_dir):
    """All days loaded twice, then the last one reloaded: every day is there once."""
    path = scratch_dir(spark, "bronze")
    rows = table(spark, sf_dir, "events")
    parts = {"year": F.date_format("ts", "yyyy"), "month": F.date_format("ts", "MM"), "day": F.date_format("ts", "dd")}
    stamped = with_ingestion_timestamp(AS_OF)(rows).withColumns(parts)
    for _ in range(2):
        lake.overwrite_partitions(stamped, path, list(parts))
    last = _days_of(rows, "ts")[-1]
    reloaded = with_ingestion_timestamp("2024-02-15 12:00:00")(rows.where(F.to_date("ts") == F.lit(last)))
    lake.overwrite_slice(reloaded, path, lake.day_parts(last))
    return (
        spark.read.parquet(path)
        .groupBy(F.to_date("ts").alias("event_date"))
        .agg(
            F.count(F.lit(1)).alias("row_count"),
            (F.sum("value") > 0).alias("has_value"),
            F.min(F.date_format("_ingestion_timestamp", "yyyy-MM-dd HH:mm:ss")).alias("ingested_at"),
        )
    )


@query(f"""
WITH {SILVER_SQL}
SELECT order_id, product_id, quantity, CAST(total_value_usd AS DOUBLE) AS total_value_usd
FROM silver WHERE order_timestamp = (SELECT MAX(order_timestamp) FROM silver)""")
def silver_overwrite_full(spark, sf_dir):
    """The whole silver table, then its last day: only that day is left."""
    path = scratch_dir(spark, "silver")
    rows = silver(spark, sf_dir)
    lake.overwrite_table(rows, path)
    last = spark.read.parquet(path).agg(F.max("order_timestamp")).first()[0]
    lake.overwrite_table(rows.where(F.col("order_timestamp") == F.lit(last)), path)
    return shown(spark.read.parquet(path).select("order_id", "product_id", "quantity", "total_value_usd"))


@query(f"""
WITH {GOLD_SQL}
SELECT product_id, order_date,
       CASE WHEN order_date < DATE '1998-01-01' THEN total_quantity ELSE total_quantity + 1 END AS total_quantity
FROM gold""")
def gold_overwrite_partitions(spark, sf_dir):
    """The second batch replaces the months it holds; the earlier ones stay as they were."""
    path = scratch_dir(spark, "gold")
    rows = gold(spark, sf_dir).withColumn("order_month", F.trunc("order_date", "month"))
    lake.overwrite_partitions(rows, path, ["order_month"])
    newer = rows.where(F.col("order_date") >= F.lit(date(1998, 1, 1)))
    lake.overwrite_partitions(newer.withColumn("total_quantity", F.col("total_quantity") + 1), path, ["order_month"])
    return spark.read.parquet(path).select("product_id", "order_date", "total_quantity")


@query(f"""
WITH {SILVER_SQL}
SELECT 'silver' AS table_name, COUNT(*) AS observed_rows, COUNT(*) AS stored_rows FROM silver""")
def observed_write_count(spark, sf_dir):
    path = scratch_dir(spark, "observed")
    written = lake.overwrite_table(silver(spark, sf_dir), path)
    return spark.read.parquet(path).agg(
        F.lit("silver").alias("table_name"),
        F.lit(written).cast("bigint").alias("observed_rows"),
        F.count(F.lit(1)).alias("stored_rows"),
    )


@query(f"""
WITH {GOLD_SQL}
SELECT 'bronze' AS table_name, COUNT(*) AS row_count, CAST(MAX(order_timestamp) AS DATE) AS last_date FROM sales
UNION ALL SELECT 'silver', COUNT(*), CAST(MAX(order_timestamp) AS DATE) FROM silver
UNION ALL SELECT 'gold', COUNT(*), MAX(order_date) FROM gold""")
def table_metrics(spark, sf_dir):
    return (
        lake.table_metrics(sales(spark, sf_dir), "bronze", "order_timestamp")
        .unionByName(lake.table_metrics(silver(spark, sf_dir), "silver", "order_timestamp"))
        .unionByName(lake.table_metrics(gold(spark, sf_dir), "gold", "order_date"))
    )


# --- Steps -----------------------------------------------------------------------------------


@query(f"WITH {SALES_SQL} SELECT {SALES_OUT} FROM sales WHERE status = 'completed'")
def filter_status(spark, sf_dir):
    return sales_out(domain.FILTER_COMPLETED(sales(spark, sf_dir)))


@query(f"""
WITH {SALES_SQL}
SELECT order_id, CAST(unit_price_brl AS DOUBLE) AS unit_price_brl,
       CAST(CAST(unit_price_brl / 5.0 AS DECIMAL(18,2)) AS DOUBLE) AS unit_price_usd
FROM sales""")
def convert_currency(spark, sf_dir):
    rows = domain.PRICE_IN_USD(sales(spark, sf_dir))
    return shown(rows.select("order_id", "unit_price_brl", "unit_price_usd"))


@query(f"""
WITH {SILVER_SQL}
SELECT order_id, quantity, CAST(unit_price_usd AS DOUBLE) AS unit_price_usd,
       CAST(total_value_usd AS DOUBLE) AS total_value_usd
FROM silver""")
def line_total(spark, sf_dir):
    rows = silver(spark, sf_dir)
    return shown(rows.select("order_id", "quantity", "unit_price_usd", "total_value_usd"))


@query("SELECT event_id, CAST(ts AS DATE) AS order_date FROM events", name="with_date")
def event_dates(spark, sf_dir):
    return with_date("ts")(table(spark, sf_dir, "events")).select("event_id", "order_date")


@query(f"""
WITH {SALES_SQL}
SELECT order_id, quantity, '2024-02-14 12:00:00' AS ingested_at FROM sales""")
def ingestion_timestamp(spark, sf_dir):
    rows = with_ingestion_timestamp(AS_OF)(sales(spark, sf_dir))
    ingested = F.date_format("_ingestion_timestamp", "yyyy-MM-dd HH:mm:ss").alias("ingested_at")
    return rows.select("order_id", "quantity", ingested)


@query(f"""
WITH {SALES_SQL}
SELECT {SALES_OUT}, '2024-02-14 12:00:00' AS ingested_at FROM sales""")
def layer_projection_bronze(spark, sf_dir):
    wide = with_ingestion_timestamp(AS_OF)(sales(spark, sf_dir)).withColumn("not_in_contract", F.lit(1))
    rows = contracts.project(wide, domain.CONTRACT, "bronze")
    ingested = F.date_format("_ingestion_timestamp", "yyyy-MM-dd HH:mm:ss")
    return shown(
        with_date("order_timestamp")(rows)
        .withColumn("ingested_at", ingested)
        .drop("order_timestamp", "_ingestion_timestamp")
    )


@query(f"""
WITH {SILVER_SQL}
SELECT {SALES_OUT}, CAST(unit_price_usd AS DOUBLE) AS unit_price_usd,
       CAST(total_value_usd AS DOUBLE) AS total_value_usd
FROM silver""")
def layer_projection(spark, sf_dir):
    wide = with_ingestion_timestamp(AS_OF)(silver(spark, sf_dir))
    rows = contracts.project(wide, domain.CONTRACT, "silver")
    return shown(with_date("order_timestamp")(rows).drop("order_timestamp"))


@query(f"""
WITH {GOLD_SQL}
SELECT product_id, order_date, total_quantity,
       CAST(total_aggregated_value_usd AS DOUBLE) AS total_aggregated_value_usd
FROM gold""")
def layer_projection_gold(spark, sf_dir):
    return shown(contracts.project(gold(spark, sf_dir), domain.CONTRACT, "gold"))


@query(f"WITH {SALES_SQL} SELECT {SALES_OUT} FROM sales WHERE status = 'completed'")
def sql_step_bound(spark, sf_dir):
    step = sql_step("SELECT * FROM {input} WHERE IDENTIFIER(:column) = :value", column="status", value="completed")
    return sales_out(step(sales(spark, sf_dir)))


@query(f"""
WITH {SALES_SQL}
SELECT order_id, CAST(unit_price_brl * 1.25 AS DOUBLE) AS raised FROM sales WHERE status <> 'shipped'""")
def template_step_bound(spark, sf_dir):
    step = template_step(
        "SELECT order_id, `{amount}` * {factor} AS `{raised}` FROM {input_view_or_df} WHERE `{state}` <> {skipped}",
        {"amount": "unit_price_brl", "factor": 1.25, "raised": "raised", "state": "status", "skipped": "shipped"},
    )
    return shown(step(sales(spark, sf_dir)))


COUNT_TEMPLATE = {
    "logic": {
        "sql_template": "SELECT {group_by_clause}, {aggregation_clause} FROM {input_view_or_df} "
        "WHERE quantity > 0 AND `{timestamp_column_for_date}` < TIMESTAMP '1997-01-01' GROUP BY {group_by_clause}"
    }
}


@query(f"""
WITH {SALES_SQL}
SELECT status, customer_email, CAST(SUM(quantity) AS BIGINT) AS pieces, COUNT(unit_price_brl) AS priced, MAX(order_id) AS last_order
FROM sales WHERE quantity > 0 AND order_timestamp < TIMESTAMP '1997-01-01' GROUP BY 1, 2""")
def agg_template_where(spark, sf_dir):
    """The SQL of an aggregate template is run, its filter too."""
    columns = {"pieces": ("quantity", "sum"), "priced": ("unit_price_brl", "count"), "last_order": ("order_id", "max")}
    step = step_from_template(
        COUNT_TEMPLATE,
        {
            "group_by_columns": ["status", "customer_email"],
            "aggregation_specs": [
                {"source_column": source, "function": function, "target_column": target}
                for target, (source, function) in columns.items()
            ],
            "timestamp_column_for_date": "order_timestamp",
        },
    )
    return step(sales(spark, sf_dir))


@query(f"""
WITH {SALES_SQL}
SELECT status, CAST(order_timestamp AS DATE) AS order_date,
       CAST(SUM(quantity) AS BIGINT) AS sum_quantity, CAST(AVG(quantity) AS DOUBLE) AS avg_quantity,
       COUNT(unit_price_brl) AS priced, MIN(quantity) AS min_quantity, MAX(quantity) AS max_quantity,
       CAST(SUM(unit_price_brl) AS DOUBLE) AS sum_price
FROM sales GROUP BY 1, 2""")
def agg_spec_all_functions(spark, sf_dir):
    step = aggregate(
        ["status", "order_date"],
        [
            AggSpec("quantity", "sum", "sum_quantity"),
            AggSpec("quantity", "avg", "avg_quantity"),
            AggSpec("unit_price_brl", "count", "priced"),
            AggSpec("quantity", "min", "min_quantity"),
            AggSpec("quantity", "max", "max_quantity"),
            AggSpec("unit_price_brl", "sum", "sum_price"),
        ],
        date_from="order_timestamp",
    )
    return shown(step(sales(spark, sf_dir)))


@query(f"""
WITH {SALES_SQL}
SELECT customer_email, MIN(order_id) AS first_order, MAX(order_id) AS last_order,
       CAST(MIN(order_timestamp) AS DATE) AS first_date, CAST(MAX(unit_price_brl) AS DOUBLE) AS top_price
FROM sales GROUP BY 1""")
def agg_spec_text_and_dates(spark, sf_dir):
    step = aggregate(
        ["customer_email"],
        [
            AggSpec("order_id", "min", "first_order"),
            AggSpec("order_id", "max", "last_order"),
            AggSpec("order_date", "min", "first_date"),
            AggSpec("unit_price_brl", "max", "top_price"),
        ],
        date_from="order_timestamp",
    )
    return shown(step(sales(spark, sf_dir)))


# --- Data quality ----------------------------------------------------------------------------

UNIQUE_ORDER = Rule("UNIQUE-ORDER", "uniqueness", column="order_id", warning=99.0, error=95.0, on_error=("quarantine",))
RUN_DAY = "2001-11-04"


def graded_sql(counts: str) -> str:
    """Grade rows of (rule_id, total, failing, warning, error) as the rules do."""
    return f"""
counts AS ({counts}),
shares AS (
  SELECT *, CASE WHEN total = 0 THEN 100.0 ELSE CAST(total - failing AS DOUBLE) / CAST(total AS DOUBLE) * 100 END AS pct
  FROM counts
),
graded AS (
  SELECT rule_id, CASE WHEN total = 0 THEN 'PASS' WHEN pct < error THEN 'ERROR' WHEN pct < warning THEN 'WARNING'
         ELSE 'PASS' END AS status,
         pct AS success_percentage, CAST(total AS BIGINT) AS total_records, CAST(failing AS BIGINT) AS failing_records
  FROM shares
)"""


RULE_COUNTS = """
  SELECT 'DQ-SALES-001' AS rule_id, COUNT(*) AS total, COUNT(*) FILTER (WHERE NOT (quantity > 0)) AS failing,
         99.0 AS warning, 95.0 AS error FROM sales
  UNION ALL
  SELECT 'DQ-SALES-002', COUNT(*), COUNT(*) FILTER (WHERE unit_price_brl IS NULL), 99.5, 98.0 FROM sales
  UNION ALL
  SELECT 'DQ-SALES-003', COUNT(*),
         COUNT(*) FILTER (WHERE NOT (customer_email IS NOT NULL AND customer_email <> '')), 95.0, 90.0 FROM sales"""
UNIQUE_COUNT = """
  UNION ALL
  SELECT 'UNIQUE-ORDER', CAST(SUM(n) AS BIGINT), CAST(COALESCE(SUM(n) FILTER (WHERE n > 1 AND order_id IS NOT NULL), 0) AS BIGINT),
         99.0, 95.0
  FROM (SELECT order_id, COUNT(*) AS n FROM sales GROUP BY order_id) AS keys"""


@query(f"""
WITH {SALES_SQL},
{graded_sql(RULE_COUNTS + UNIQUE_COUNT)}
SELECT 'sales_daily_br_v1' AS pipeline_id, 'silver' AS target_layer, '{RUN_DAY}' AS processing_date, * FROM graded""")
def dq_evaluate(spark, sf_dir):
    return quality.evaluate(sales(spark, sf_dir), [*domain.RULES, UNIQUE_ORDER], domain.PIPELINE_ID, "silver", RUN_DAY)


@query(f"""
WITH {SALES_SQL}
SELECT {SALES_OUT} FROM sales
WHERE order_id IN (SELECT order_id FROM sales GROUP BY order_id HAVING COUNT(*) > 1)""")
def dq_uniqueness(spark, sf_dir):
    return sales_out(rows_with_duplicated_key(stored_sales(spark, sf_dir), ["order_id"]))


@query(f"""
WITH {SALES_SQL}
SELECT {SALES_OUT} FROM sales
WHERE order_id NOT IN (SELECT order_id FROM sales WHERE order_id IS NOT NULL GROUP BY order_id HAVING COUNT(*) > 1)""")
def dq_single_keys(spark, sf_dir):
    return sales_out(rows_without_duplicated_key(stored_sales(spark, sf_dir), ["order_id"]))


@query(f"""
WITH {SALES_SQL}, total AS (SELECT COUNT(*) AS n FROM sales)
SELECT 'NO-TEST' AS rule_id, 'SKIP' AS status, 100.0::DOUBLE AS success_percentage, n AS total_records,
       0::BIGINT AS failing_records FROM total
UNION ALL SELECT 'NO-COLUMN', 'EXECUTION_ERROR', 0.0, n, 0 FROM total
UNION ALL SELECT 'NO-SYNTAX', 'EXECUTION_ERROR', 0.0, n, 0 FROM total
UNION ALL SELECT 'NO-KEY', 'EXECUTION_ERROR', 0.0, n, 0 FROM total
UNION ALL SELECT 'PRICED', CASE WHEN COUNT(unit_price_brl) = COUNT(*) THEN 'PASS' ELSE 'ERROR' END,
       CAST(COUNT(unit_price_brl) AS DOUBLE) / CAST(COUNT(*) AS DOUBLE) * 100, COUNT(*),
       COUNT(*) - COUNT(unit_price_brl) FROM sales""")
def dq_skip_and_error(spark, sf_dir):
    rules = [
        Rule("NO-TEST", "referential", column="product_id"),
        Rule("NO-COLUMN", "validity", condition="no_such_column > 0"),
        Rule("NO-SYNTAX", "validity", condition="quantity >"),
        Rule("NO-KEY", "uniqueness", column="no_such_column"),
        Rule("PRICED", "completeness", column="unit_price_brl"),
    ]
    results = quality.evaluate(sales(spark, sf_dir), rules, domain.PIPELINE_ID, "silver", RUN_DAY)
    return results.drop("pipeline_id", "target_layer", "processing_date")


MONTHLY_COUNTS = """
  SELECT last_day(CAST(order_timestamp AS DATE)) AS day, 'DQ-SALES-001' AS rule_id, COUNT(*) AS total,
         COUNT(*) FILTER (WHERE NOT (quantity > 0)) AS failing, 99.0 AS warning, 95.0 AS error FROM sales GROUP BY 1
  UNION ALL
  SELECT last_day(CAST(order_timestamp AS DATE)), 'DQ-SALES-002', COUNT(*),
         COUNT(*) FILTER (WHERE unit_price_brl IS NULL), 99.5, 98.0 FROM sales GROUP BY 1
  UNION ALL
  SELECT day, 'UNIQUE-ORDER', CAST(SUM(n) AS BIGINT), CAST(COALESCE(SUM(n) FILTER (WHERE n > 1 AND order_id IS NOT NULL), 0) AS BIGINT),
         99.0, 95.0
  FROM (SELECT last_day(CAST(order_timestamp AS DATE)) AS day, order_id, COUNT(*) AS n FROM sales GROUP BY 1, 2) AS keys
  GROUP BY 1"""
MONTHLY_GRADES = f"""
counts AS ({MONTHLY_COUNTS}),
graded AS (
  SELECT day, rule_id, CAST(total - failing AS DOUBLE) / CAST(total AS DOUBLE) * 100 AS pct, total, failing, warning, error
  FROM counts
),
ranked AS (
  SELECT *, CASE WHEN pct < error THEN 2 WHEN pct < warning THEN 1 ELSE 0 END AS severity FROM graded
)"""


def _monthly_results(spark, sf_dir) -> DataFrame:
    """The quality runs of every month in one pass."""
    rules = [domain.RULES[0], domain.RULES[1], UNIQUE_ORDER]
    month = F.last_day(F.to_date("order_timestamp"))
    return quality.evaluate(sales(spark, sf_dir), rules, domain.PIPELINE_ID, "silver", month)


@query(f"""
WITH {SALES_SQL}, {MONTHLY_GRADES}
SELECT 'silver' AS target_layer, day AS processing_date,
       CASE MAX(severity) WHEN 2 THEN 'ERROR' WHEN 1 THEN 'WARNING' ELSE 'PASS' END AS overall_status
FROM ranked GROUP BY day""")
def dq_overall(spark, sf_dir):
    return quality.overall(_monthly_results(spark, sf_dir)).drop("pipeline_id")


@query(f"""
WITH {SALES_SQL}, {MONTHLY_GRADES}
SELECT day AS processing_date, CASE MAX(severity) WHEN 2 THEN 'blocked' ELSE 'open' END AS decision, COUNT(*) AS rules
FROM ranked GROUP BY day""")
def dq_gate(spark, sf_dir):
    """Results stored per layer and date, twice, and the gate decided from what is stored."""
    path = scratch_dir(spark, "dq-results")
    results = _monthly_results(spark, sf_dir)
    for _ in range(2):
        lake.overwrite_partitions(results, path, ["target_layer", "processing_date"])
    stored = spark.read.parquet(path)
    rules = stored.groupBy("processing_date").agg(F.count(F.lit(1)).alias("rules"))
    return quality.gates(stored).select("processing_date", "decision").join(rules, "processing_date")


@query(f"""
WITH {SALES_SQL}, {MONTHLY_GRADES}
SELECT day AS processing_date, CASE MAX(severity) WHEN 2 THEN 'ERROR' WHEN 1 THEN 'WARNING' ELSE 'PASS' END AS status
FROM ranked GROUP BY day""")
def dq_gate_stored(spark, sf_dir):
    """The gate as a job asks it, for every month with stored results."""
    path = scratch_dir(spark, "dq-gate")
    lake.overwrite_partitions(_monthly_results(spark, sf_dir), path, ["target_layer", "processing_date"])
    stored = spark.read.parquet(path).select("target_layer", "processing_date").distinct().collect()
    found = [(day, quality.gate(spark, path, layer, str(day))) for layer, day in stored]
    return spark.createDataFrame(found, "processing_date date, status string")


@query(f"""
WITH {SALES_SQL}, few AS (SELECT * FROM sales WHERE quantity > 1000000),
{graded_sql(RULE_COUNTS.replace("FROM sales", "FROM few"))}
SELECT * FROM graded""")
def dq_empty_input(spark, sf_dir):
    """Without rows every rule passes."""
    none = sales(spark, sf_dir).where("quantity > 1000000")
    results = quality.evaluate(none, domain.RULES, domain.PIPELINE_ID, "silver", RUN_DAY)
    return results.drop("pipeline_id", "target_layer", "processing_date")


BREAKING_RULE = Rule("BREAKS", "validity", condition="IF(quantity < 0, raise_error('negative'), true)")


@query(f"""
WITH {SALES_SQL},
{graded_sql(RULE_COUNTS)}
SELECT * FROM graded
UNION ALL
SELECT 'BREAKS', CASE WHEN COUNT(*) FILTER (WHERE quantity < 0) > 0 THEN 'EXECUTION_ERROR' ELSE 'PASS' END,
       CASE WHEN COUNT(*) FILTER (WHERE quantity < 0) > 0 THEN 0.0 ELSE 100.0 END, COUNT(*), 0 FROM sales""")
def dq_value_error(spark, sf_dir):
    """A rule that fails on some value is an error of its own; the others are graded as ever."""
    rules = [*domain.RULES, BREAKING_RULE]
    found = quality.run_rules(sales(spark, sf_dir), rules, domain.PIPELINE_ID, "silver", RUN_DAY)
    results = spark.createDataFrame(found, quality.RESULT_SCHEMA)
    return results.drop("pipeline_id", "target_layer", "processing_date")


STRICT_RULES = [
    Rule("POSITIVE", "validity", condition="quantity > 0", on_error=("log", "quarantine")),
    Rule("PRICED", "completeness", column="unit_price_brl", on_error=("quarantine", "abort_pipeline")),
    Rule("UNIQUE", "uniqueness", column="order_id", on_error=("quarantine", "notify_slack")),
    Rule("NOT-KEPT", "validity", condition="status = 'completed'", on_error=("log",)),
]


@query(f"""
WITH {SALES_SQL}, bad AS (
  SELECT 'POSITIVE' AS rule_id, * FROM sales WHERE NOT (quantity > 0)
  UNION ALL SELECT 'PRICED', * FROM sales WHERE unit_price_brl IS NULL
  UNION ALL SELECT 'UNIQUE', * FROM sales
  WHERE order_id IN (SELECT order_id FROM sales GROUP BY order_id HAVING COUNT(*) > 1)
)
SELECT rule_id, {SALES_OUT} FROM bad""")
def dq_quarantine(spark, sf_dir):
    """Failing rows of the rules that ask for quarantine; the second run replaces the first."""
    path = scratch_dir(spark, "quarantine")
    rows = stored_sales(spark, sf_dir)
    keys = DuplicatedKeys(rows)
    results = quality.run_rules(rows, STRICT_RULES, domain.PIPELINE_ID, "silver", RUN_DAY, keys)
    for _ in range(2):
        quality.quarantine(rows, STRICT_RULES, results, path, "silver", RUN_DAY, keys)
    stored = spark.read.parquet(path)
    return shown(
        with_date("order_timestamp")(stored).drop("order_timestamp", "target_layer", "processing_date")
    )


@query(f"""
WITH {SALES_SQL}
SELECT {SALES_OUT} FROM sales
WHERE quantity > 0 AND unit_price_brl IS NOT NULL
  AND order_id NOT IN (SELECT order_id FROM sales GROUP BY order_id HAVING COUNT(*) > 1)""")
def dq_drop_quarantined(spark, sf_dir):
    return sales_out(quality.passing_rows(stored_sales(spark, sf_dir), STRICT_RULES[:3]))


@query(f"""
WITH {SALES_SQL}, due AS (
  SELECT 'POSITIVE' AS rule_id, 'log' AS action, true AS handled, COUNT(*) AS failing FROM sales WHERE NOT (quantity > 0)
  UNION ALL SELECT 'POSITIVE', 'quarantine', true, COUNT(*) FROM sales WHERE NOT (quantity > 0)
  UNION ALL SELECT 'PRICED', 'quarantine', true, COUNT(*) FROM sales WHERE unit_price_brl IS NULL
  UNION ALL SELECT 'PRICED', 'abort_pipeline', true, COUNT(*) FROM sales WHERE unit_price_brl IS NULL
  UNION ALL SELECT 'UNIQUE', 'quarantine', true, COUNT(*) FROM (SELECT order_id FROM sales GROUP BY 1 HAVING COUNT(*) > 1)
  UNION ALL SELECT 'UNIQUE', 'notify_slack', false, COUNT(*) FROM (SELECT order_id FROM sales GROUP BY 1 HAVING COUNT(*) > 1)
  UNION ALL SELECT 'NOT-KEPT', 'log', true, COUNT(*) FROM sales WHERE NOT (status = 'completed')
)
SELECT rule_id, action, handled FROM due WHERE failing > 0""")
def dq_actions(spark, sf_dir):
    results = quality.evaluate(sales(spark, sf_dir), STRICT_RULES, domain.PIPELINE_ID, "silver", RUN_DAY)
    return quality.actions_due(results, STRICT_RULES).select("rule_id", "action", "handled")


RULE_DOCUMENT = {
    "quality_profile": {"name": "strict", "scope": ["silver"]},
    "rules": [
        {"rule_id": "POSITIVE", "type": "validity", "condition": {"sql": "quantity > 0"}},
        {"rule_id": "PRICED", "type": "completeness", "target": {"column": "unit_price_brl"}},
    ],
}


@query(f"""
WITH {SALES_SQL}, worst AS (
  SELECT CASE WHEN COUNT(*) FILTER (WHERE NOT (quantity > 0) OR unit_price_brl IS NULL) > 0 THEN 'ERROR' ELSE 'PASS' END
         AS status FROM sales
)
SELECT 'bronze' AS layer, 0 AS rules, 'PASS' AS overall_status, false AS abort, false AS abort_partial
UNION ALL SELECT 'silver', 2, status, status = 'ERROR', false FROM worst
UNION ALL SELECT 'gold', 0, 'PASS', false, false""")
def dq_scope_and_abort(spark, sf_dir):
    """Rules apply to the layers of their profile; an ERROR stops a run unless partial success will do."""
    rows = sales(spark, sf_dir)
    decisions = []
    for layer in governance.LAYERS:
        rules = quality.rules_for(RULE_DOCUMENT, layer)
        results = quality.run_rules(rows, rules, domain.PIPELINE_ID, layer, RUN_DAY)
        decisions.append(
            (
                layer,
                len(rules),
                quality.overall_status(results),
                quality.must_abort(results, rules),
                quality.must_abort(results, rules, allow_partial_success=True),
            )
        )
    return spark.createDataFrame(
        decisions, "layer string, rules int, overall_status string, abort boolean, abort_partial boolean"
    )


# --- Contract --------------------------------------------------------------------------------


def raw_sales(spark, sf_dir) -> DataFrame:
    """Landing rows as text, with cells that do not parse."""
    rows = sales(spark, sf_dir)
    text = rows.select(*(F.col(name).cast("string").alias(name) for name in rows.columns))
    return text.withColumns(
        {
            "quantity": F.when(F.col("quantity") == "13", "n/a").otherwise(F.col("quantity")),
            "unit_price_brl": F.when(F.col("status") == "shipped", F.concat("unit_price_brl", F.lit(" BRL"))).otherwise(
                F.col("unit_price_brl")
            ),
            "order_timestamp": F.when(F.col("quantity") == "7", "yesterday").otherwise(F.col("order_timestamp")),
        }
    )


RAW_SQL = f"""{SALES_SQL},
raw AS (
  SELECT order_id, product_id, CASE WHEN quantity = 13 THEN 'n/a' ELSE CAST(quantity AS VARCHAR) END AS quantity,
         CASE WHEN status = 'shipped' THEN concat(CAST(unit_price_brl AS VARCHAR), ' BRL')
              ELSE CAST(unit_price_brl AS VARCHAR) END AS unit_price_brl,
         CASE WHEN quantity = 7 THEN 'yesterday' ELSE CAST(order_timestamp AS VARCHAR) END AS order_timestamp,
         customer_email, status
  FROM sales
)"""


def _check_sql(check: str, subject: str, failing: str, source: str, threshold: float = 100.0, severity: str = "") -> str:
    share = f"CAST(COUNT(*) - COUNT(*) FILTER (WHERE {failing}) AS DOUBLE) / CAST(COUNT(*) AS DOUBLE) * 100"
    return f"""SELECT '{check}' AS check_name, '{subject}' AS subject, '{severity}' AS severity, COUNT(*) AS total_records,
       COUNT(*) FILTER (WHERE {failing}) AS failing_records, {share} AS success_percentage, {share} >= {threshold} AS conforms
FROM {source}"""


LOST = {
    "order_id": "VARCHAR",
    "product_id": "VARCHAR",
    "quantity": "INTEGER",
    "unit_price_brl": "DECIMAL(18,2)",
    "order_timestamp": "TIMESTAMP",
    "customer_email": "VARCHAR",
    "status": "VARCHAR",
}


@query(
    f"WITH {RAW_SQL}\n"
    + "\nUNION ALL\n".join(
        _check_sql("type", name, f"{name} IS NOT NULL AND TRY_CAST({name} AS {kind}) IS NULL", "raw")
        for name, kind in LOST.items()
    )
)
def contract_types(spark, sf_dir):
    return contracts.conformance(raw_sales(spark, sf_dir), domain.CONTRACT, ["type"])


@query(
    f"WITH {SALES_SQL}\n"
    + "\nUNION ALL\n".join(
        _check_sql("not_null", name, f"{name} IS NULL", "sales")
        for name in ("order_id", "product_id", "quantity", "order_timestamp", "status")
    )
)
def contract_not_null(spark, sf_dir):
    return contracts.conformance(sales(spark, sf_dir), domain.CONTRACT, ["not_null"])


@query(f"WITH {SALES_SQL} SELECT order_id, COUNT(*) AS occurrences FROM sales GROUP BY 1 HAVING COUNT(*) > 1")
def contract_pk(spark, sf_dir):
    return contracts.primary_key_violations(sales(spark, sf_dir), domain.CONTRACT)


@query(f"""
WITH {SILVER_SQL}, late AS (
  SELECT order_id, quantity, unit_price_usd, CAST(quantity * unit_price_brl / 5.0 AS DECIMAL(18,2)) AS total_value_usd
  FROM silver
)
SELECT order_id, quantity, CAST(total_value_usd AS DOUBLE) AS total_value_usd, 'total_value_usd' AS field,
       CAST(CAST(quantity * unit_price_usd AS DECIMAL(18,2)) AS DOUBLE) AS expected
FROM late WHERE total_value_usd IS DISTINCT FROM CAST(quantity * unit_price_usd AS DECIMAL(18,2))""")
def contract_calculated(spark, sf_dir):
    """Totals rounded once, after the division, against the formula on the rounded price."""
    late = (F.col("quantity") * F.col("unit_price_brl") / F.lit(5.0).cast("decimal(2,1)")).cast("decimal(18,2)")
    rows = silver(spark, sf_dir).withColumn("total_value_usd", late)
    found = contracts.calculated_violations(rows, domain.CONTRACT)
    return shown(found.select("order_id", "quantity", "total_value_usd", "field", "expected"))


@query(
    f"WITH {SALES_SQL}\n"
    + "\nUNION ALL\n".join(
        _check_sql("completeness", name, f"{name} IS NULL", "sales", 99.5) for name in domain.LANDING_COLUMNS
    )
)
def contract_completeness(spark, sf_dir):
    return contracts.conformance(sales(spark, sf_dir), domain.CONTRACT, ["completeness"])


@query(
    f"WITH {SALES_SQL}\n"
    + "\nUNION ALL\n".join(
        [
            _check_sql("custom", "positive_quantity", "NOT (quantity > 0)", "sales", severity="critical"),
            _check_sql(
                "custom",
                "valid_price",
                "NOT (unit_price_brl IS NOT NULL AND unit_price_brl >= 0)",
                "sales",
                severity="critical",
            ),
        ]
    )
)
def contract_custom(spark, sf_dir):
    return contracts.conformance(sales(spark, sf_dir), domain.CONTRACT, ["custom"])


@query("""
SELECT epoch_us(MAX(ts)) AS latest_us,
       CAST(floor((epoch_us(TIMESTAMP '2024-01-31 12:00:00') // 1000000 - epoch_us(MAX(ts)) // 1000000) / 60) AS BIGINT) AS latency_minutes,
       (epoch_us(TIMESTAMP '2024-01-31 12:00:00') // 1000000 - epoch_us(MAX(ts)) // 1000000) <= 1440 * 60 AS fresh
FROM events""")
def contract_freshness(spark, sf_dir):
    found = contracts.freshness(
        table(spark, sf_dir, "events"), "ts", "2024-01-31 12:00:00", domain.CONTRACT.max_latency_minutes
    )
    return found.select(F.unix_micros("latest").alias("latest_us"), "latency_minutes", "fresh")


@query("""
WITH loads AS (
  SELECT DISTINCT user_id, CAST(floor(epoch(ts) / 21600) * 21600 AS BIGINT) AS load FROM events
), gaps AS (
  SELECT user_id, load, LAG(load) OVER (PARTITION BY user_id ORDER BY load) AS previous FROM loads
)
SELECT user_id, load AS loaded_s, previous AS previous_s, CAST((load - previous) // 3600 AS BIGINT) AS gap_hours
FROM gaps WHERE load - previous > 21600""")
def contract_load_gaps(spark, sf_dir):
    """For each user, intervals of six hours that follow their predecessor with a gap."""
    found = contracts.load_gaps(table(spark, sf_dir, "events"), "ts", 6, by=["user_id"])
    return found.select(
        "user_id", F.unix_seconds("loaded_at").alias("loaded_s"), F.unix_seconds("previous_at").alias("previous_s"), "gap_hours"
    )


# --- Governance ------------------------------------------------------------------------------

SUPPORT = governance.RolePolicy("support", layers=("silver",), masks=(("customer_email", "hash"), ("not_there", "hash")))


@query(f"""
WITH {SILVER_SQL}
SELECT order_id, product_id, quantity, sha256(customer_email) AS customer_email,
       CAST(total_value_usd AS DOUBLE) AS total_value_usd
FROM silver""")
def mask_role_view(spark, sf_dir):
    rows = governance.role_view(silver(spark, sf_dir), "silver", [*domain.GOVERNANCE.roles, SUPPORT], "support")
    return shown(rows.select("order_id", "product_id", "quantity", "customer_email", "total_value_usd"))


@query("SELECT event_id, CAST(ts AS DATE) AS event_date FROM events WHERE CAST(ts AS DATE) >= DATE '2024-01-15'")
def retention_keep(spark, sf_dir):
    """Bronze keeps 30 days: expired day folders are dropped, not rewritten."""
    path = scratch_dir(spark, "retention")
    rows = table(spark, sf_dir, "events").withColumn("event_date", F.to_date("ts"))
    lake.overwrite_partitions(rows, path, ["event_date"])
    governance.drop_expired(spark, path, "event_date", domain.GOVERNANCE.retention["bronze"], date(2024, 2, 14))
    return spark.read.parquet(path).select("event_id", "event_date")


@query("SELECT event_id, CAST(ts AS DATE) AS event_date FROM events WHERE CAST(ts AS DATE) >= DATE '2024-01-15'")
def retention_filter(spark, sf_dir):
    """The same rule as a filter, for tables that are not partitioned by day."""
    rows = table(spark, sf_dir, "events").withColumn("event_date", F.to_date("ts"))
    kept = governance.retained(rows, F.col("event_date"), domain.GOVERNANCE.retention["bronze"], date(2024, 2, 14))
    return kept.select("event_id", "event_date")


@query(f"""
WITH {EVENT_GOLD_SQL}
SELECT CASE WHEN order_date < DATE '2024-01-15' THEN 'archive' ELSE 'table' END AS place,
       product_id, order_date, total_quantity
FROM event_gold""")
def retention_archive(spark, sf_dir):
    """Gold keeps five years and moves older dates to the archive."""
    path, archive = scratch_dir(spark, "gold-live"), scratch_dir(spark, "gold-archive")
    lake.overwrite_partitions(event_gold(spark, sf_dir), path, ["order_date"])
    keep = domain.GOVERNANCE.retention["gold"]
    governance.archive_expired(spark, path, archive, "order_date", keep, date(2029, 1, 15))
    columns = ["place", "product_id", "order_date", "total_quantity"]
    live = spark.read.parquet(path).withColumn("place", F.lit("table"))
    return live.select(*columns).unionByName(spark.read.parquet(archive).withColumn("place", F.lit("archive")).select(*columns))


def subjects(spark, sf_dir) -> DataFrame:
    """Customers who asked to be forgotten: here, those in debt."""
    debtors = table(spark, sf_dir, "customer").where(F.col("c_acctbal") < 0)
    return debtors.select(F.concat("c_name", F.lit("@example.com")).alias("customer_email"))


ERASED = "NOT EXISTS (SELECT 1 FROM customer WHERE c_acctbal < 0 AND concat(c_name, '@example.com') = customer_email)"


@query(f"WITH {SALES_SQL} SELECT {SALES_OUT} FROM sales WHERE {ERASED}")
def erase_subjects(spark, sf_dir):
    return sales_out(governance.erase(sales(spark, sf_dir), subjects(spark, sf_dir), "customer_email"))


@query(f"""
WITH {SALES_SQL}
SELECT order_id, quantity, customer_email, CAST(date_trunc('month', order_timestamp) AS DATE) AS order_month
FROM sales WHERE {ERASED}""")
def erase_subjects_from_table(spark, sf_dir):
    """The same on a stored table: only the months with rows to erase are rewritten."""
    path = scratch_dir(spark, "erasure")
    month = F.trunc(F.to_date("order_timestamp"), "month")
    lake.overwrite_partitions(sales(spark, sf_dir).withColumn("order_month", month), path, ["order_month"])
    governance.erase_from_table(spark, path, subjects(spark, sf_dir), "customer_email")
    return spark.read.parquet(path).select("order_id", "quantity", "customer_email", "order_month")


# --- Run log ---------------------------------------------------------------------------------

# Event types stand in for the statuses of step events, users for executions.
STATUS_OF = {"signup": "STARTING", "purchase": "SUCCEEDED", "error": "FAILED", "view": "INFO", "click": "WARNING"}
LOG_SQL = """
log AS (
  SELECT lpad(CAST(event_id AS VARCHAR), 19, '0') AS log_id, concat('run_', CAST(user_id AS VARCHAR)) AS execution_id,
         concat('step_', CAST(event_id % 7 AS VARCHAR)) AS step_name,
         CASE event_type WHEN 'signup' THEN 'STARTING' WHEN 'purchase' THEN 'SUCCEEDED' WHEN 'error' THEN 'FAILED'
              WHEN 'view' THEN 'INFO' ELSE 'WARNING' END AS status,
         ts
  FROM events
)"""


def _log_events(spark, sf_dir) -> DataFrame:
    status = F.lit("WARNING")
    for kind, name in STATUS_OF.items():
        status = F.when(F.col("event_type") == kind, name).otherwise(status)
    return table(spark, sf_dir, "events").select(
        F.lpad(F.col("event_id").cast("string"), 19, "0").alias("log_id"),
        F.lit(domain.PIPELINE_ID).alias("pipeline_id"),
        F.concat(F.lit("run_"), "user_id").alias("execution_id"),
        F.concat(F.lit("step_"), F.col("event_id") % 7).alias("step_name"),
        F.lit(domain.DOMAIN).alias("domain"),
        status.alias("status"),
        F.col("ts").cast("timestamp").alias("timestamp_utc"),
        F.col("props").alias("details"),
        F.lit("local").alias("environment"),
        F.lit(domain.VERSION).alias("pipeline_version"),
    )


@query(f"""
WITH {LOG_SQL}
SELECT CAST(ts AS DATE) AS log_date, status, COUNT(*) AS events, COUNT(DISTINCT execution_id) AS executions
FROM log GROUP BY 1, 2""")
def run_log_append(spark, sf_dir):
    """Events appended in two batches, read back by day and status."""
    path = scratch_dir(spark, "run-log")
    rows = _log_events(spark, sf_dir)
    failed = F.col("status") == "FAILED"
    for batch in (rows.where(failed), rows.where(~failed)):
        runlog.append_events(batch, path)
    return (
        spark.read.parquet(path)
        .groupBy(F.to_date("timestamp_utc").alias("log_date"), "status")
        .agg(F.count(F.lit(1)).alias("events"), F.count_distinct("execution_id").alias("executions"))
    )


@query(f"""
WITH {LOG_SQL}
SELECT execution_id, epoch_us(MIN(ts)) AS started_us, epoch_us(MAX(ts)) AS ended_us, COUNT(*) AS events,
       COUNT(*) FILTER (WHERE status = 'STARTING') AS starting, COUNT(*) FILTER (WHERE status = 'SUCCEEDED') AS succeeded,
       COUNT(*) FILTER (WHERE status = 'FAILED') AS failed, COUNT(*) FILTER (WHERE status = 'INFO') AS info,
       COUNT(*) FILTER (WHERE status = 'WARNING') AS warning,
       (array_agg(status ORDER BY ts DESC, step_name DESC, status DESC))[1] AS last_status,
       (array_agg(step_name ORDER BY ts, step_name) FILTER (WHERE status = 'FAILED'))[1] AS failed_step,
       epoch_us(MAX(ts)) // 1000000 - epoch_us(MIN(ts)) // 1000000 AS duration_seconds
FROM log GROUP BY execution_id""")
def run_summary(spark, sf_dir):
    found = runlog.run_summary(_log_events(spark, sf_dir))
    micros = {"started_us": F.unix_micros("started_at"), "ended_us": F.unix_micros("ended_at")}
    return found.withColumns(micros).drop("started_at", "ended_at")


# --- The daily job, with late rows -----------------------------------------------------------


def _sales_job(root: str, landing_template: str) -> DailyJob:
    return DailyJob(
        pipeline_id=domain.PIPELINE_ID,
        domain=domain.DOMAIN,
        contract=domain.CONTRACT,
        steps=domain.STEPS,
        rules=domain.RULES,
        landing=landing_template,
        root=root,
    )


def _loaded_lake(spark, sf_dir) -> DailyJob:
    """Two loads: rows of the evening arrive with the second, for dates that gold already has."""
    root = scratch_dir(spark, "daily")
    job = _sales_job(root, root + "/landing/{yyyy}/{MM}/{dd}/")
    rows = event_sales(spark, sf_dir)
    late = F.hour("order_timestamp") >= 18
    for day, batch in ((date(2024, 1, 31), rows.where(~late)), (date(2024, 2, 1), rows.where(late))):
        batch.write.option("header", True).csv(landing.landing_path(job.landing, day))
        job.run(spark, day, datetime(2024, 2, 14, 12))
    return job


@query(f"""
WITH {EVENT_GOLD_SQL}
SELECT product_id, order_date, total_quantity,
       CAST(total_aggregated_value_usd AS DOUBLE) AS total_aggregated_value_usd
FROM event_gold""")
def daily_load_late_rows(spark, sf_dir):
    """Landing, bronze, checks, silver and gold by the daily job; late rows add to their date."""
    job = _loaded_lake(spark, sf_dir)
    columns = ["product_id", "order_date", "total_quantity", "total_aggregated_value_usd"]
    return shown(job.gold(spark).select(*columns))


@query(f"""
WITH {EVENT_GOLD_SQL}
SELECT 'bronze' AS table_name, COUNT(*) AS row_count, CAST(MAX(ts) AS DATE) AS last_date FROM events
UNION ALL SELECT 'silver', COUNT(*), MAX(order_date) FROM event_silver
UNION ALL SELECT 'gold', COUNT(*), MAX(order_date) FROM event_gold""")
def daily_load_tables(spark, sf_dir):
    job = _loaded_lake(spark, sf_dir)
    bronze = spark.read.parquet(job.path("bronze"))
    return (
        lake.table_metrics(bronze, "bronze", "order_timestamp")
        .unionByName(lake.table_metrics(job.silver(spark), "silver", "order_timestamp"))
        .unionByName(lake.table_metrics(job.gold(spark), "gold", "order_date"))
    )


def _backfilled_lake(spark, sf_dir) -> DailyJob:
    """Thirty-one daily loads in one pass; rows of the evening come with the next day's files."""
    root = scratch_dir(spark, "backfill")
    rows = event_sales(spark, sf_dir)
    arrival = F.col("order_timestamp") + F.expr("INTERVAL 6 HOURS")
    job = _sales_job(root, _written_landing(rows, arrival, "csv", root + "/landing", DAILY))
    days = _days_of(rows.select(arrival.alias("arrival")), "arrival")
    run_days(job, spark, days, datetime(2024, 2, 14, 12))
    return job


@query(f"""
WITH {EVENT_GOLD_SQL}
SELECT product_id, order_date, total_quantity,
       CAST(total_aggregated_value_usd AS DOUBLE) AS total_aggregated_value_usd
FROM event_gold""")
def daily_backfill_late_rows(spark, sf_dir):
    job = _backfilled_lake(spark, sf_dir)
    columns = ["product_id", "order_date", "total_quantity", "total_aggregated_value_usd"]
    return shown(job.gold(spark).select(*columns))


# Loads whose quality differs by day: on one day of three a tenth of the quantities is negative, on one a few, on one none.
UNEVEN_SQL = """
uneven AS (
  SELECT CAST(ts + INTERVAL 6 HOUR AS DATE) AS processing_date, concat('PROD_', CAST(user_id AS VARCHAR)) AS product_id,
         CAST(ts AS DATE) AS order_date, event_type, CAST(value AS DECIMAL(18,2)) AS unit_price_brl,
         CASE WHEN day(ts + INTERVAL 6 HOUR) % 3 = 1 AND event_id % 10 = 0 OR day(ts + INTERVAL 6 HOUR) % 3 = 2 AND event_id % 40 = 0
              THEN -1 ELSE CAST(event_id % 20 + 1 AS INTEGER) END AS quantity
  FROM events
), counted AS (
  SELECT processing_date, COUNT(*) AS total, COUNT(*) FILTER (WHERE quantity <= 0) AS failing FROM uneven GROUP BY 1
), checked AS (
  SELECT processing_date, rule_id, total, CASE WHEN rule_id = 'DQ-SALES-001' THEN failing ELSE 0 END AS failing
  FROM counted CROSS JOIN (VALUES ('DQ-SALES-001'), ('DQ-SALES-002'), ('DQ-SALES-003')) AS rules(rule_id)
), statuses AS (
  SELECT *, CASE WHEN CAST(total - failing AS DOUBLE) / total * 100 < 95 THEN 'ERROR'
                 WHEN CAST(total - failing AS DOUBLE) / total * 100 < 99 THEN 'WARNING' ELSE 'PASS' END AS status
  FROM checked
), days AS (
  SELECT processing_date, CASE WHEN COUNT(*) FILTER (WHERE status = 'ERROR') > 0 THEN 'FAILED'
         WHEN COUNT(*) FILTER (WHERE status = 'WARNING') > 0 THEN 'WARNING' ELSE 'SUCCEEDED' END AS outcome
  FROM statuses GROUP BY 1
)"""


def _uneven_backfill(spark, sf_dir) -> DailyJob:
    """The same loads with quantities of uneven quality, and two days asked for that have no files."""
    root = scratch_dir(spark, "uneven")
    arrival = F.col("order_timestamp") + F.expr("INTERVAL 6 HOURS")
    number = F.substring("order_id", 4, 20).cast("long")
    third = F.dayofmonth(arrival) % 3
    bad = ((third == 1) & (number % 10 == 0)) | ((third == 2) & (number % 40 == 0))
    rows = event_sales(spark, sf_dir).withColumn("quantity", F.when(bad, -1).otherwise(F.col("quantity")))
    job = _sales_job(root, _written_landing(rows, arrival, "csv", root + "/landing", DAILY))
    days = _days_of(rows.select(arrival.alias("arrival")), "arrival")
    days = [days[0] - timedelta(days=1), *days, days[-1] + timedelta(days=1)]
    run_days(job, spark, days, datetime(2024, 2, 14, 12))
    return job


@query(f"""
WITH {UNEVEN_SQL}
SELECT processing_date, rule_id, status, total AS total_records, CAST(failing AS BIGINT) AS failing_records FROM statuses""")
def daily_backfill_checks(spark, sf_dir):
    job = _uneven_backfill(spark, sf_dir)
    return spark.read.parquet(job.path("dq_results")).select(
        "processing_date", "rule_id", "status", "total_records", "failing_records"
    )


@query(f"""
WITH {UNEVEN_SQL}
SELECT 'gold' AS place, product_id, order_date, CAST(SUM(quantity) AS BIGINT) AS pieces
FROM uneven JOIN days USING (processing_date) WHERE outcome <> 'FAILED' AND event_type = 'purchase' GROUP BY 2, 3
UNION ALL
SELECT 'quarantine', product_id, order_date, CAST(SUM(quantity) AS BIGINT)
FROM uneven JOIN days USING (processing_date) WHERE outcome = 'FAILED' AND quantity <= 0 GROUP BY 2, 3""")
def daily_backfill_blocked(spark, sf_dir):
    """Days that fail their check stay out of silver and gold, and their bad rows are in quarantine."""
    job = _uneven_backfill(spark, sf_dir)
    bad = spark.read.parquet(job.path("quarantine")).withColumn("order_date", F.to_date("order_timestamp"))
    bad = bad.groupBy(F.lit("quarantine").alias("place"), "product_id", "order_date").agg(F.sum("quantity").alias("pieces"))
    good = job.gold(spark).select(F.lit("gold").alias("place"), "product_id", "order_date", F.col("total_quantity").alias("pieces"))
    return good.unionByName(bad)


@query(f"""
WITH {UNEVEN_SQL}
SELECT 'PipelineStart' AS step_name, 'STARTING' AS status, 1 AS events
UNION ALL SELECT 'IngestBronze', 'SUCCEEDED', COUNT(*) FROM days
UNION ALL SELECT 'IngestBronze', 'FAILED', 2
UNION ALL SELECT 'DataQuality', outcome, COUNT(*) FROM days GROUP BY outcome
UNION ALL SELECT 'TransformSilver', 'SUCCEEDED', COUNT(*) FROM days WHERE outcome <> 'FAILED'
UNION ALL SELECT 'TransformGold', 'SUCCEEDED', 1
UNION ALL SELECT 'PipelineEnd', 'SUCCEEDED', 1""")
def daily_backfill_log(spark, sf_dir):
    """What the log tells of many days: an event per day and step, also of days that have no files."""
    events = spark.read.parquet(_uneven_backfill(spark, sf_dir).path("run_log"))
    return events.groupBy("step_name", "status").agg(F.count(F.lit(1)).alias("events"))


# --- Nothing is lost, governance of the lake, jobs from documents ----------------------------

FIRST_LOAD, SECOND_LOAD = date(2024, 1, 31), date(2024, 2, 1)
FLAWED_SQL = """
flawed AS (
  SELECT CASE WHEN hour(ts) < 18 THEN 1 ELSE 2 END AS load, event_type, concat('PROD_', CAST(user_id AS VARCHAR)) AS product_id,
         CASE WHEN event_id % 13 = 5 THEN NULL ELSE CAST(ts AS DATE) END AS order_date,
         event_id % 11 = 3 AS unparsed, CAST(value AS DECIMAL(18,2)) AS unit_price_brl,
         CASE WHEN event_id % 11 = 3 THEN NULL WHEN hour(ts) < 18 AND event_id % 400 = 1 OR hour(ts) >= 18 AND event_id % 7 = 1
              THEN -2 ELSE CAST(event_id % 20 + 1 AS INTEGER) END AS quantity
  FROM events
), shares AS (
  SELECT load, CAST(COUNT(*) FILTER (WHERE quantity <= 0) AS DOUBLE) / COUNT(*) AS share FROM flawed GROUP BY load
), judged AS (
  SELECT flawed.*, COALESCE(quantity <= 0, false) AND share > 0.05 AS quarantined FROM flawed JOIN shares USING (load)
), silver AS (
  SELECT *, CAST(quantity * CAST(unit_price_brl / 5.0 AS DECIMAL(18,2)) AS DECIMAL(18,2)) AS total
  FROM judged WHERE event_type = 'purchase' AND NOT quarantined
), found AS (
  SELECT 'bronze' AS place, CAST(NULL AS VARCHAR) AS product_id, CAST(NULL AS DATE) AS order_date, COUNT(*) AS number,
         CAST(NULL AS DOUBLE) AS total FROM flawed
  UNION ALL SELECT 'unparsed', NULL, NULL, COUNT(*), NULL FROM flawed WHERE unparsed
  UNION ALL SELECT 'quarantine', NULL, NULL, COUNT(*), NULL FROM judged WHERE quarantined
  UNION ALL SELECT 'silver', NULL, NULL, COUNT(*), NULL FROM silver
  UNION ALL SELECT 'lost quantities', NULL, NULL, COUNT(*) FILTER (WHERE unparsed), NULL FROM flawed
  UNION ALL SELECT 'gold', product_id, order_date, CAST(SUM(quantity) AS BIGINT), CAST(CAST(SUM(total) AS DECIMAL(20,2)) AS DOUBLE)
  FROM silver GROUP BY product_id, order_date
)"""


def _flawed_landing(spark, sf_dir, job: DailyJob) -> None:
    """Two loads with quantities that are no numbers, moments that are missing, and negative quantities: few, then many."""
    number = F.substring("order_id", 4, 20).cast("long")
    early = F.hour("order_timestamp") < 18
    negative = (early & (number % 400 == 1)) | (~early & (number % 7 == 1))
    text = F.when(number % 11 == 3, "n/a").when(negative, "-2").otherwise(F.col("quantity").cast("string"))
    moment = F.when(number % 13 == 5, F.lit(None).cast("timestamp")).otherwise(F.col("order_timestamp"))
    rows = event_sales(spark, sf_dir).withColumn("early", early).withColumn("quantity", text).withColumn("order_timestamp", moment)
    for day, batch in ((FIRST_LOAD, rows.where("early")), (SECOND_LOAD, rows.where("NOT early"))):
        batch.drop("early").write.option("header", True).csv(landing.landing_path(job.landing, day))


def _flawed_result(spark, job: DailyJob) -> DataFrame:
    def count(name: str, rows: DataFrame) -> DataFrame:
        none = [F.lit(None).cast("string").alias("product_id"), F.lit(None).cast("date").alias("order_date")]
        return rows.agg(F.count(F.lit(1)).alias("number")).select(F.lit(name).alias("place"), *none, "number", F.lit(None).cast("double").alias("total"))

    gold = job.gold(spark).select(
        F.lit("gold").alias("place"), "product_id", "order_date", F.col("total_quantity").alias("number"),
        F.col("total_aggregated_value_usd").cast("double").alias("total"),
    )
    lost = spark.read.parquet(job.path("contract_results")).where("check_name = 'type' AND subject = 'quantity'")
    lost = lost.agg(F.sum("failing_records").alias("number")).select(
        F.lit("lost quantities").alias("place"), F.lit(None).cast("string").alias("product_id"),
        F.lit(None).cast("date").alias("order_date"), "number", F.lit(None).cast("double").alias("total"),
    )
    found = gold.unionByName(lost)
    for name in ("bronze", "unparsed", "quarantine", "silver"):
        found = found.unionByName(count(name, spark.read.parquet(job.path(name))))
    return found


@query(f"WITH {FLAWED_SQL} SELECT mode, found.* FROM found CROSS JOIN (VALUES ('day by day'), ('together')) AS modes(mode)")
def daily_lossless(spark, sf_dir):
    """Every row of bronze is in silver, filtered, or quarantined and dropped; gold is the chain over silver, NULL date included."""
    root = scratch_dir(spark, "lossless")
    job = replace(
        _sales_job(f"{root}/one", root + "/landing/{yyyy}/{MM}/{dd}/"), allow_partial_success=True, drop_quarantined=True
    )
    _flawed_landing(spark, sf_dir, job)
    as_of = datetime(2024, 2, 14, 12)
    for day in (FIRST_LOAD, SECOND_LOAD):
        job.run(spark, day, as_of, skip_check=True)
    together = replace(job, root=f"{root}/many")
    run_days(together, spark, [FIRST_LOAD, SECOND_LOAD], as_of, skip_check=True)
    one = _flawed_result(spark, job).withColumn("mode", F.lit("day by day"))
    return one.unionByName(_flawed_result(spark, together).withColumn("mode", F.lit("together")))


def _lake_sums(spark, job: DailyJob, tables: dict[str, str]) -> DataFrame:
    """Rows and pieces of some tables; `tables` names the column of pieces in each."""
    found = None
    for name, pieces in tables.items():
        rows = spark.read.parquet(job.path(name))
        sums = rows.agg(F.count(F.lit(1)).alias("number"), F.sum(pieces).cast("long").alias("pieces"))
        sums = sums.select(F.lit(name).alias("table_name"), "number", "pieces")
        found = sums if found is None else found.unionByName(sums)
    return found


def _lake_sums_sql(**tables: str) -> str:
    """The same over `lake`, which has every event's quantity, and over gold; the values are conditions."""
    parts = [
        f"SELECT '{name}' AS table_name, COUNT(*) AS number, CAST(SUM(quantity) AS BIGINT) AS pieces FROM lake WHERE {where}"
        for name, where in tables.items()
    ]
    return " UNION ALL ".join(parts)


LAKE_SQL = """
lake AS (
  SELECT user_id, event_type, hour(ts) >= 18 AS late, CAST(ts AS DATE) AS order_date, CAST(event_id % 20 + 1 AS INTEGER) AS quantity
  FROM events
)"""
FORGOTTEN = "user_id % 10 <> 0"


@query(f"""
WITH {LAKE_SQL}
{_lake_sums_sql(bronze=FORGOTTEN, silver=FORGOTTEN + " AND event_type = 'purchase'")}
UNION ALL
SELECT 'gold', COUNT(*), CAST(SUM(pieces) AS BIGINT) FROM (
  SELECT user_id, order_date, SUM(quantity) AS pieces FROM lake WHERE {FORGOTTEN} AND event_type = 'purchase' GROUP BY 1, 2)""")
def erase_from_lake(spark, sf_dir):
    """Erasure from every table of a job, in its own layout; a later refresh of gold changes nothing more."""
    job = _loaded_lake(spark, sf_dir)
    users = table(spark, sf_dir, "events").where("user_id % 10 = 0").select("user_id").distinct()
    emails = users.select(F.concat(F.lit("user"), "user_id", F.lit("@example.com")).alias("customer_email"))
    erase_everywhere(job, spark, emails, "customer_email")
    before = job.gold(spark).count()
    job.refresh_gold(spark)
    assert job.gold(spark).count() == before
    return _lake_sums(spark, job, {"bronze": "quantity", "silver": "quantity", "gold": "total_quantity"})


@query(f"""
WITH {LAKE_SQL}
{_lake_sums_sql(bronze="late", silver="late AND event_type = 'purchase'", silver_archive="NOT late AND event_type = 'purchase'")}
UNION ALL
SELECT 'gold', COUNT(*), CAST(SUM(pieces) AS BIGINT) FROM (
  SELECT user_id, order_date, SUM(quantity) AS pieces FROM lake WHERE event_type = 'purchase' GROUP BY 1, 2)""")
def retention_lake(spark, sf_dir):
    """Bronze days are deleted, silver days archived; gold still counts what the archive holds."""
    job = _loaded_lake(spark, sf_dir)
    policies = {
        "bronze": domain.GOVERNANCE.retention["bronze"],
        "silver": governance.Retention("30d", "archive_local"),
        "gold": domain.GOVERNANCE.retention["gold"],
    }
    retain_lake(job, spark, policies, date(2024, 3, 2))
    job.refresh_gold(spark)
    tables = {"bronze": "quantity", "silver": "quantity", "silver_archive": "quantity", "gold": "total_quantity"}
    return _lake_sums(spark, job, tables)


@query(f"""
WITH {LAKE_SQL}
{_lake_sums_sql(silver_archive="event_type = 'purchase'")}
UNION ALL
SELECT 'gold', COUNT(*), CAST(SUM(pieces) AS BIGINT) FROM (
  SELECT user_id, order_date, SUM(quantity) AS pieces FROM lake WHERE event_type = 'purchase' GROUP BY 1, 2)""")
def retention_archive_late_rows(spark, sf_dir):
    """Archive, late rows for the archived dates, archive again: the archive has them all, and gold the full sums."""
    root = scratch_dir(spark, "archive")
    job = _sales_job(root, root + "/landing/{yyyy}/{MM}/{dd}/")
    rows = event_sales(spark, sf_dir)
    late = F.hour("order_timestamp") >= 18
    silver_only = {"silver": governance.Retention("1d", "archive_local")}
    for day, batch in ((FIRST_LOAD, rows.where(~late)), (SECOND_LOAD, rows.where(late))):
        batch.write.option("header", True).csv(landing.landing_path(job.landing, day))
        job.run(spark, day, datetime(2024, 2, 14, 12))
        retain_lake(job, spark, silver_only, date(2024, 2, 14))
    return _lake_sums(spark, job, {"silver_archive": "quantity", "gold": "total_quantity"})


def _template(sql: str, kind: str = "sql") -> dict:
    return {"logic": {kind: sql}}


TEMPLATES = {
    "only": _template("FROM {input_view_or_df} |> WHERE `{state}` IN ({wanted})"),
    "exchange": _template("SELECT i.*, round(i.`{price}` * {share}, 2) AS `{exchanged}` FROM {input_view_or_df} AS i"),
    "value": _template("SELECT i.`{price}` * i.`{pieces}` AS `{value}`, i.* FROM {input_view_or_df} AS i"),
    "daily": _template(
        "SELECT {group_by_clause}, {aggregation_clause} FROM "
        "(SELECT date(i.`{timestamp_column_for_date}`) AS order_date, i.* FROM {input_view_or_df} AS i "
        "WHERE i.`{timestamp_column_for_date}` IS NOT NULL) AS dated GROUP BY ALL",
        "sql_template",
    ),
}


def _documents(place: str) -> tuple[dict, dict, dict]:
    """Definition, contract and rules of the sales job, as documents."""
    steps = [
        ("only", "silver", {"state": "status", "wanted": "completed"}),
        ("exchange", "silver", {"price": "unit_price_brl", "share": 0.2, "exchanged": "unit_price_usd"}),
        ("value", "silver", {"pieces": "quantity", "price": "unit_price_usd", "value": "total_value_usd"}),
        ("daily", "gold", {
            "group_by_columns": ["product_id", "order_date"],
            "aggregation_specs": [
                {"source_column": "quantity", "function": "sum", "target_column": "total_quantity"},
                {"source_column": "total_value_usd", "function": "sum", "target_column": "total_aggregated_value_usd"},
            ],
            "timestamp_column_for_date": "order_timestamp",
        }),
    ]
    definition = {
        "metadata": {"pipeline_id": "documented", "domain": "sales", "version": "2"},
        "source_config": {"bronze": {"location": place, "format": "csv"}},
        "processing": {
            "transformations": [{"template_id": t, "target_layer_step": layer, "parameters": p} for t, layer, p in steps]
        },
    }
    columns = [
        {"name": c.name, "data_type": c.type, "constraints": ["not_null"] if c.not_null else []} for c in domain.CONTRACT.columns
    ]
    contract = {"schema_specification": {"structural": {"columns": columns}}}
    rules = {
        "quality_profile": {"scope": ["silver"]},
        "rules": [{"rule_id": "POSITIVE", "type": "validity", "condition": {"sql": "quantity > 0"}}],
    }
    return definition, contract, rules


@query(f"""
WITH {EVENT_GOLD_SQL}
SELECT product_id, order_date, total_quantity, CAST(total_aggregated_value_usd AS DOUBLE) AS total_aggregated_value_usd,
       lower(typeof(total_aggregated_value_usd)) AS stored_type
FROM event_gold""")
def daily_from_documents(spark, sf_dir):
    """The daily job as its documents describe it, types of the contract included."""
    root = scratch_dir(spark, "documents")
    definition, contract, rules = _documents(root + "/landing/{yyyy}/{MM}/{dd}/")
    job = job_from_documents(definition, contract, rules, TEMPLATES, domain.LAYER_COLUMNS, f"{root}/lake")
    event_sales(spark, sf_dir).write.option("header", True).csv(landing.landing_path(job.landing, FIRST_LOAD))
    job.run(spark, FIRST_LOAD, datetime(2024, 2, 14, 12))
    gold = job.gold(spark)
    kind = dict(gold.dtypes)["total_aggregated_value_usd"]
    return shown(gold.select("product_id", "order_date", "total_quantity", "total_aggregated_value_usd")).withColumn("stored_type", F.lit(kind))
