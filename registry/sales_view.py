"""Daily sales rows derived from the test tables, once in Spark and once as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The landing columns in contract types, one row per line item.

    Customers are joined to orders first, so that the line items, by far the largest table, are
    shuffled once only. Which side is broadcast, if any, is left to Spark's size check.
    """
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    customers = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("o_custkey"), F.concat("c_name", F.lit("@example.com")).alias("customer_email")
    )
    buyers = orders.join(customers, "o_custkey").withColumnRenamed("o_orderkey", "l_orderkey")
    mixed = F.col("l_orderkey") * 7 + F.col("l_linenumber")
    finished = F.col("o_orderstatus") == "F"
    quantity = F.col("l_quantity").cast("int")
    return (
        table(spark, sf_dir, "lineitem")
        .join(buyers, "l_orderkey")
        .select(
            F.concat(F.lit("ORD"), F.col("l_orderkey"), F.lit("-"), F.col("l_linenumber")).alias("order_id"),
            F.concat(F.lit("PROD_"), F.col("l_partkey")).alias("product_id"),
            F.when(finished & (mixed % 100 == 0), -quantity).otherwise(quantity).alias("quantity"),
            F.when(finished & (mixed % 200).isin(1, 2, 3), None)
            .when(finished & (mixed % 200 == 4), F.lit(0.0))
            .otherwise(F.col("l_extendedprice"))
            .cast("decimal(18,2)")
            .alias("unit_price_brl"),
            F.col("l_shipdate").cast("timestamp").alias("order_timestamp"),
            "customer_email",
            F.when(finished, "completed")
            .when(F.col("o_orderstatus") == "O", "pending")
            .otherwise("shipped")
            .alias("status"),
        )
    )


SALES_SQL = """
sales AS (
  SELECT concat('ORD', CAST(l_orderkey AS VARCHAR), '-', CAST(l_linenumber AS VARCHAR)) AS order_id,
         concat('PROD_', CAST(l_partkey AS VARCHAR)) AS product_id,
         CASE WHEN o_orderstatus = 'F' AND (l_orderkey * 7 + l_linenumber) % 100 = 0
              THEN -CAST(l_quantity AS INTEGER) ELSE CAST(l_quantity AS INTEGER) END AS quantity,
         CAST(CASE WHEN o_orderstatus = 'F' AND (l_orderkey * 7 + l_linenumber) % 200 IN (1, 2, 3) THEN NULL
              WHEN o_orderstatus = 'F' AND (l_orderkey * 7 + l_linenumber) % 200 = 4 THEN 0.0
              ELSE l_extendedprice END AS DECIMAL(18,2)) AS unit_price_brl,
         l_shipdate AS order_timestamp,
         concat(c_name, '@example.com') AS customer_email,
         CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'pending' ELSE 'shipped' END AS status
  FROM lineitem
  JOIN orders ON l_orderkey = o_orderkey
  JOIN customer ON o_custkey = c_custkey
)"""

SILVER_SQL = f"""{SALES_SQL},
priced AS (
  SELECT *, CAST(unit_price_brl / 5.0 AS DECIMAL(18,2)) AS unit_price_usd FROM sales WHERE status = 'completed'
),
silver AS (
  SELECT *, CAST(quantity * unit_price_usd AS DECIMAL(18,2)) AS total_value_usd FROM priced
)"""

GOLD_SQL = f"""{SILVER_SQL},
gold AS (
  SELECT product_id, CAST(order_timestamp AS DATE) AS order_date,
         CAST(SUM(quantity) AS BIGINT) AS total_quantity,
         CAST(SUM(total_value_usd) AS DECIMAL(20,2)) AS total_aggregated_value_usd
  FROM silver GROUP BY 1, 2
)"""
