"""Queries of the jobs that keep a lake in order: archives, erasure, late loads, history of keys, profiles."""

from __future__ import annotations

from dataclasses import replace
from datetime import date, datetime

from pyspark.sql import functions as F

from lakestrata.operators import governance, profiles
from lakestrata.operators.key_history import KeyHistory
from lakestrata.plans import sales as domain
from lakestrata.plans.stewardship import erase_from_lake as erase_everywhere
from lakestrata.plans.stewardship import retain_lake
from lakestrata.session import scratch_dir
from lakestrata.sources import lake
from lakestrata.sources.landing import landing_path
from registry.queries import EVENT_GOLD_SQL, FORGOTTEN, LAKE_SQL, _lake_sums, _lake_sums_sql, _sales_job, event_sales, query, shown
from registry.sales_view import table

LOADS = (date(2024, 1, 31), date(2024, 2, 1))
LOADED_AT = datetime(2024, 2, 14, 12)


def lake_of(spark, sf_dir, **settings):
    """Two loads: rows of the evening arrive with the second."""
    root = scratch_dir(spark, "upkeep")
    job = replace(_sales_job(root, root + "/landing/{yyyy}/{MM}/{dd}/"), **settings)
    rows = event_sales(spark, sf_dir)
    late = F.hour("order_timestamp") >= 18
    for day, batch in zip(LOADS, (rows.where(~late), rows.where(late))):
        batch.write.option("header", True).csv(landing_path(job.landing, day))
        job.run(spark, day, LOADED_AT)
    return job


@query("""
SELECT event_id, CAST(ts AS DATE) AS event_date, CASE WHEN day(ts) % 2 = 0 THEN value * 2 ELSE value END AS value
FROM events WHERE CAST(ts AS DATE) < DATE '2024-01-15'""")
def archive_settled_after_reload(spark, sf_dir):
    """An archive run dies after the copy, every second day is corrected by as many rows, and the next run archives again."""
    path, archive = scratch_dir(spark, "events"), scratch_dir(spark, "events-archive")
    events = table(spark, sf_dir, "events").select("event_id", F.to_date("ts").alias("event_date"), "value")
    lake.overwrite_partitions(events, path, ["event_date"])
    keep = governance.Retention("30d", "archive_local")
    governance.copy_expired(spark, path, archive, "event_date", keep, date(2024, 2, 14))
    corrected = events.where("day(event_date) % 2 = 0 AND event_date < DATE '2024-01-20'").withColumn("value", F.col("value") * 2)
    lake.overwrite_partitions(corrected, path, ["event_date"])
    governance.archive_expired(spark, path, archive, "event_date", keep, date(2024, 2, 14))
    return spark.read.parquet(archive).select("event_id", F.col("event_date").cast("date").alias("event_date"), "value")


ERASED_SQL = f"""
WITH {LAKE_SQL}
{_lake_sums_sql(bronze=FORGOTTEN + " AND late", bronze_archive=FORGOTTEN + " AND NOT late", silver=FORGOTTEN + " AND event_type = 'purchase'")}
UNION ALL
SELECT 'gold', COUNT(*), CAST(SUM(pieces) AS BIGINT) FROM (
  SELECT user_id, order_date, SUM(quantity) AS pieces FROM lake WHERE {FORGOTTEN} AND event_type = 'purchase' GROUP BY 1, 2)"""


def _erased(spark, sf_dir, job):
    """Bronze of the first load archived, every tenth user erased from all tables, the second load run again from its files."""
    retain_lake(job, spark, {"bronze": governance.Retention("14d", "archive_local")}, date(2024, 2, 15))
    users = table(spark, sf_dir, "events").where("user_id % 10 = 0").select("user_id").distinct()
    emails = users.select(F.concat(F.lit("user"), "user_id", F.lit("@example.com")).alias("customer_email"))
    erase_everywhere(job, spark, emails, "customer_email")
    job.run(spark, LOADS[1], LOADED_AT)
    return _lake_sums(spark, job, {"bronze": "quantity", "bronze_archive": "quantity", "silver": "quantity", "gold": "total_quantity"})


@query(ERASED_SQL)
def erase_from_archives(spark, sf_dir):
    return _erased(spark, sf_dir, lake_of(spark, sf_dir))


@query(ERASED_SQL)
def erase_indexed(spark, sf_dir):
    """The same with a subject index per partition and gold from states."""
    return _erased(spark, sf_dir, lake_of(spark, sf_dir, subject_key="customer_email", rollup=domain.DAILY_ROLLUP))


@query(f"""
WITH {EVENT_GOLD_SQL}
SELECT product_id, order_date, total_quantity,
       CAST(total_aggregated_value_usd AS DOUBLE) AS total_aggregated_value_usd
FROM event_gold""")
def gold_additive(spark, sf_dir):
    """Late rows merge into their dates from the states of each load."""
    job = lake_of(spark, sf_dir, rollup=domain.DAILY_ROLLUP)
    return shown(job.gold(spark).select("product_id", "order_date", "total_quantity", "total_aggregated_value_usd"))


KEYED_SQL = "keyed AS (SELECT concat(user_id, '-', CAST(floor(value) AS BIGINT)) AS ref, CAST(ts AS DATE) AS load_date FROM events)"


def keyed(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    ref = F.concat(F.col("user_id").cast("string"), F.lit("-"), F.floor("value").cast("string"))
    return events.select(ref.alias("ref"), F.to_date("ts").alias("load_date"))


@query(f"""
WITH {KEYED_SQL}
SELECT ref, COUNT(*) AS occurrences, COUNT(DISTINCT load_date) AS loads, MIN(load_date) AS first_load
FROM keyed WHERE ref IS NOT NULL GROUP BY 1 HAVING COUNT(*) > 1""")
def dq_unique_all_loads(spark, sf_dir):
    """Keys that are not unique over all load days, from the stored keys of each day."""
    history = KeyHistory(spark, scratch_dir(spark, "keys"), {"ref": "string"}, buckets=8)
    history.replace_all(keyed(spark, sf_dir))
    return history.repeated()


@query(f"""
WITH {KEYED_SQL}, last AS (SELECT MAX(load_date) AS day FROM keyed),
own AS (SELECT ref, COUNT(*) AS occurrences FROM keyed, last WHERE load_date = day AND ref IS NOT NULL GROUP BY 1),
others AS (SELECT ref, COUNT(*) AS elsewhere, MIN(load_date) AS first_load FROM keyed, last WHERE load_date < day AND ref IS NOT NULL GROUP BY 1)
SELECT ref, occurrences, COALESCE(elsewhere, 0) AS elsewhere, first_load FROM own LEFT JOIN others USING (ref)
WHERE occurrences > 1 OR elsewhere > 0""")
def dq_unique_across_loads(spark, sf_dir):
    """Keys of the last load that are not unique in it, or were loaded before."""
    rows = keyed(spark, sf_dir)
    last = rows.agg(F.max("load_date")).first()[0]
    history = KeyHistory(spark, scratch_dir(spark, "keys"), {"ref": "string"}, buckets=8)
    history.replace_all(rows.where(F.col("load_date") < F.lit(last)))
    return history.repeated_in(rows.where(F.col("load_date") == F.lit(last)), last)


PROFILED = ("event_id", "user_id", "event_type", "value")


@query("""
WITH part AS (SELECT * FROM events WHERE CAST(ts AS DATE) BETWEEN DATE '2024-01-08' AND DATE '2024-01-21')
SELECT 'event_id' AS column_name, COUNT(*) AS total, COUNT(*) - COUNT(event_id) AS nulls, MIN(event_id)::DOUBLE AS least_number, MAX(event_id)::DOUBLE AS greatest_number,
       NULL::VARCHAR AS least_text, NULL::VARCHAR AS greatest_text, TRUE AS distinct_near, TRUE AS median_near FROM part
UNION ALL SELECT 'user_id', COUNT(*), COUNT(*) - COUNT(user_id), MIN(user_id)::DOUBLE, MAX(user_id)::DOUBLE, NULL, NULL, TRUE, TRUE FROM part
UNION ALL SELECT 'event_type', COUNT(*), COUNT(*) - COUNT(event_type), NULL, NULL, MIN(event_type), MAX(event_type), TRUE, TRUE FROM part
UNION ALL SELECT 'value', COUNT(*), COUNT(*) - COUNT(value), MIN(value)::DOUBLE, MAX(value)::DOUBLE, NULL, NULL, TRUE, TRUE FROM part""")
def profile_date_range(spark, sf_dir):
    """Daily profiles united for two weeks, and whether the estimates are within their errors of the exact values."""
    path = scratch_dir(spark, "profiles")
    events = table(spark, sf_dir, "events").withColumn("event_date", F.to_date("ts"))
    profiles.save_profiles(events, PROFILED, path, ["event_date"])
    within = F.col("event_date").between(F.lit("2024-01-08").cast("date"), F.lit("2024-01-21").cast("date"))
    found = profiles.report(profiles.united(spark.read.parquet(path).where(within)))
    medians = {row.column_name: row.median for row in found.select("column_name", F.expr("quantiles[1]").alias("median")).collect()}
    exact = None
    for name in PROFILED:
        at, column = F.lit(medians[name]).cast("double"), F.col(name)
        below = [F.count_if(column <= at), F.count_if(column < at)] if medians[name] is not None else [F.lit(None).cast("long")] * 2
        own = events.where(within).agg(
            F.lit(name).alias("column_name"), F.count_distinct(column).alias("exact"), F.count(column).alias("n"), *(b.alias(f"below{i}") for i, b in enumerate(below))
        )
        exact = own if exact is None else exact.unionByName(own)
    near = F.abs(F.col("distinct_values") - F.col("exact")) <= F.greatest(F.lit(1.0), F.col("exact") * (4 * profiles.DISTINCT_ERROR))
    slack = F.col("n") * (3 * profiles.RANK_ERROR) + 1
    middle = (F.col("below0") >= F.col("n") / 2 - slack) & (F.col("below1") <= F.col("n") / 2 + slack)
    columns = ["column_name", "total", "nulls", "least_number", "greatest_number", "least_text", "greatest_text"]
    return found.join(exact, "column_name").select(*columns, near.alias("distinct_near"), F.coalesce(middle, F.lit(True)).alias("median_near"))
