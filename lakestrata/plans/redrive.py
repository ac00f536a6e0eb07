"""Corrected rows back through a daily job: bronze takes them by key, and the day is checked and built again."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date, datetime

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from lakestrata.functions.columns import named
from lakestrata.operators.duplicates import DuplicatedKeys
from lakestrata.operators.quality import overall_status
from lakestrata.operators.runlog import RunLog
from lakestrata.operators.steps import with_ingestion_timestamp
from lakestrata.plans.daily import DailyJob
from lakestrata.session import clear_scratch, scratch_dir, use_utc
from lakestrata.sources.lake import append_rows, day_parts, overwrite_slice, overwrite_table, read_slices, slice_path
from lakestrata.sources.storage import Files

CORRECTED_AT = "corrected_at"


def last_versions(rows: DataFrame, keys: Sequence[str], order_by: str) -> DataFrame:
    """For each key the row with the greatest `order_by`; of ties the greatest by the other columns, so every run chooses alike.

    The greatest is found in the tasks first, so a key that is corrected very often is not one task's work. Rows without a full key are
    left out: nothing tells which row they correct.
    """
    others = [name for name in rows.columns if name not in (*keys, order_by)]
    last = F.max(F.struct(named(order_by), *map(named, others))).alias("__last")
    found = rows.na.drop(subset=list(keys)).groupBy(*map(named, keys)).agg(last)
    picked = {name: F.col("__last").getField(name) for name in (order_by, *others)}
    return found.select(*(picked[name].alias(name) if name in picked else named(name) for name in rows.columns))


def upserted(target: DataFrame, updates: DataFrame, keys: Sequence[str]) -> DataFrame:
    """`target` with the rows of `updates` in place of its rows of the same keys, and new keys beside them.

    `updates` holds each key once. Rows of the target without a full key stay. The join has no hint: Spark broadcasts the keys if they are
    few, and otherwise AQE splits a hot key of the target.
    """
    kept = target.join(updates.select(*map(named, keys)), list(keys), "left_anti").select(*map(named, target.columns))
    return kept.unionByName(updates.select(*map(named, target.columns)))


def keep_corrections(job: DailyJob, spark: SparkSession, day: date, corrections: DataFrame, order_by: str = CORRECTED_AT) -> int:
    """Add corrected rows of a day, in the landing columns and with the moment of correction, to those kept before."""
    schema = job.contract.schema("landing")
    typed = [named(field.name).cast(field.dataType).alias(field.name) for field in schema.fields]
    rows = corrections.select(*typed, named(order_by).cast("timestamp").alias(CORRECTED_AT))
    return append_rows(rows.withColumn("processing_date", F.lit(day.isoformat())), job.path("corrections"), ["processing_date"])


def corrections_of(job: DailyJob, spark: SparkSession, day: date) -> DataFrame | None:
    """All corrections kept for a day, or None."""
    part = {"processing_date": day.isoformat()}
    if not Files(spark).exists(slice_path(job.path("corrections"), part)):
        return None
    return read_slices(spark, job.path("corrections"), [part]).drop("processing_date")


def redrive(
    job: DailyJob,
    spark: SparkSession,
    day: date,
    corrections: DataFrame | None,
    keys: Sequence[str],
    as_of: datetime,
    order_by: str = CORRECTED_AT,
    log: RunLog | None = None,
    skip_check: bool = False,
) -> str:
    """Put corrected rows in place of the bronze rows of their keys and run the day again from there; returns its quality status.

    The corrections are kept first, and all that are kept for the day are applied, the last of a key winning. So a run that died, or a
    reload of the day's files, is made good by another call, with None for no further corrections. Checks, quarantine, silver and
    gold are then those of a load that had been right from the start. Erased subjects stay erased.
    """
    use_utc(spark)
    log = log or job.new_log()
    step, own, staged = "Redrive", None, scratch_dir(spark, "redrive")
    try:
        if corrections is not None:
            keep_corrections(job, spark, day, corrections, order_by)
        kept, bronze = corrections_of(job, spark, day), job.bronze(spark, day)
        if bronze is None:
            raise FileNotFoundError(f"no bronze rows for {day}")
        if kept is not None:
            last = with_ingestion_timestamp(as_of)(job.without_erased(last_versions(kept, keys, CORRECTED_AT)))
            # written aside first, for the partition cannot be read while it is replaced
            overwrite_table(upserted(bronze, last, keys), staged)
            rows, seen = spark.read.schema(bronze.schema).parquet(staged), Observation()
            counted = rows.observe(seen, *job.load_counters(rows))
            written = overwrite_slice(counted, job.path("bronze"), day_parts(day))
            job.save_load_results(spark, {day: seen.get}, as_of)
            job.index_subjects(spark, "bronze", [day_parts(day)])
            log.event(step, "SUCCEEDED", {"processing_date": day, "rows": written})
        step, own = "DataQuality", DuplicatedKeys(job.bronze(spark, day))
        status = overall_status(job.check(spark, day, own))
        log.event(step, "WARNING" if status == "WARNING" else "SUCCEEDED", {"status": status})
        step = "TransformSilver"
        job.heal(spark, [day])
        written, touched = job.build_silver(spark, day, skip_check, own)
        log.event(step, "SUCCEEDED", {"rows": written, "order_dates": len(touched)})
        step = "TransformGold"
        log.event(step, "SUCCEEDED", {"rows": job.refresh_gold(spark, touched)})
        job.settle(spark, [day])
        return status
    except Exception as error:
        log.failure(step, error, processing_date=day)
        raise
    finally:
        if own is not None:
            own.clear()
        clear_scratch([staged])
        log.flush(spark, job.path("run_log"))
