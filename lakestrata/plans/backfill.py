"""Many days of a daily job in one pass per layer.

The result is that of running the days one by one, but the work is a handful of Spark jobs over
all days instead of a loop: one multi-path read, one grouped quality check, one write per layer.
Only folder names, one result per day and rule, and counts per day come to the driver.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date, datetime

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, Observation, Row, SparkSession
from pyspark.sql import functions as F

from lakestrata.functions.columns import any_of
from lakestrata.operators.duplicates import DuplicatedKeys
from lakestrata.operators.quality import (
    Rule,
    evaluate,
    failing_rows,
    is_broken,
    must_abort,
    overall_status,
    quarantine_due,
    run_rules,
)
from lakestrata.operators.runlog import RunLog
from lakestrata.operators.steps import with_ingestion_timestamp
from lakestrata.plans.daily import RAW_LINE, DailyJob
from lakestrata.session import use_utc
from lakestrata.sources.lake import (
    day_parts,
    drop_slices,
    overwrite_partitions,
    overwrite_slices,
    read_slices,
    slice_path,
    written_partitions,
)
from lakestrata.sources.landing import header_differs, landing_day, landing_path, landing_paths
from lakestrata.sources.storage import in_order, partition_value

LOAD_DATE = "load_date"


def run_days(
    job: DailyJob,
    spark: SparkSession,
    days: Sequence[date],
    as_of: datetime,
    skip_check: bool = False,
    log: RunLog | None = None,
) -> dict[date, str]:
    """Load the days that have landing files with rows; returns the quality status of each.

    A day that fails its check goes no further than bronze, like a single run that stops, and does
    not hold up the others. Days without landing files are left as they are. The log tells
    what became of each day.
    """
    use_utc(spark)
    log = log or job.new_log()
    step, keys = "IngestBronze", None
    try:
        log.event("PipelineStart", "STARTING", {"processing_dates": len(days)})
        loaded = ingest_days(job, spark, days, as_of)
        for day in days:
            if day in loaded:
                log.event(step, "SUCCEEDED", {"processing_date": day, "rows": loaded[day]})
            else:
                error = FileNotFoundError(f"no such input: {landing_path(job.landing, day)}")
                log.failure(step, error, processing_date=day)
        full = [day for day, rows in loaded.items() if rows]
        statuses: dict[date, str] = {}
        if full:
            step = "DataQuality"
            rows = bronze_days(job, spark, full)
            keys = DuplicatedKeys(rows)
            results = check_days(job, rows, full, keys)
            by_day: dict[date, list[Row]] = {day: [] for day in full}
            for row in results:
                by_day[row["processing_date"]].append(row)
            good = []
            for day, found in by_day.items():
                statuses[day] = overall_status(found)
                stopped = must_abort(found, job.rules, job.allow_partial_success)
                blocked = stopped or not skip_check and statuses[day] == "ERROR"
                said = "FAILED" if blocked else "WARNING" if statuses[day] == "WARNING" else "SUCCEEDED"
                log.event(step, said, {"processing_date": day, "status": statuses[day]})
                if not blocked:
                    good.append(day)
            if good:
                step = "TransformSilver"
                job.heal(spark, good)
                touched = build_silver_days(job, spark, good, results, keys)
                for day in good:
                    log.event(step, "SUCCEEDED", {"processing_date": day})
                step = "TransformGold"
                log.event(step, "SUCCEEDED", {"rows": job.refresh_gold(spark, touched), "order_dates": len(touched)})
                job.settle(spark, good)
        log.event("PipelineEnd", "SUCCEEDED", {"loaded": len(full), "missing": len(days) - len(loaded)})
        return statuses
    except Exception as error:
        log.failure(step, error)
        raise
    finally:
        if keys is not None:
            keys.clear()
        log.flush(spark, job.path("run_log"))


def ingest_days(job: DailyJob, spark: SparkSession, days: Sequence[date], as_of: datetime) -> dict[date, int]:
    """Landing files to bronze; returns the rows of each day that has files.

    Files lie together by day already, so nothing is shuffled. Should the headers of the files differ,
    they are read header by header.
    """
    paths = landing_paths(spark, job.landing, days, skip_missing=True)
    if not paths:
        raise FileNotFoundError(f"no landing files from {min(days)} to {max(days)}")
    there = set(paths)
    loaded = {day: 0 for day in days if landing_path(job.landing, day) in there}
    try:
        counts = _ingest(job, spark, paths, as_of, mixed=False)
    except Exception as error:  # the reader's own error comes in several classes
        if job.landing_format != "csv" or not header_differs(error):
            raise
        counts = _ingest(job, spark, paths, as_of, mixed=True)
    return loaded | {day: found["rows"] for day, found in counts.items()}


def _ingest(job: DailyJob, spark: SparkSession, paths: Sequence[str], as_of: datetime, mixed: bool) -> dict[date, dict]:
    rows = job.landing_rows(spark, paths, mixed)
    loaded_on = landing_day(job.landing, F.col("_metadata.file_path") if not mixed else F.input_file_name())
    dated = job.without_erased(rows.withColumn(LOAD_DATE, loaded_on))
    parts = {name: F.date_format(LOAD_DATE, form) for name, form in (("year", "yyyy"), ("month", "MM"), ("day", "dd"))}
    seen = Observation()
    counted = dated.withColumns(parts).observe(seen, F.count(RAW_LINE).alias("raw_lines"))
    stamped = with_ingestion_timestamp(as_of)(counted.drop(RAW_LINE, LOAD_DATE))
    _, written = written_partitions(stamped, job.path("bronze"), ["year", "month", "day"], clustered=True)
    full = [date(*map(int, values)) for values in sorted(written)]
    job.drop_raw_lines(spark, full)
    if not full:
        return {}
    # counts per day, one row for each: from bronze, or from the files again if some lines did not parse
    flawed = bool(seen.get.get("raw_lines"))
    source = dated if flawed else bronze_days(job, spark, full)
    found = {}
    for row in source.groupBy(LOAD_DATE).agg(*job.load_counters(source.drop(LOAD_DATE))).collect():
        counts = row.asDict()
        found[counts.pop(LOAD_DATE)] = counts
    if flawed:
        job.keep_raw_lines(dated, F.col(LOAD_DATE))
    job.save_load_results(spark, found, as_of)
    job.index_subjects(spark, "bronze", [day_parts(day) for day in full])
    return found


def bronze_days(job: DailyJob, spark: SparkSession, days: Sequence[date]) -> DataFrame:
    rows = read_slices(spark, job.path("bronze"), [day_parts(day) for day in days])
    return rows.withColumn(LOAD_DATE, F.make_date("year", "month", "day")).drop("year", "month", "day")


def check_days(
    job: DailyJob, rows: DataFrame, days: Sequence[date], duplicates: DuplicatedKeys | None = None
) -> list[Row]:
    """Check every day in one pass, store the results and quarantine."""
    spark, layer = rows.sparkSession, job.checked_layer
    own = duplicates or DuplicatedKeys(rows)

    def graded(rules: Sequence[Rule]) -> DataFrame:
        return evaluate(rows, rules, job.pipeline_id, layer, F.col(LOAD_DATE), own, LOAD_DATE)

    try:
        results = graded(job.rules).collect()
    except PySparkException:
        # Some rule fails on some value: each rule by itself over all days, and only the broken one day by day.
        results = []
        for rule in job.rules:
            try:
                results += graded([rule]).collect()
            except PySparkException:
                results += [
                    Row(**{**row.asDict(), "processing_date": day})
                    for day in days
                    for row in run_rules(job.bronze(spark, day), [rule], job.pipeline_id, layer, day.isoformat())
                ]
    if results:
        stored = spark.createDataFrame(results, graded(job.rules).schema)
        overwrite_partitions(stored, job.path("dq_results"), ["target_layer", "processing_date"])
    else:
        job.forget_results(spark, days)
    if job.quarantine_enabled:
        _quarantine_days(job, rows, days, results, own)
    if duplicates is None:
        own.clear()
    return results


def _due(job: DailyJob, results: Sequence[Row]) -> dict[str, list[date]]:
    """For each rule that asks for quarantine, the days on which it does."""
    asked: dict[str, list[date]] = {}
    for row in quarantine_due(results, job.rules):
        asked.setdefault(row["rule_id"], []).append(row["processing_date"])
    return asked


def _quarantine_days(
    job: DailyJob, rows: DataFrame, days: Sequence[date], results: Sequence[Row], duplicates: DuplicatedKeys
) -> None:
    asked = _due(job, results)
    parts = [{"target_layer": job.checked_layer, "processing_date": day.isoformat()} for day in days]
    if not asked:
        drop_slices(rows.sparkSession, [slice_path(job.path("quarantine"), item) for item in parts])
        return
    chosen = [rule for rule in job.rules if rule.rule_id in asked]
    wanted = [(F.col("rule_id") == rule_id) & F.col(LOAD_DATE).isin(on) for rule_id, on in asked.items()]
    failed = failing_rows(rows, chosen, LOAD_DATE, duplicates).where(any_of(wanted))
    overwrite_slices(
        failed.withColumn("target_layer", F.lit(job.checked_layer)).withColumnRenamed(LOAD_DATE, "processing_date"),
        job.path("quarantine"),
        parts,
        ["rule_id"],
    )
    # an inner partition that only an earlier run had is gone, but a slice without any may be left over
    quarantined = {day for on in asked.values() for day in on}
    clean = [item for day, item in zip(days, parts) if day not in quarantined]
    drop_slices(rows.sparkSession, [slice_path(job.path("quarantine"), item) for item in clean])


def _passing(job: DailyJob, rows: DataFrame, results: Sequence[Row], duplicates: DuplicatedKeys) -> tuple[DataFrame, bool]:
    """The rows that were not quarantined on their day, and whether a join was needed to find them."""
    if not (job.drop_quarantined and job.quarantine_enabled):
        return rows, False
    asked = _due(job, results)
    usable = [rule for rule in job.rules if rule.rule_id in asked and not is_broken(rows, rule)]
    failing: list[Column] = [
        F.col(LOAD_DATE).isin(asked[rule.rule_id]) & rule.failing() for rule in usable if rule.failing() is not None
    ]
    result = rows.where(~F.coalesce(any_of(failing), F.lit(False))) if failing else rows
    joined = False
    for rule in usable:
        if rule.unique_key:
            on = F.col(LOAD_DATE).isin(asked[rule.rule_id])
            keys = [LOAD_DATE, rule.unique_key]
            found = duplicates.of(keys)
            if found is not None:
                result = result.join(found.where(on).select(*keys), keys, "left_anti")
                joined = True
    return result, joined


def build_silver_days(
    job: DailyJob, spark: SparkSession, days: Sequence[date], results: Sequence[Row], duplicates: DuplicatedKeys
) -> list[date | None]:
    """Transform bronze days; returns the order dates touched, those of replaced rows included."""
    passed, joined = _passing(job, bronze_days(job, spark, days), results, duplicates)
    parts = [{LOAD_DATE: day.isoformat()} for day in days]
    touched = job.note_replaced(spark, days)
    on_time = F.col("order_date") == F.col(LOAD_DATE)
    silver = job.silver_rows(passed, [LOAD_DATE])
    overwrite_slices(silver, job.path("silver"), parts, ["order_date"], bulk=None if joined else on_time)
    now = job.silver_folders(spark, days)
    of_load: dict[date, set[date | None]] = {}
    for day, paths in now.items():
        for path in paths:
            of_load.setdefault(date.fromisoformat(partition_value(path, LOAD_DATE)), set()).add(day)
    job.note_dates(spark, of_load)
    job.save_states(spark, days)
    job.index_subjects(spark, "silver", parts)
    return in_order(touched | set(now))
