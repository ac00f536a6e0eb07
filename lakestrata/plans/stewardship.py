"""Governance applied to the tables that a daily job writes: retention, archive and erasure in their own layouts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import date

from pyspark.sql import DataFrame, SparkSession

from lakestrata.operators.governance import (
    Listed,
    Retention,
    archive_expired,
    drop_expired,
    erase_from_table,
    listed_subjects,
    partitions_holding,
)
from lakestrata.operators.subjects import may_hold
from lakestrata.plans.daily import DailyJob
from lakestrata.sources.lake import partition_names
from lakestrata.sources.storage import Files, in_order

# The outermost partition columns of each layer, which hold the day that retention goes by.
DAY_COLUMNS = {"bronze": ("year", "month", "day"), "silver": ("load_date",), "gold": ("order_date",)}
# Tables that hold rows of data subjects: the layers that a job writes row by row, and copies of them.
PERSONAL_TABLES = ("bronze", "bronze_archive", "quarantine", "corrections", "silver", "silver_archive")
DELETE = "delete"


def retain_lake(job: DailyJob, spark: SparkSession, policies: Mapping[str, Retention], as_of: date) -> dict[str, list[date]]:
    """Delete or archive the expired days of every layer with a policy; returns them per layer.

    Gold dates are not recomputed: archived silver rows still count in them, and deleted ones leave them as they are.
    """
    done = {}
    for layer, retention in policies.items():
        path, columns = job.path(layer), DAY_COLUMNS[layer]
        if not Files(spark).exists(path):
            done[layer] = []
        elif retention.disposition == DELETE:
            done[layer] = drop_expired(spark, path, columns, retention, as_of)
        else:
            done[layer] = archive_expired(spark, path, job.path(f"{layer}_archive"), columns, retention, as_of)
            if done[layer] and f"{layer}_archive" in PERSONAL_TABLES:
                job.index_subjects(spark, f"{layer}_archive")
    return done


def erase_from_lake(job: DailyJob, spark: SparkSession, subjects: DataFrame, key: str) -> dict[str, list[dict[str, str]]]:
    """Erase data subjects from every table of the job that holds their rows, archives too, and refresh the gold dates concerned.

    Returns the changed partitions per table. Landing files stay as they are, but loading them again leaves out the rows
    of erased subjects. Raw lines of files that did not parse are dropped whole, as nothing tells whose they are. If the
    job indexes this key, only partitions that may hold a subject are read.
    """
    changed = {}
    with listed_subjects(subjects, key) as listed:
        job.note_erased(spark, listed.keys, key)
        for table in PERSONAL_TABLES:
            path = job.path(table)
            if not partition_names(spark, path):
                continue
            folders = list(may_hold(spark, path, job.index_path(table), listed, key).values()) if key == job.subject_key else None
            if folders == []:
                changed[table] = []
            elif table == "silver":
                changed[table] = _erase_from_silver(job, spark, listed, key, folders)
            else:
                changed[table] = erase_from_table(spark, path, listed, key, folders)
            if changed[table]:
                job.index_subjects(spark, table, changed[table])
    archived = {date.fromisoformat(part["order_date"]) if part["order_date"][0].isdigit() else None for part in changed.get("silver_archive", ())}
    if archived:
        job.save_states(spark, sorted({date.fromisoformat(part["load_date"]) for part in changed["silver_archive"]}))
        job.refresh_gold(spark, in_order(archived))
    Files(spark).delete(job.path("unparsed"))
    return changed


def _erase_from_silver(
    job: DailyJob, spark: SparkSession, subjects: Listed, key: str, folders: Sequence[str] | None = None
) -> list[dict[str, str]]:
    path = job.path("silver")
    hits = partitions_holding(spark, path, subjects, key, folders)
    at = partition_names(spark, path).index("load_date")
    loads = sorted({date.fromisoformat(values[at]) for values in hits})
    # noted first: should the run die before gold is refreshed, the next one knows the dates
    touched = job.note_replaced(spark, loads) if loads else set()
    changed = erase_from_table(spark, path, subjects, key, folders, hits)
    job.save_states(spark, loads)
    job.refresh_gold(spark, in_order(touched))
    job.settle(spark, loads)
    return changed
