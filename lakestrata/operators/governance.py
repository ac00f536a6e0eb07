"""Governance jobs: masked views per role, retention, archiving, and erasure of data subjects."""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping, Sequence
from contextlib import contextmanager
from dataclasses import dataclass
from datetime import date, timedelta
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakestrata.functions.columns import hash_masked, named
from lakestrata.session import clear_scratch, scratch_dir
from lakestrata.sources.lake import drop_slices, overwrite_partitions, overwrite_table, partition_folders, partition_names, slice_path
from lakestrata.sources.storage import NULL_PARTITION, Files

# The layers of the lake.
LAYERS = ("bronze", "silver", "gold")
MASKS = {"hash": hash_masked}


@dataclass(frozen=True)
class Retention:
    """How long the rows of a layer are kept, and what becomes of them then."""

    duration: str
    disposition: str

    def cutoff(self, as_of: date) -> date:
        """The first day that is kept."""
        match = re.fullmatch(r"(\d+)([dy])", self.duration)
        if not match:
            raise ValueError(f"unsupported duration: {self.duration}")
        number = int(match.group(1))
        if match.group(2) == "d":
            return as_of - timedelta(days=number)
        leap_day = as_of.month == 2 and as_of.day == 29
        return (as_of.replace(day=28) if leap_day else as_of).replace(year=as_of.year - number)


@dataclass(frozen=True)
class RolePolicy:
    """What a role may see: its layers, and the mask of some columns."""

    role: str
    layers: tuple[str, ...] = LAYERS
    masks: tuple[tuple[str, str], ...] = ()
    permissions: tuple[str, ...] = ("read",)


@dataclass(frozen=True)
class Governance:
    roles: tuple[RolePolicy, ...]
    retention: Mapping[str, Retention]

    @classmethod
    def from_dict(cls, manifest: Mapping[str, Any]) -> Governance:
        return cls(
            roles=tuple(
                RolePolicy(
                    role=rule["role"],
                    layers=tuple(rule.get("applies_to_layers", LAYERS)),
                    masks=tuple((mask["column"], mask["type"]) for mask in rule.get("masking_rules", [])),
                    permissions=tuple(rule.get("permissions", ())),
                )
                for rule in manifest.get("access_control", {}).get("rbac", [])
            ),
            retention={
                layer: Retention(policy["duration"], policy["disposition"])
                for layer, policy in manifest.get("retention_policies", {}).items()
            },
        )


def mask(df: DataFrame, masks: Sequence[tuple[str, str]]) -> DataFrame:
    """Mask the columns that are there; the row order and all other columns stay."""
    unknown = [kind for _, kind in masks if kind not in MASKS]
    if unknown:
        raise ValueError(f"unsupported mask: {', '.join(unknown)}")
    return df.withColumns({name: MASKS[kind](named(name)) for name, kind in masks if name in df.columns})


def role_view(df: DataFrame, layer: str, policies: Sequence[RolePolicy], role: str) -> DataFrame:
    """The rows of a layer as a role may read them; PermissionError if it may not."""
    granted = [p for p in policies if p.role == role and layer in p.layers and "read" in p.permissions]
    if not granted:
        raise PermissionError(f"role {role} may not read layer {layer}")
    masks = [item for policy in granted for item in policy.masks]
    return mask(df, masks)


def retained(df: DataFrame, day: Column, retention: Retention, as_of: date) -> DataFrame:
    """Rows young enough to keep, those without a day among them. On a partition column this prunes folders."""
    return df.where(day.isNull() | (day >= F.lit(retention.cutoff(as_of))))


def expired(df: DataFrame, day: Column, retention: Retention, as_of: date) -> DataFrame:
    return df.where(day < F.lit(retention.cutoff(as_of)))


def partition_days(spark: SparkSession, path: str, columns: str | Sequence[str]) -> dict[date, str]:
    """Day partitions of a table, by listing folders; no file is opened.

    `columns` are the outermost partition columns: one that holds dates, or year, month and day.
    """
    columns = [columns] if isinstance(columns, str) else list(columns)
    names = partition_names(spark, path)
    if names and names[: len(columns)] != columns:
        raise ValueError(f"{path} is partitioned by {', '.join(names)}, not by {', '.join(columns)}")
    days = {}
    for values, folder in partition_folders(spark, path, columns).items() if names else ():
        if NULL_PARTITION not in values:
            days[date.fromisoformat(values[0]) if len(values) == 1 else date(*map(int, values))] = folder
    return days


def drop_expired(
    spark: SparkSession, path: str, columns: str | Sequence[str], retention: Retention, as_of: date
) -> list[date]:
    """Delete the expired day partitions whole; what is kept is neither read nor rewritten."""
    cutoff = retention.cutoff(as_of)
    old = {day: item for day, item in partition_days(spark, path, columns).items() if day < cutoff}
    drop_slices(spark, list(old.values()))
    return sorted(old)


# Notes of archive runs that are not finished; Spark does not read folders with such names.
COPYING, COPIED = "_copying", "_copied"


def archive_expired(
    spark: SparkSession,
    path: str,
    archive_path: str,
    columns: str | Sequence[str],
    retention: Retention,
    as_of: date,
) -> list[date]:
    """Move the expired day partitions to the archive: copied first, dropped when that is done.

    Every run adds a folder `run=...` of its own, so rows that come late are added to what the archive
    holds. The files that are copied are noted, and a partition is dropped only if it still consists of those; one that
    changed meanwhile stays, and its copy goes. A run that died is settled by the next one in the same way.
    """
    archive = archive_path.rstrip("/")
    for run in {item.rsplit("/", 1)[1] for kind in (COPYING, COPIED) for item in Files(spark).folders(f"{archive}/{kind}")}:
        _settle_archive(spark, path, archive, run)
    run, days = copy_expired(spark, path, archive, columns, retention, as_of)
    if run:
        _settle_archive(spark, path, archive, run)
    return days


def copy_expired(
    spark: SparkSession, path: str, archive: str, columns: str | Sequence[str], retention: Retention, as_of: date
) -> tuple[str | None, list[date]]:
    """The first half of `archive_expired`: copy the expired days and note their files; returns the run, if any, and its days."""
    files, cutoff = Files(spark), retention.cutoff(as_of)
    old = {day: item for day, item in partition_days(spark, path, columns).items() if day < cutoff}
    if not old:
        return None, []
    number = len(files.glob(f"{archive}/run={as_of.isoformat()}-*"))
    run = f"run={as_of.isoformat()}-{number:04d}"
    names = partition_names(spark, path)
    _note_files(spark, path, names, old, f"{archive}/{COPYING}/{run}")
    overwrite_partitions(read_as_text(spark, path, list(old.values())), f"{archive}/{run}", names, clustered=True)
    files.make_folders([f"{archive}/{COPIED}/{run}"])
    return run, sorted(old)


def _note_files(spark: SparkSession, path: str, names: Sequence[str], days: Mapping[date, str], note: str) -> None:
    """Write down the files of the partitions below some folders."""
    below = tuple(f"{folder}/" for folder in days.values())
    leaves = {values: item for values, item in partition_folders(spark, path, names).items() if f"{item}/".startswith(below)}
    found = Files(spark).all_data_files(list(leaves.values()))
    rows = [(list(values), name, length) for values, own in zip(leaves, found) for name, length in own.items()]
    spark.createDataFrame(rows, "part array<string>, name string, length bigint").coalesce(1).write.mode("overwrite").parquet(note)


def _settle_archive(spark: SparkSession, path: str, archive: str, run: str) -> None:
    """Undo a copy that was not completed; after a completed one, drop the partitions that are still what was copied."""
    files = Files(spark)
    copying, copied = f"{archive}/{COPYING}/{run}", f"{archive}/{COPIED}/{run}"
    if not files.exists(copied):
        drop_slices(spark, [f"{archive}/{run}", copying])
        return
    noted: dict[tuple[str, ...], dict[str, int]] = {}
    for row in spark.read.parquet(copying).collect() if files.exists(copying) else ():
        noted.setdefault(tuple(row["part"]), {})[row["name"]] = row["length"]
    names = partition_names(spark, f"{archive}/{run}")
    copies = partition_folders(spark, f"{archive}/{run}", names)
    there = partition_folders(spark, path, names) if names == partition_names(spark, path) else {}
    both = sorted(set(copies) & set(there))
    marks = {values: slice_path(copied, dict(zip(names, values))) for values in both}
    done, stale = [], []
    for values, live in zip(both, files.all_data_files([there[values] for values in both])):
        own = noted.get(values, {})
        if live.items() <= own.items():
            done.append(values)
        elif own.items() <= live.items() or not files.exists(marks[values]):
            # late rows beside the copied ones, or other rows in their place: the whole partition is to be archived again
            stale.append(values)
        # else the partition was dropped before, and these rows came afterwards: they are for the next archive
    drop_slices(spark, [copies[values] for values in stale])
    files.make_folders(marks[values] for values in done)
    drop_slices(spark, [there[values] for values in done])
    above = {there[values] for values in done}
    for _ in names[1:]:
        above = {item.rsplit("/", 1)[0] for item in above}
        for item in sorted(above):
            files.delete_empty(item)
    drop_slices(spark, [copied, copying])


# Lists of up to so many subjects are broadcast, and the rows beside them are not shuffled.
MOST_BROADCAST = 100_000


@dataclass(frozen=True)
class Listed:
    """Data subjects to erase: their distinct keys as a stored table, and whether these are few."""

    keys: DataFrame
    few: bool


def broadcast_few(listed: DataFrame, number: int) -> DataFrame:
    """A list of so many keys, to be broadcast if these are few; otherwise Spark decides."""
    return F.broadcast(listed) if number <= MOST_BROADCAST else listed


@contextmanager
def listed_subjects(subjects: DataFrame | Listed, key: str) -> Iterator[Listed]:
    """The keys of some subjects, stored while the block runs, so that no pass over a table computes the list again."""
    if isinstance(subjects, Listed):
        yield subjects
        return
    spark = subjects.sparkSession
    keys, path = subjects.select(named(key)).na.drop().distinct(), scratch_dir(spark, "subjects")
    try:
        number = overwrite_table(keys, path)
        yield Listed(broadcast_few(spark.read.schema(keys.schema).parquet(path), number), number <= MOST_BROADCAST)
    finally:
        clear_scratch([path])


def erase(df: DataFrame, subjects: DataFrame, key: str) -> DataFrame:
    """Drop the rows of the data subjects listed in `subjects`; rows without a key stay.

    The list is broadcast only if Spark finds it small. Otherwise both sides are shuffled on the
    key alone, a form in which AQE splits a hot key (or the NULLs) of the data over many tasks.
    """
    listed = subjects.select(named(key)).na.drop()
    return df.join(listed, key, "left_anti").select(*map(named, df.columns))


def read_as_text(spark: SparkSession, path: str, folders: Sequence[str] | None = None) -> DataFrame:
    """A table, or some of its folders, with partition values as the text in the folder names (`month=05` stays `05`)."""
    names = partition_names(spark, path)
    typed = spark.read.option("basePath", path).parquet(*(folders or [path])).schema
    schema = T.StructType([T.StructField(f.name, T.StringType()) if f.name in names else f for f in typed.fields])
    return spark.read.schema(schema).option("basePath", path).parquet(*(folders or [path]))


def partitions_holding(
    spark: SparkSession, path: str, subjects: Listed, key: str, folders: Sequence[str] | None = None
) -> dict[tuple[str, ...], int]:
    """The partitions of a table, or of some of its folders, with rows of some subjects, and how many; only the key is read."""
    try:
        rows = read_as_text(spark, path, folders)
    except AnalysisException as error:
        if error.getCondition() == "UNABLE_TO_INFER_SCHEMA":  # folders whose rows have all gone
            return {}
        raise
    return _rows_per_partition(rows.join(subjects.keys, key, "left_semi"), partition_names(spark, path))


def erase_from_table(
    spark: SparkSession,
    path: str,
    subjects: DataFrame | Listed,
    key: str,
    folders: Sequence[str] | None = None,
    hits: Mapping[tuple[str, ...], int] | None = None,
) -> list[dict[str, str]]:
    """Erase data subjects from a partitioned table, or from some of its folders; returns the changed partitions.

    A first pass over the key alone finds the partitions with rows to erase, by all partition columns the
    folders have (`hits`, if it was made before). Only those are rewritten, in the same layout, and those without any other row are
    dropped, which an overwrite would leave as is. With few subjects rows are written where they are read, without a shuffle.
    """
    names = partition_names(spark, path)
    if not names:
        raise ValueError(f"{path} is not a partitioned table")
    with listed_subjects(subjects, key) as listed:
        hits = partitions_holding(spark, path, listed, key, folders) if hits is None else hits
        if not hits:
            return []
        there = partition_folders(spark, path, names)
        touched = read_as_text(spark, path, [there[values] for values in hits])
        rows = _rows_per_partition(touched, names)  # counted from the file footers
        emptied = [values for values in hits if hits[values] == rows[values]]
        if len(emptied) < len(hits):
            # rebalanced by partition behind a shuffled join, where the rows lie by subject
            overwrite_partitions(erase(touched, listed.keys, key), path, names, clustered=listed.few)
        drop_slices(spark, [there[values] for values in emptied])
        return [dict(zip(names, values)) for values in sorted(hits)]


def _rows_per_partition(df: DataFrame, names: Sequence[str]) -> dict[tuple[str, ...], int]:
    # One row per partition of the table reaches the driver.
    values = [F.coalesce(named(name), F.lit(NULL_PARTITION)).alias(name) for name in names]
    counts = df.groupBy(*values).agg(F.count(F.lit(1)).alias("_rows"))
    return {tuple(row[name] for name in names): row["_rows"] for row in counts.collect()}
