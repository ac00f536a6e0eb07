"""Parquet tables of the lake: idempotent writes that report their row count, and pruned reads."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, DataFrameWriter, Observation, SparkSession
from pyspark.sql import functions as F

from lakestrata.sources.storage import NULL_PARTITION, Files, partition_value


def day_parts(day: date) -> dict[str, str]:
    """Partition of one processing day."""
    return {"year": f"{day.year}", "month": f"{day.month:02d}", "day": f"{day.day:02d}"}


def slice_path(path: str, parts: Mapping[str, str]) -> str:
    return "/".join([path.rstrip("/"), *(f"{name}={value}" for name, value in parts.items())])


def overwrite_table(df: DataFrame, path: str) -> int:
    """Replace the whole table; returns the rows written."""
    return _write(df, path, lambda w: w.mode("overwrite").option("partitionOverwriteMode", "static"))


def overwrite_slice(
    df: DataFrame,
    path: str,
    parts: Mapping[str, str],
    partition_by: Sequence[str] = (),
    bulk: Column | None = None,
    clustered: bool = False,
) -> int:
    """Replace exactly one partition (a day, a layer and date) and nothing else.

    Inner partitions that the new rows no longer have go away too, so a corrected rerun leaves
    no stale rows behind. `bulk` marks the rows of the one inner partition that is known to hold
    most of them: they are written where they are read, and only the others are shuffled. That is of
    use only if the rows do lie where they were read, so not behind a shuffled join. Rows that already
    lie as they are to be written (`clustered`) are not shuffled at all.
    """
    rows = df.drop(*parts)
    return _write(
        rows if clustered else _clustered(rows, partition_by, bulk),
        slice_path(path, parts),
        lambda w: _partitioned(w.mode("overwrite").option("partitionOverwriteMode", "static"), partition_by),
    )


def overwrite_slices(
    df: DataFrame,
    path: str,
    slices: Sequence[Mapping[str, str]],
    partition_by: Sequence[str] = (),
    bulk: Column | None = None,
) -> int:
    """Replace many such partitions by one write.

    The rows carry the columns of the slices. Inner partitions that got no new rows are dropped: the write
    itself reports which ones it wrote, so only names of partition folders are listed.
    """
    if not slices:
        return 0
    files = Files(df.sparkSession)
    patterns = [slice_path(path, {**parts, **dict.fromkeys(partition_by, "*")}) for parts in slices]
    before = files.glob_all(patterns)
    columns = [*slices[0], *partition_by]
    written, found = _write_partitions(_clustered(df, columns, bulk), path, columns)
    gone = [name for name in before if tuple(partition_value(name, column) for column in columns) not in found]
    drop_slices(df.sparkSession, sorted(gone))
    return written


def overwrite_partitions(df: DataFrame, path: str, partition_by: Sequence[str], clustered: bool = False) -> int:
    """Replace the partitions present in `df`, and leave all others as they are.

    Rows that already lie together by partition (`clustered`) are not shuffled again.
    """
    return written_partitions(df, path, partition_by, clustered)[0]


def written_partitions(
    df: DataFrame, path: str, partition_by: Sequence[str], clustered: bool = False
) -> tuple[int, set[tuple[str, ...]]]:
    """The same; returns the rows written and the values of the partitions that were replaced."""
    missing = [name for name in partition_by if name not in df.columns]
    if missing:
        raise ValueError(f"partition columns not in the data: {', '.join(missing)}")
    return _write_partitions(df if clustered else _clustered(df, partition_by), path, partition_by)


def _write_partitions(df: DataFrame, path: str, columns: Sequence[str]) -> tuple[int, set[tuple[str, ...]]]:
    # One entry for each partition of the write reaches the driver.
    values = F.struct(*(F.coalesce(F.col(c).cast("string"), F.lit(NULL_PARTITION)).alias(c) for c in columns))
    seen: dict = {}
    rows = _write(
        df,
        path,
        lambda w: _partitioned(w.mode("overwrite").option("partitionOverwriteMode", "dynamic"), columns),
        {"values": F.collect_set(values)},
        seen,
    )
    return rows, {tuple(value) for value in seen.get("values") or ()}


def append_rows(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> int:
    return _write(df, path, lambda w: _partitioned(w.mode("append"), partition_by))


def partition_names(spark: SparkSession, path: str) -> list[str]:
    """The partition columns of a table, outermost first, read off the names of one chain of folders."""
    files, names = Files(spark), []
    while found := [item for item in files.folders(path) if "=" in item.rsplit("/", 1)[1]]:
        path = found[0]
        names.append(path.rsplit("/", 1)[1].partition("=")[0])
    return names


def partition_folders(spark: SparkSession, path: str, names: Sequence[str]) -> dict[tuple[str, ...], str]:
    """Folders by the values of their partition columns; names are listed, no file is opened."""
    found = Files(spark).glob(slice_path(path, dict.fromkeys(names, "*")))
    return {tuple(partition_value(item, name) for name in names): item for item in found}


def read_slices(spark: SparkSession, path: str, slices: Sequence[Mapping[str, str]]) -> DataFrame:
    """Read some partitions; only their folders are listed, not the whole table."""
    paths = [slice_path(path, parts) for parts in slices]
    return spark.read.option("basePath", path).parquet(*paths)


def table_metrics(df: DataFrame, table: str, date_column: str) -> DataFrame:
    """Row count and last date of a table, as attached to it after a load."""
    return df.agg(
        F.lit(table).alias("table_name"),
        F.count(F.lit(1)).alias("row_count"),
        F.max(F.to_date(date_column)).alias("last_date"),
    )


def drop_slices(spark: SparkSession, paths: Sequence[str]) -> None:
    Files(spark).delete_all(paths)


def _clustered(df: DataFrame, partition_by: Sequence[str], bulk: Column | None = None) -> DataFrame:
    # One writer per partition value instead of one file per task and value; AQE splits a
    # value that holds too many rows and merges small ones.
    if not partition_by:
        return df
    if bulk is None:
        return df.hint("rebalance", *partition_by)
    in_place = F.coalesce(bulk, F.lit(False))
    return df.where(in_place).unionByName(df.where(~in_place).hint("rebalance", *partition_by))


def _partitioned(writer: DataFrameWriter, partition_by: Sequence[str]) -> DataFrameWriter:
    return writer.partitionBy(*partition_by) if partition_by else writer


def _write(df: DataFrame, path: str, configure, more: Mapping[str, Column] | None = None, seen: dict | None = None) -> int:
    # The count comes from the write job itself. It is observed last, above every shuffle, so
    # that a task run again after a lost executor is not counted twice.
    observation = Observation()
    counters = [column.alias(name) for name, column in (more or {}).items()]
    observed = df.observe(observation, F.count(F.lit(1)).alias("rows"), *counters)
    configure(observed.write).parquet(path)
    found = observation.get
    if seen is not None:
        seen.update(found)
    return found.get("rows", 0)
