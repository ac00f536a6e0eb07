"""Readers of landing files: date-templated paths, typed CSV and JSON, error mapping."""

from __future__ import annotations

import re
from collections.abc import Sequence
from datetime import date, timedelta
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakestrata.sources.storage import Files


def days_between(first: date, last: date) -> list[date]:
    return [first + timedelta(days=n) for n in range((last - first).days + 1)]


def landing_path(template: str, day: date) -> str:
    """Fill `{yyyy}`, `{MM}` and `{dd}` of a path template."""
    return template.format(yyyy=day.year, MM=f"{day.month:02d}", dd=f"{day.day:02d}")


def landing_paths(spark: SparkSession, template: str, days: Sequence[date], skip_missing: bool = False) -> list[str]:
    """Paths of many days, each once; absent ones are dropped on request, with one listing per month."""
    paths = list(dict.fromkeys(landing_path(template, day) for day in days))
    if not skip_missing:
        return paths
    files = Files(spark)
    patterns = {template.format(yyyy=d.year, MM=f"{d.month:02d}", dd="*").rstrip("/") for d in days}
    found = set(files.glob_all(sorted(patterns)))
    return [path for path in paths if files.qualified(path) in found]


def landing_day(template: str, file_path: Column) -> Column:
    """The day of a file, read from its path by the template it was found with."""
    if not all(key in template for key in ("{yyyy}", "{MM}", "{dd}")):
        raise ValueError(f"the template names no single day: {template}")
    # From the folder of the first placeholder on; what comes before may be spelt differently.
    tail = template[template.rfind("/", 0, template.index("{")) + 1 :].rstrip("/")
    pattern = re.escape(tail)
    for key, digits in (("{yyyy}", r"(\d+)"), ("{MM}", r"(\d{2})"), ("{dd}", r"(\d{2})")):
        pattern = pattern.replace(re.escape(key), digits, 1)
    group = {key: n + 1 for n, key in enumerate(sorted(("{yyyy}", "{MM}", "{dd}"), key=tail.index))}
    written = f"${group['{yyyy}']}-${group['{MM}']}-${group['{dd}']}"
    day = F.regexp_replace(file_path, f"^.*/{pattern}(?:/[^/]*)?$", written).try_cast("date")
    return F.coalesce(day, F.raise_error(F.concat(F.lit("no day in the path "), file_path)).cast("date"))


def read_files(
    spark: SparkSession,
    paths: str | Sequence[str],
    file_format: str,
    schema: T.StructType | str | None = None,
    corrupt_column: str | None = None,
) -> DataFrame:
    """Read CSV (with header), JSON or Parquet files.

    A missing path raises FileNotFoundError, any other failure to open the files OSError. With a
    schema nothing is inferred; cells that do not parse become NULL, and `corrupt_column`, if
    named, keeps the raw line of such rows.
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    try:
        if file_format == "csv":
            return _read_csv(spark, paths, schema, corrupt_column)
        if file_format == "json":
            return _read_json(spark, paths, schema, corrupt_column)
        if file_format == "parquet":
            return spark.read.parquet(*paths)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            raise FileNotFoundError(f"no such input: {_shown(paths)}") from error
        raise OSError(f"cannot read {_shown(paths)}: {error}") from error
    raise ValueError(f"unsupported input format: {file_format}")


def header_differs(error: BaseException | None) -> bool:
    """Whether a load failed because a CSV file's header is not that of the others, and for no other reason.

    The reader's check comes wrapped in whatever job met it, so its own words are looked for along the chain of causes.
    """
    while error is not None:
        if any("CSV header" in str(part) for part in (error, getattr(error, "_stackTrace", ""))):
            return True
        error = getattr(error, "_cause", None) or error.__cause__
    return False


def first_lines(spark: SparkSession, names: Sequence[str]) -> list[tuple[str, str]]:
    """Each file with its first line that is not blank; files without one are left out."""
    return [(name, line) for name, line in zip(names, Files(spark).first_lines(names)) if line is not None]


def read_mixed(
    spark: SparkSession, paths: Sequence[str], schema: T.StructType, corrupt_column: str | None = None
) -> DataFrame:
    """CSV files whose headers differ in order or number of columns: one read for each header, united by name.

    The header line of every file is read, many at a time and without a job; columns that a file lacks are NULL.
    """
    files = Files(spark)
    every = [name for path in paths for name in (files.glob(path.rstrip("/") + "/*") or [path])]
    every = [name for name in every if not name.rsplit("/", 1)[1].startswith(("_", "."))]
    groups: dict[str, list[str]] = {}
    for name, header in first_lines(spark, every):
        groups.setdefault(header, []).append(name)
    parts = [read_files(spark, names, "csv", schema, corrupt_column) for _, names in sorted(groups.items())]
    if not parts:
        return spark.createDataFrame([], _with_corrupt(schema, corrupt_column))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def lost_cells(df: DataFrame, corrupt_column: str, file_format: str) -> dict[str, Column]:
    """For each column, true where the raw line holds a value that did not parse.

    `df` comes from `read_files` with that corrupt column; its columns are in the order of the header.
    """
    raw = T.StructType([T.StructField(f.name, T.StringType()) for f in df.schema.fields if f.name != corrupt_column])
    line = F.col(corrupt_column)
    if file_format == "csv":
        parsed = F.from_csv(line, ", ".join(f"`{name}` string" for name in raw.names), {"mode": "PERMISSIVE"})
    elif file_format == "json":
        parsed = F.from_json(line, raw)
    else:
        return {}
    return {
        name: line.isNotNull() & parsed.getField(name).isNotNull() & (parsed.getField(name) != "") & F.col(f"`{name}`").isNull()
        for name in raw.names
    }


def _shown(paths: list[str]) -> str:
    return paths[0] if len(paths) == 1 else f"{paths[0]} and {len(paths) - 1} more"


def _with_corrupt(schema: T.StructType, corrupt_column: str | None) -> T.StructType:
    if corrupt_column is None:
        return schema
    return T.StructType([*schema.fields, T.StructField(corrupt_column, T.StringType())])


def _read_csv(spark, paths, schema, corrupt_column):
    reader = spark.read.option("header", True)
    if schema is None:
        return reader.option("inferSchema", True).csv(paths)
    # Only the header line of the first day is read here. Columns are typed by name, whatever
    # their order; the reader then fails on a file whose header differs, and never misaligns.
    header = reader.csv(paths[0]).columns or schema.names
    typed = {field.name: field for field in schema.fields}
    ordered = T.StructType([typed.get(name, T.StructField(name, T.StringType())) for name in header])
    reader = reader.schema(_with_corrupt(ordered, corrupt_column)).option("enforceSchema", False)
    if corrupt_column:
        reader = reader.option("columnNameOfCorruptRecord", corrupt_column)
    return reader.option("mode", "PERMISSIVE").csv(paths)


def _read_json(spark, paths, schema, corrupt_column):
    reader = spark.read
    if schema is not None:
        reader = reader.schema(_with_corrupt(schema, corrupt_column))
    if corrupt_column:
        reader = reader.option("columnNameOfCorruptRecord", corrupt_column)
    return reader.option("mode", "PERMISSIVE").json(paths)
