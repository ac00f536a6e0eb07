"""Helpers of the text operators: tables, shared folders, ASCII lower case, a session's Arrow settings."""

from __future__ import annotations

import string
import tempfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakestrata.session import has_folder, scratch_dir, use_folder


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def new_folder(spark: SparkSession, name: str) -> str:
    """A new folder for tables written half-way, in the session's shared folder; `session.clear_scratch` deletes it.

    A local session that names no folder gets one of its own; a cluster must name it.
    """
    if not has_folder(spark) and spark.sparkContext.master.startswith("local"):
        use_folder(spark, tempfile.mkdtemp(prefix="lakestrata-llm-"))
    return scratch_dir(spark, f"llm-{name}")


def stored(df: DataFrame, path: str) -> DataFrame:
    """Write `df` and read it back: later steps start from files that survive a lost executor."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ascii_lower(column: Column | str) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(column, string.ascii_uppercase, string.ascii_lowercase)


def whole_text(column: str = "text") -> Column:
    """The text, with null as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def fold(column: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 3: labels of remainder 1 are held out."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % 3


@contextmanager
def settings(spark: SparkSession, **values: str) -> Iterator[None]:
    """Set session settings (dots written as `__`) and put the old ones back."""
    names = {key.replace("__", "."): str(value) for key, value in values.items()}
    before = {key: spark.conf.get(key, None) for key in names}
    try:
        for key, value in names.items():
            spark.conf.set(key, value)
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)
