"""Uniqueness of keys across load days, over a stored table of keys that is bucketed by key.

Each load leaves one row per key: how often it occurred. The table is partitioned by load day, so loading a day again replaces its keys,
and bucketed by key, so that joining it with a load, or grouping it, shuffles no stored row: only the new load's keys,
counted before, are dealt out to the buckets. A hot key is one row per load.

The table lives in files under a path; each session that opens it registers these files in its own catalog.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakestrata.functions.columns import named, quoted
from lakestrata.operators.duplicates import key_counts
from lakestrata.sources.lake import slice_path
from lakestrata.sources.storage import Files

LOAD, OCCURRENCES, ELSEWHERE, FIRST = "load_date", "occurrences", "elsewhere", "first_load"
#: Files per load day, and tasks of a join; a table keeps the number it was made with.
BUCKETS = 64
OVERWRITE_MODE = "spark.sql.sources.partitionOverwriteMode"


class KeyHistory:
    """The keys of all loads of a table. `key_types` are Spark types by key column; NULL keys are not kept."""

    def __init__(self, spark: SparkSession, path: str, key_types: dict[str, str], buckets: int = BUCKETS):
        self.spark, self.keys, self.buckets = spark, list(key_types), buckets
        located = Files(spark).qualified(path)
        self.path = located
        self.name = f"key_history_{hashlib.sha256(located.encode()).hexdigest()[:16]}"
        columns = ", ".join(f"{quoted(name)} {kind}" for name, kind in key_types.items())
        listed = ", ".join(map(quoted, self.keys))
        there = spark.catalog.tableExists(self.name)
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.name} ({columns}, {OCCURRENCES} BIGINT, {LOAD} DATE) USING parquet "
            f"PARTITIONED BY ({LOAD}) CLUSTERED BY ({listed}) SORTED BY ({listed}) INTO {int(buckets)} BUCKETS LOCATION '{located}'"
        )
        if not there and Files(spark).glob(slice_path(located, {LOAD: "*"})):
            spark.catalog.recoverPartitions(self.name)

    def _counts(self, df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
        """Occurrences per key (and load), dealt out to the buckets."""
        counts = key_counts(df, [*self.keys, *by])
        counts = counts.withColumnRenamed(counts.columns[-1], OCCURRENCES)
        return counts.repartition(self.buckets, *map(named, self.keys))

    def all(self) -> DataFrame:
        return self.spark.table(self.name)

    def replace(self, df: DataFrame, load: date) -> None:
        """Store the keys of one load in place of those of an earlier load of that day."""
        self.replace_all(df.withColumn(LOAD, F.lit(load)))

    def replace_all(self, df: DataFrame) -> None:
        """The same for many loads at once; `df` tells the day of each row in `load_date`."""
        columns = [*map(named, self.keys), F.col(OCCURRENCES), F.col(LOAD).cast("date")]
        before = self.spark.conf.get(OVERWRITE_MODE)
        self.spark.conf.set(OVERWRITE_MODE, "dynamic")
        try:
            self._counts(df, [LOAD]).select(*columns).write.insertInto(self.name, overwrite=True)
        finally:
            self.spark.conf.set(OVERWRITE_MODE, before)

    def forget(self, load: date) -> None:
        self.spark.sql(f"ALTER TABLE {self.name} DROP IF EXISTS PARTITION ({LOAD} = DATE '{load.isoformat()}')")
        Files(self.spark).delete(slice_path(self.path, {LOAD: load.isoformat()}))

    def repeated_in(self, df: DataFrame, load: date) -> DataFrame:
        """Keys of a load that are not unique: occurrences in it, elsewhere in other loads, and the first of those.

        The load itself need not be stored; if it is, what is stored of it does not count.
        """
        others = self.all().where(F.col(LOAD) != F.lit(load)).groupBy(*map(named, self.keys))
        others = others.agg(F.sum(OCCURRENCES).alias(ELSEWHERE), F.min(LOAD).alias(FIRST))
        met = self._counts(df).join(others, self.keys, "left").withColumn(ELSEWHERE, F.coalesce(ELSEWHERE, F.lit(0)))
        return met.where((F.col(OCCURRENCES) > 1) | (F.col(ELSEWHERE) > 0)).select(*map(named, self.keys), OCCURRENCES, ELSEWHERE, FIRST)

    def repeated(self) -> DataFrame:
        """Keys that occur more than once in all stored loads: how often, in how many loads, and the first of them."""
        sums = self.all().groupBy(*map(named, self.keys))
        sums = sums.agg(F.sum(OCCURRENCES).alias(OCCURRENCES), F.count(F.lit(1)).alias("loads"), F.min(LOAD).alias(FIRST))
        return sums.where(F.col(OCCURRENCES) > 1)
