"""Rows whose key occurs more than once, with the keys counted once for all that is done with them.

The keys are counted over the key columns alone, and those that occur more than once are stored. How many
rows they have, which rows go to quarantine and which go on is all read from that table. It is
joined without a hint: Spark broadcasts it if its stored size is small, and the wide rows are not
shuffled at all. If not, the join is one in which AQE splits a hot key (or the NULLs) over many tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from lakestrata.functions.columns import any_of, named
from lakestrata.session import clear_scratch, scratch_dir

ROWS = "_key_rows"


def key_counts(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows per non-NULL key: counted before the shuffle, so a hot key costs one row per task."""
    return df.where(~_has_null(keys)).groupBy(*(named(key) for key in keys)).agg(F.count(F.lit(1)).alias(ROWS))


def _has_null(keys: Sequence[str]) -> Column:
    return any_of([named(key).isNull() for key in keys])


class DuplicatedKeys:
    """The duplicated keys of some rows. Each set of key columns is counted on its first use, by one job."""

    def __init__(self, df: DataFrame):
        self.df = df
        self._found: dict[tuple[str, ...], tuple[DataFrame | None, int]] = {}
        self._paths: list[str] = []

    def _count(self, keys: Sequence[str]) -> tuple[DataFrame | None, int]:
        keys = tuple(keys)
        if keys not in self._found:
            path = scratch_dir(self.df.sparkSession, "duplicated-keys")
            self._paths.append(path)
            seen = Observation()
            counts = key_counts(self.df, keys).where(F.col(ROWS) > 1)
            counts.observe(seen, F.sum(ROWS).alias("rows")).write.parquet(path)
            rows = seen.get.get("rows") or 0
            table = self.df.sparkSession.read.schema(counts.schema).parquet(path) if rows else None
            self._found[keys] = table, rows
        return self._found[keys]

    def of(self, keys: Sequence[str]) -> DataFrame | None:
        """The keys that occur more than once, and how often; None if there are none."""
        return self._count(keys)[0]

    def rows(self, keys: Sequence[str]) -> int:
        """How many rows have such a key."""
        return self._count(keys)[1]

    def clear(self) -> None:
        """Delete the stored keys."""
        clear_scratch(self._paths)
        self._paths, self._found = [], {}


def rows_with_duplicated_key(df: DataFrame, keys: Sequence[str], duplicates: DuplicatedKeys | None = None) -> DataFrame:
    """Every row whose key occurs more than once. NULL keys match nothing, so they are left out.

    `duplicates` holds the keys of all rows, of which `df` may be a part; without it they are counted here.
    """
    found = (duplicates or DuplicatedKeys(df)).of(keys)
    return df.where(F.lit(False)) if found is None else df.join(found.drop(ROWS), list(keys), "left_semi")


def rows_without_duplicated_key(df: DataFrame, keys: Sequence[str], duplicates: DuplicatedKeys | None = None) -> DataFrame:
    """The other rows, those with a NULL key among them."""
    found = (duplicates or DuplicatedKeys(df)).of(keys)
    return df if found is None else df.join(found.drop(ROWS), list(keys), "left_anti")
