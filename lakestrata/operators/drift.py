"""What changed between two versions of a table: rows added, removed and changed, and in which columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakestrata.functions.columns import named


def cell_hash(name: str) -> Column:
    """64 bits of a cell; NULL differs from every value."""
    return F.when(named(name).isNotNull(), F.xxhash64(F.lit(name), named(name)))


def version_drift(old: DataFrame, new: DataFrame, keys: Sequence[str], columns: Sequence[str] | None = None) -> DataFrame:
    """One row per key that differs: `change`, the rows only the old and only the new version holds, and the changed columns.

    Compared are `columns`, or all that both versions have, cell by cell, by hash. Rows are counted per key and cell hashes, with equal rows
    summed in their tasks before the shuffle, and what both versions hold as often is dropped behind it: a key with many rows is spread by
    its contents, and only differences are grouped by key. No text of either version is shuffled but the keys.

    A key is `added` or `removed` if all that differs is on one side (also a further copy of a row that is there),
    otherwise `changed`. `changed_columns` is given where one row stands against one; with more it is NULL, for no row is the
    successor of another. NULL is a key like any other. Types must agree, or the column counts as changed.
    """
    if not keys:
        raise ValueError("versions are compared by a key")
    both = [name for name in old.columns if name in new.columns]
    compared = [name for name in (columns if columns is not None else both) if name not in keys]
    if strange := [name for name in [*keys, *compared] if name not in both]:
        raise ValueError(f"not in both versions: {', '.join(strange)}")
    short = [f"__key{i}" for i in range(len(keys))]

    def side(df: DataFrame, before: int) -> DataFrame:
        cells = F.array(*map(cell_hash, compared)) if compared else F.array().cast("array<bigint>")
        return df.select(
            *(named(name).alias(key) for name, key in zip(keys, short)), cells.alias("__cells"), F.lit(1 - 2 * before).cast("long").alias("__sign")
        )

    surplus = F.sum("__sign")
    rows = side(old, 1).unionByName(side(new, 0)).groupBy(*short, "__cells").agg(surplus.alias("__surplus")).where("__surplus != 0")
    gone, came = F.col("__surplus") < 0, F.col("__surplus") > 0
    per_key = rows.groupBy(*short).agg(
        F.sum(F.when(gone, -F.col("__surplus")).otherwise(0)).alias("old_rows"),
        F.sum(F.when(came, F.col("__surplus")).otherwise(0)).alias("new_rows"),
        F.max(F.when(gone, F.col("__cells"))).alias("__before"),
        F.max(F.when(came, F.col("__cells"))).alias("__after"),
    )
    changed = F.array_compact(
        F.array(*(F.when(~F.col("__before")[i].eqNullSafe(F.col("__after")[i]), F.lit(name)) for i, name in enumerate(compared)))
        if compared
        else F.array().cast("array<string>")
    )
    single = (F.col("old_rows") == 1) & (F.col("new_rows") == 1)
    kind = F.when(F.col("old_rows") == 0, "added").when(F.col("new_rows") == 0, "removed").otherwise("changed")
    return per_key.select(
        *(F.col(key).alias(name) for key, name in zip(short, keys)),
        kind.alias("change"),
        "old_rows",
        "new_rows",
        F.when(single, changed).alias("changed_columns"),
    )


def drift_summary(drift: DataFrame) -> DataFrame:
    """Keys and rows per kind of change, and per changed column (`column_name` NULL: the kind as a whole)."""
    whole, changed = F.array(F.lit(None).cast("string")), F.coalesce("changed_columns", F.array().cast("array<string>"))
    per_column = drift.select("change", "old_rows", "new_rows", F.explode(F.concat(whole, changed)).alias("column_name"))
    return per_column.groupBy("change", "column_name").agg(
        F.count(F.lit(1)).alias("keys"), F.sum("old_rows").alias("old_rows"), F.sum("new_rows").alias("new_rows")
    )
