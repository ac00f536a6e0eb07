"""Column profiles per partition that unite for any range of days, without reading the rows again.

A profile row holds, for one column of one partition, counts, extremes and two mergeable sketches: HyperLogLog for the number of distinct
values and KLL for quantiles of numbers. All columns are one aggregate over one scan; a sketch has some kilobytes whatever it stands for.

Counts, extremes and completeness are exact. Distinct counts have a standard error of `DISTINCT_ERROR`, and a quantile's rank is
off by at most about `RANK_ERROR` of the values.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakestrata.functions.columns import named
from lakestrata.operators.quality import success_percentage
from lakestrata.sources.lake import overwrite_partitions

LOG_REGISTERS, KLL_K = 12, 200
DISTINCT_ERROR = 1.04 / 2 ** (LOG_REGISTERS / 2)
RANK_ERROR = 0.0133
QUANTILES = (0.25, 0.5, 0.75)


def _is_number(kind: T.DataType) -> bool:
    return isinstance(kind, T.NumericType)


def _measures(name: str, kind: T.DataType) -> Column:
    """The profile of one column as a struct of aggregates."""
    column, number = named(name), _is_number(kind)
    as_number = column.cast("double") if number else F.lit(None).cast("double")
    as_text = F.lit(None).cast("string") if number else column.cast("string")
    hashed = column if isinstance(kind, (T.IntegerType, T.LongType, T.StringType)) else column.cast("string")
    return F.struct(
        F.lit(name).alias("column_name"),
        F.count(F.lit(1)).alias("total"),
        F.count_if(column.isNull()).alias("nulls"),
        F.min(as_number).alias("least_number"),
        F.max(as_number).alias("greatest_number"),
        F.min(as_text).alias("least_text"),
        F.max(as_text).alias("greatest_text"),
        F.call_function("hll_sketch_agg", hashed, F.lit(LOG_REGISTERS)).alias("values"),
        (F.call_function("kll_sketch_agg_double", as_number, F.lit(KLL_K)) if number else F.lit(None).cast("binary")).alias("ranks"),
    )


def profile(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """One row per column (and partition given by `by`), by one aggregate."""
    measures = F.array(*(_measures(name, df.schema[name].dataType) for name in columns))
    found = df.groupBy(*map(named, by)).agg(measures.alias("_profiles"))
    return found.select(*map(named, by), F.inline("_profiles"))


def save_profiles(df: DataFrame, columns: Sequence[str], path: str, by: Sequence[str]) -> int:
    """Store the profiles of the partitions in `df` in place of what was stored of them."""
    return overwrite_partitions(profile(df, columns, by), path, by)


def united(profiles: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Profiles of many partitions as one per column (and what `by` names, such as a month)."""
    return profiles.groupBy(*map(named, by), "column_name").agg(
        F.sum("total").alias("total"),
        F.sum("nulls").alias("nulls"),
        F.min("least_number").alias("least_number"),
        F.max("greatest_number").alias("greatest_number"),
        F.min("least_text").alias("least_text"),
        F.max("greatest_text").alias("greatest_text"),
        F.call_function("hll_union_agg", F.col("values")).alias("values"),
        F.call_function("kll_merge_agg_double", F.col("ranks")).alias("ranks"),
    )


def report(profiles: DataFrame, quantiles: Sequence[float] = QUANTILES) -> DataFrame:
    """Profiles with estimates in place of sketches: `distinct_values`, and `quantiles` of numbers in the given order (else NULL)."""
    has_values = F.col("least_number").isNotNull()
    quantile = [F.when(has_values, F.call_function("kll_sketch_get_quantile_double", F.col("ranks"), F.lit(q))) for q in quantiles]
    return profiles.select(
        *(c for c in profiles.columns if c not in ("values", "ranks")),
        success_percentage(F.col("total"), F.col("nulls")).alias("completeness"),
        F.call_function("hll_sketch_estimate", F.col("values")).alias("distinct_values"),
        F.when(has_values, F.array(*quantile)).alias("quantiles"),
    )
