"""Data contracts: layer schemas, and conformance counted in one pass over the data."""

from __future__ import annotations

import warnings
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from datetime import datetime
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakestrata.functions.columns import any_of, instant, named
from lakestrata.operators.duplicates import key_counts
from lakestrata.operators.quality import success_percentage

# Contract type names that Spark spells differently.
TYPE_NAMES = {"long": "bigint", "integer": "int"}


@dataclass(frozen=True)
class ContractColumn:
    name: str
    type: str
    not_null: bool = False
    primary_key: bool = False
    comment: str = ""

    @property
    def spark_type(self) -> str:
        return TYPE_NAMES.get(self.type, self.type)


# Added by the load itself, so it is in no contract.
INGESTION_TIMESTAMP = ContractColumn("_ingestion_timestamp", "timestamp", comment="Time of the load")


@dataclass(frozen=True)
class CalculatedField:
    name: str
    formula: str
    type: str


@dataclass(frozen=True)
class CustomRule:
    name: str
    expression: str
    severity: str = "critical"


@dataclass(frozen=True)
class Contract:
    columns: tuple[ContractColumn, ...]
    layers: Mapping[str, Sequence[str]] = field(default_factory=dict)
    calculated: tuple[CalculatedField, ...] = ()
    custom_rules: tuple[CustomRule, ...] = ()
    completeness: float | None = None
    max_latency_minutes: int | None = None

    @classmethod
    def from_dict(cls, document: Mapping[str, Any], layers: Mapping[str, Sequence[str]] | None = None) -> Contract:
        """A contract from its JSON document; columns without name or type are left out."""
        specification = document.get("schema_specification", {})
        metrics = document.get("quality_metrics", {})
        columns = []
        for column in specification.get("structural", {}).get("columns", []):
            if not column.get("name") or not column.get("data_type"):
                warnings.warn(f"contract column without name or type: {column}", stacklevel=2)
                continue
            constraints = column.get("constraints", [])
            columns.append(
                ContractColumn(
                    name=column["name"],
                    type=column["data_type"],
                    not_null="not_null" in constraints,
                    primary_key="primary_key" in constraints,
                    comment=column.get("description", ""),
                )
            )
        return cls(
            columns=tuple(columns),
            layers=layers or {},
            calculated=tuple(
                CalculatedField(f["name"], f["formula"], f["precision"])
                for f in specification.get("semantic", {}).get("calculated_fields", [])
            ),
            custom_rules=tuple(
                CustomRule(r["name"], r["expression"], r.get("error_severity", "critical"))
                for r in metrics.get("custom_rules", [])
            ),
            completeness=metrics.get("completeness", {}).get("threshold"),
            max_latency_minutes=metrics.get("freshness", {}).get("max_latency_minutes"),
        )

    def of_layer(self, layer: str) -> list[ContractColumn]:
        """The columns of a layer in layer order; a name the contract lacks is skipped with a warning."""
        known = {column.name: column for column in (INGESTION_TIMESTAMP, *self.columns)}
        wanted = self.layers[layer]
        for name in wanted:
            if name not in known:
                warnings.warn(f"column {name} of layer {layer} is not in the contract", stacklevel=2)
        return [known[name] for name in wanted if name in known]

    def schema(self, layer: str) -> T.StructType:
        # Nullable throughout: a reader cannot promise what the not_null check is there to find.
        ddl = ", ".join(f"`{column.name}` {column.spark_type}" for column in self.of_layer(layer))
        parsed = T.StructType.fromDDL(ddl)
        return T.StructType(
            [
                T.StructField(f.name, f.dataType, True, {"comment": column.comment} if column.comment else None)
                for f, column in zip(parsed.fields, self.of_layer(layer), strict=True)
            ]
        )

    def raw_schema(self, layer: str) -> T.StructType:
        """The same columns as text, to count what a cast to the contract types would lose."""
        return T.StructType([T.StructField(column.name, T.StringType()) for column in self.of_layer(layer)])


def project(df: DataFrame, contract: Contract, layer: str, keep: Sequence[str] = ()) -> DataFrame:
    """The columns of a layer in their contract types, with the contract's comments; and those to `keep` as they are."""
    return df.select(
        *(
            named(c.name).try_cast(c.spark_type).alias(c.name, metadata={"comment": c.comment})
            for c in contract.of_layer(layer)
            if c.name not in keep
        ),
        *map(named, keep),
    )


def conformance(df: DataFrame, contract: Contract, checks: Sequence[str] | None = None) -> DataFrame:
    """One row per check and subject: records checked, records failing, percentage, threshold met.

    Checks are `type` (values lost by the cast), `not_null`, `completeness` (percentage of
    non-NULL values against the contract's threshold) and `custom` (the contract's own rules).
    All are counted by a single aggregate over the columns they name.
    """
    counters: list[tuple[str, str, str, Column, float]] = []
    for column in contract.columns:
        if column.name not in df.columns:
            continue
        value = named(column.name)
        lost = value.isNotNull() & value.try_cast(column.spark_type).isNull()
        counters.append(("type", column.name, "", lost, 100.0))
        if column.not_null:
            counters.append(("not_null", column.name, "", value.isNull(), 100.0))
        if contract.completeness is not None:
            counters.append(("completeness", column.name, "", value.isNull(), float(contract.completeness)))
    for rule in contract.custom_rules:
        counters.append(("custom", rule.name, rule.severity, ~F.expr(rule.expression), 100.0))
    chosen = [counter for counter in counters if checks is None or counter[0] in checks]
    if not chosen:
        raise ValueError("the contract has none of these checks for the data")

    counts = df.agg(
        F.count(F.lit(1)).alias("total_records"),
        *(F.count_if(failing).alias(f"_failing_{n}") for n, (_, _, _, failing, _) in enumerate(chosen)),
    )
    entries = [
        F.struct(
            F.lit(check).alias("check_name"),
            F.lit(subject).alias("subject"),
            F.lit(level).alias("severity"),
            F.col(f"_failing_{n}").alias("failing_records"),
            F.lit(threshold).alias("_threshold"),
        )
        for n, (check, subject, level, _, threshold) in enumerate(chosen)
    ]
    percentage = success_percentage(F.col("total_records"), F.col("failing_records"))
    return (
        counts.select("total_records", F.inline(F.array(*entries)))
        .withColumn("success_percentage", percentage)
        .withColumn("conforms", F.col("success_percentage") >= F.col("_threshold"))
        .drop("_threshold")
    )


def primary_key_violations(df: DataFrame, contract: Contract) -> DataFrame:
    """Key values that occur more than once, and how often. (NULL keys are the not_null check's.)"""
    keys = [column.name for column in contract.columns if column.primary_key]
    if not keys:
        raise ValueError("the contract has no primary key")
    return key_counts(df, keys).where(F.col("_key_rows") > 1).withColumnRenamed("_key_rows", "occurrences")


def calculated_violations(df: DataFrame, contract: Contract) -> DataFrame:
    """Rows where a calculated field is not what its formula gives, with the field and the expected value.

    One scan for all fields; a row with two wrong fields comes twice. Expected values of several fields share a
    column, which then has their common type (text, if there is no other).
    """
    if not contract.calculated:
        raise ValueError("the contract has no calculated field")
    wrong, entries = [], []
    kinds = {item.type for item in contract.calculated}
    for item in contract.calculated:
        expected = F.expr(item.formula).try_cast(item.type)
        wrong.append(~named(item.name).eqNullSafe(expected))
        shown = expected if len(kinds) == 1 else expected.cast("string")
        entries.append(F.when(wrong[-1], F.struct(F.lit(item.name).alias("field"), shown.alias("expected"))))
    return df.where(any_of(wrong)).select("*", F.inline(F.array_compact(F.array(*entries))))


def freshness(df: DataFrame, timestamp: str, as_of: datetime | str, max_latency_minutes: int) -> DataFrame:
    """Age in minutes of the latest row at `as_of`, and whether it is within the limit."""
    latest = F.max(named(timestamp).cast("timestamp"))
    seconds = F.unix_timestamp(instant(as_of)) - F.unix_timestamp("latest")
    return (
        df.agg(latest.alias("latest"))
        .withColumn("latency_minutes", F.floor(seconds / 60))
        .withColumn("fresh", F.coalesce(seconds <= max_latency_minutes * 60, F.lit(False)))
    )


#: Intervals of one range: neighbours within a range are found by a window over that range alone.
RANGE_BITS = 12
#: Ranges are numbered from here, so that no number is negative, and in 20 bits, for any moment of the years 1 to 9999 and interval of an hour or more.
FIRST_RANGE, NUMBER_BITS = 1 << 15, 20


def load_gaps(
    df: DataFrame, timestamp: str, expected_interval_hours: int = 24, by: Sequence[str] = ()
) -> DataFrame:
    """Neighbouring loads that lie further apart than the expected interval, for each value of `by`.

    Moments are cut to the interval, in UTC. Distinct intervals with a load are put in ranges of 4,096, and neighbours
    are found range by range, so no task sees all loads of a hot value, nor of the whole table without `by`. The first load of a range
    finds its predecessor by a join: all earlier ranges make up one aligned block per bit that is set in its number, and each block knows its
    last load.
    """
    seconds = int(expected_interval_hours * 3600)
    keys = [f"__by{i}" for i in range(len(by))]
    slot = F.floor(F.unix_timestamp(named(timestamp).cast("timestamp")) / seconds)
    loads = df.select(*(named(name).alias(key) for name, key in zip(by, keys)), slot.alias("__load")).na.drop(subset=["__load"]).distinct()
    number = (F.shiftright("__load", RANGE_BITS) + FIRST_RANGE).alias("__range")
    ranged = loads.select("*", number)
    beside = ranged.withColumn("__previous", F.lag("__load").over(W.partitionBy(*keys, "__range").orderBy("__load")))

    bits = F.sequence(F.lit(0), F.lit(NUMBER_BITS))
    lasts = ranged.groupBy(*keys, "__range").agg(F.max("__load").alias("__last"))
    blocks = (
        lasts.select("*", F.explode(bits).alias("__bit"))
        .groupBy(*keys, "__bit", F.expr("shiftright(__range, __bit)").alias("__block"))
        .agg(F.max("__last").alias("__last"))
    )
    earlier = beside.where(F.col("__previous").isNull()).select(
        *keys, "__load", F.expr(f"explode(filter(sequence(0, {NUMBER_BITS}), b -> shiftright(__range, b) % 2 = 1))").alias("__bit"), "__range"
    )
    earlier = earlier.select(*keys, "__load", "__bit", F.expr("shiftright(__range, __bit) - 1").alias("__block"))
    left, right = earlier.alias("left"), blocks.alias("right")
    same = F.lit(True)
    for name in [*keys, "__bit", "__block"]:
        same = same & F.col(f"left.{name}").eqNullSafe(F.col(f"right.{name}"))
    found = left.join(right, same).groupBy(*(F.col(f"left.{key}").alias(key) for key in keys), F.col("left.__load").alias("__load"))
    across = found.agg(F.max("right.__last").alias("__previous"))
    pairs = beside.where(F.col("__previous").isNotNull()).select(*keys, "__load", "__previous").unionByName(across)
    apart = F.col("__load") - F.col("__previous")
    return pairs.where(apart > 1).select(
        *(F.col(key).alias(name) for key, name in zip(keys, by)),
        F.timestamp_seconds(F.col("__load") * seconds).alias("loaded_at"),
        F.timestamp_seconds(F.col("__previous") * seconds).alias("previous_at"),
        F.floor(apart * seconds / 3600).alias("gap_hours"),
    )
