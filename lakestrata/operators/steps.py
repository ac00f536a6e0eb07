"""Transformation steps. A step is a function from DataFrame to DataFrame, so steps chain with `transform`."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Mapping, Sequence
from dataclasses import dataclass
from datetime import datetime
from decimal import Decimal
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakestrata.functions.columns import converted, instant, named, quoted, total_value

Step = Callable[[DataFrame], DataFrame]

AGGREGATES = {"sum": F.sum, "avg": F.avg, "count": F.count, "min": F.min, "max": F.max}


def with_ingestion_timestamp(as_of: datetime | str) -> Step:
    """Add the load time, the same for every row of a load."""
    return lambda df: df.withColumn("_ingestion_timestamp", instant(as_of))


def where_equals(column: str, value: Any) -> Step:
    """Keep the rows whose column equals the value; NULL is dropped."""
    return lambda df: df.where(named(column) == F.lit(value))


def convert_currency(source: str, target: str, rate: float) -> Step:
    return lambda df: df.withColumn(target, converted(named(source), rate))


def line_total(quantity: str, unit_price: str, target: str) -> Step:
    return lambda df: df.withColumn(target, total_value(named(quantity), named(unit_price)))


def with_date(timestamp: str, target: str = "order_date") -> Step:
    """Add (or replace) the calendar date of a timestamp."""
    return lambda df: df.withColumn(target, F.to_date(named(timestamp)))


@dataclass(frozen=True)
class AggSpec:
    """One aggregate: `function(source) AS target`, cast to `type` if given."""

    source: str
    function: str
    target: str
    type: str | None = None

    def __post_init__(self):
        if self.function.lower() not in AGGREGATES:
            raise ValueError(f"unsupported aggregate function: {self.function}")

    def column(self) -> Column:
        result = AGGREGATES[self.function.lower()](named(self.source))
        return (result.try_cast(self.type) if self.type else result).alias(self.target)


def aggregate(group_by: Sequence[str], specs: Sequence[AggSpec], date_from: str | None = None) -> Step:
    """Group by some columns and aggregate others; `date_from` adds `order_date` first."""

    def step(df: DataFrame) -> DataFrame:
        dated = with_date(date_from)(df) if date_from else df
        return dated.groupBy(*(named(name) for name in group_by)).agg(*(spec.column() for spec in specs))

    return step


def totals(
    group_by: Sequence[str],
    specs: Sequence[AggSpec],
    levels: Sequence[Sequence[str]] | None = None,
    date_from: str | None = None,
    level_column: str = "total_level",
) -> Step:
    """The aggregates of several levels of grouping at once: by default all columns, then one fewer from the right, down to none.

    A level is a subset of `group_by`; the others are NULL in its rows. `total_level` tells such a NULL from one in the data:
    bit i from the right is set where the i-th column from the right is summed over. Rows are expanded once and summed in their
    tasks before the one shuffle, so a grand total is one row of each task. An empty table has a grand total, if that level is asked for.
    """
    wanted = [list(level) for level in levels] if levels is not None else [list(group_by[:n]) for n in range(len(group_by), -1, -1)]
    if strange := [name for level in wanted for name in level if name not in group_by]:
        raise ValueError(f"levels name columns that are not grouped by: {', '.join(strange)}")
    if not wanted:
        raise ValueError("no level is asked for")

    def step(df: DataFrame) -> DataFrame:
        dated = with_date(date_from)(df) if date_from else df
        if not group_by:
            return dated.agg(F.lit(0).cast("long").alias(level_column), *(spec.column() for spec in specs))
        sets = [[named(name) for name in level] for level in wanted]
        grouped = dated.groupingSets(sets, *(named(name) for name in group_by))
        return grouped.agg(F.grouping_id().alias(level_column), *(spec.column() for spec in specs))

    return step


#: What each aggregate is made of: functions of its source whose results can be merged.
PARTS = {"sum": ("sum",), "count": ("count",), "min": ("min",), "max": ("max",), "avg": ("sum", "count")}
MERGED = {"sum": F.sum, "count": F.sum, "min": F.min, "max": F.max}


@dataclass(frozen=True)
class Rollup:
    """An aggregate that can be computed in parts: `step()` is `aggregate`, and equals `merge` of any `partial` results together.

    Sums of decimals and whole numbers are exact, and so are averages of them; sums of doubles depend on the order of rows, as always.
    """

    group_by: Sequence[str]
    specs: Sequence[AggSpec]
    date_from: str | None = None

    def step(self) -> Step:
        return aggregate(self.group_by, self.specs, self.date_from)

    def partial(self, df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
        """One row per group (and `by`) with the mergeable states of every aggregate; a hot group is one row of each task."""
        dated = with_date(self.date_from)(df) if self.date_from else df
        states = {
            (spec.source, part): AGGREGATES[part](named(spec.source)).alias(self._state(spec, part))
            for spec in self.specs
            for part in PARTS[spec.function.lower()]
        }
        # a row whose type the final average is to have, whatever the parts are cast to
        means = {spec.source: F.avg(named(spec.source)).alias(self._state(spec, "mean")) for spec in self.specs if spec.function.lower() == "avg"}
        return dated.groupBy(*(named(name) for name in [*by, *self.group_by])).agg(*states.values(), *means.values())

    def merge(self, states: DataFrame) -> DataFrame:
        """The aggregates of all rows that the states stand for."""
        return states.groupBy(*(named(name) for name in self.group_by)).agg(*(self._merged(spec, states) for spec in self.specs))

    def _state(self, spec: AggSpec, part: str) -> str:
        return f"{spec.source}__{part}"

    def _merged(self, spec: AggSpec, states: DataFrame) -> Column:
        parts = [MERGED[part](named(self._state(spec, part))) for part in PARTS[spec.function.lower()]]
        if len(parts) == 1:
            result = parts[0]
        else:
            mean = states.schema[self._state(spec, "mean")].dataType
            result = F.when(parts[1] > 0, parts[0] / parts[1]).cast(mean)
        return (result.try_cast(spec.type) if spec.type else result).alias(spec.target)


def sql_step(sql: str, **values: Any) -> Step:
    """A step in SQL over `{input}`. Values are bound to `:name` markers, and column names to
    `IDENTIFIER(:name)`; nothing is pasted into the text."""
    if not sql or not sql.strip():
        raise NotImplementedError("the step has no SQL")
    return lambda df: df.sparkSession.sql(sql, args=values, input=df)


def template_step(sql: str, parameters: Mapping[str, Any]) -> Step:
    """A step from a template with `{input_view_or_df}` and `{parameter}` placeholders.

    A placeholder in back-quotes is a column name, any other a value (quotes around it belong to
    the placeholder). Names are quoted and values bound, so parameters cannot change the query.
    """
    if not sql or not sql.strip():
        raise NotImplementedError("the template has no SQL")

    def bind(match: re.Match) -> str:
        name = next(group for group in match.groups() if group)
        if name == "input_view_or_df":
            return "{input}"
        if name not in parameters:
            raise KeyError(f"the template needs the parameter {name}")
        if match.group(3) and sql[: match.start()].count("'") % 2:
            raise ValueError(f"the placeholder {name} stands inside a text literal, where no value can be bound")
        if match.group(1):
            # Doubled braces, for the text still passes through `{input}` formatting.
            return quoted(str(parameters[name])).replace("{", "{{").replace("}", "}}")
        return f":{name}"

    text = re.sub(r"`\{(\w+)\}`|'\{(\w+)\}'|\{(\w+)\}", bind, sql)
    values = {name: value for name, value in parameters.items() if f":{name}" in text}
    # In SQL text 5.0 is a decimal literal; bound as a Python float it would be a double.
    return sql_step(text, **{n: Decimal(str(v)) if isinstance(v, float) else v for n, v in values.items()})


def chain(df: DataFrame, steps: Iterable[Step]) -> DataFrame:
    return reduce(lambda current, step: current.transform(step), steps, df)


@dataclass(frozen=True)
class LayerStep:
    """A step and the layer it belongs to; without a layer it is a silver step."""

    step: Step
    layer: str = "silver"


def steps_for(layer: str, steps: Iterable[LayerStep]) -> list[Step]:
    """The steps of a layer in listed order; gold must have at least one."""
    chosen = [item.step for item in steps if item.layer == layer]
    if layer == "gold" and not chosen:
        raise ValueError("no step is defined for the gold layer")
    return chosen
