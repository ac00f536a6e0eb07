"""Data-quality rules: all rules of a run counted in one pass, graded, gated and quarantined."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from lakestrata.functions.columns import any_of, named
from lakestrata.operators.duplicates import ROWS, DuplicatedKeys, rows_with_duplicated_key, rows_without_duplicated_key
from lakestrata.sources.lake import overwrite_slice, read_slices, slice_path
from lakestrata.sources.storage import Files

# Statuses of a rule by severity.
SEVERITY = {"PASS": 0, "SKIP": 0, "WARNING": 1, "ERROR": 2, "EXECUTION_ERROR": 2}
# Actions that are carried out here; others are only reported.
ACTIONS = ("log", "quarantine", "abort_pipeline")
# A rule that fails one row of so many or more has its rows quarantined where they are found.
PLENTY = 8

RESULT_COLUMNS = [
    "pipeline_id",
    "target_layer",
    "processing_date",
    "rule_id",
    "status",
    "success_percentage",
    "total_records",
    "failing_records",
]
RESULT_SCHEMA = (
    "pipeline_id string, target_layer string, processing_date string, rule_id string, status string, "
    "success_percentage double, total_records bigint, failing_records bigint"
)
_DAY = "_checked_day"


@dataclass(frozen=True)
class Rule:
    """A rule, its thresholds in percent and the actions for each outcome.

    A condition decides if there is one; otherwise the type does (`completeness`, `uniqueness`).
    """

    rule_id: str
    type: str
    column: str | None = None
    condition: str | None = None
    warning: float = 100.0
    error: float = 100.0
    on_warning: tuple[str, ...] = ()
    on_error: tuple[str, ...] = ()

    @classmethod
    def from_dict(cls, rule: Mapping[str, Any]) -> Rule:
        thresholds, actions = rule.get("thresholds", {}), rule.get("actions", {})
        return cls(
            rule_id=rule["rule_id"],
            type=rule["type"],
            column=rule.get("target", {}).get("column"),
            condition=rule.get("condition", {}).get("sql"),
            warning=thresholds.get("warning", 100.0),
            error=thresholds.get("error", 100.0),
            on_warning=tuple(actions.get("on_warning", ())),
            on_error=tuple(actions.get("on_error", ())),
        )

    @property
    def unique_key(self) -> str | None:
        return self.column if self.type == "uniqueness" and not self.condition else None

    def failing(self) -> Column | None:
        """True for a failing row; NULL (not failing) where the condition is NULL."""
        if self.condition:
            return ~F.expr(self.condition)
        if self.type == "completeness" and self.column:
            return named(self.column).isNull()
        return None

    def actions(self, status: str) -> tuple[str, ...]:
        return {"ERROR": self.on_error, "WARNING": self.on_warning}.get(status, ())


class DataQualityError(Exception):
    """A layer of a pipeline is not good enough on some day to go on."""

    def __init__(self, pipeline_id: str, layer: str, day: str, results: Sequence[Row] = ()):
        self.pipeline_id, self.layer, self.day, self.results = pipeline_id, layer, day, list(results)
        failed = ", ".join(row["rule_id"] for row in self.results if SEVERITY[row["status"]] == 2)
        super().__init__(f"{pipeline_id}: the check of {layer} on {day} failed" + (f" ({failed})" if failed else ""))


@dataclass(frozen=True)
class Profile:
    """Rules that belong together, and the layers they are meant for (None: all)."""

    rules: tuple[Rule, ...]
    layers: frozenset[str] | None

    def covers(self, layer: str) -> bool:
        return self.layers is None or layer in self.layers


@dataclass(frozen=True)
class RuleDocument:
    """A rule document: its profiles, and the rules that stand beside them."""

    profiles: tuple[Profile, ...]
    common: tuple[Rule, ...]
    allow_partial_success: bool = False

    @classmethod
    def from_dict(cls, document: Mapping[str, Any]) -> RuleDocument:
        single, several = document.get("quality_profile"), document.get("quality_profiles")
        listed = several if isinstance(several, list) else []
        handling = document.get("global_config", {}).get("error_handling", {})

        def rules(holder: Mapping[str, Any]) -> tuple[Rule, ...]:
            return tuple(map(Rule.from_dict, holder.get("rules", ())))

        return cls(
            profiles=tuple(
                Profile(rules(item), frozenset(item["scope"]) if "scope" in item else None)
                for item in (listed if single is None else [single])
            ),
            common=rules(document),
            allow_partial_success=bool(handling.get("allow_partial_success", False)),
        )

    def rules(self, layer: str) -> list[Rule]:
        """The rules for a layer. Common ones need a profile that covers it, if there are profiles."""
        covering = [profile for profile in self.profiles if profile.covers(layer)]
        if self.profiles and not covering:
            return []
        return [rule for profile in covering for rule in profile.rules] + list(self.common)


def rules_for(document: Mapping[str, Any], layer: str) -> list[Rule]:
    """The rules of a rule document that apply to a layer."""
    return RuleDocument.from_dict(document).rules(layer)


def is_broken(df: DataFrame, rule: Rule) -> bool:
    """Whether Spark cannot resolve the rule against the data (analysis only, no job)."""
    try:
        if rule.unique_key:
            df.select(named(rule.unique_key))
        elif (failing := rule.failing()) is not None:
            df.where(failing)
        return False
    except AnalysisException:
        return True


def evaluate(
    df: DataFrame,
    rules: Sequence[Rule],
    pipeline_id: str,
    target_layer: str,
    processing_date: str | Column,
    duplicates: DuplicatedKeys | None = None,
    day_column: str | None = None,
) -> DataFrame:
    """One graded row per rule; with a date column instead of a date, one per rule and day.

    All row rules share one aggregate over the columns they need. Each uniqueness key adds one grouped
    count, unless `duplicates` brings the stored keys (counted within `day_column`, if days are checked).
    Nothing is cached and no rows but the counters leave the tasks.
    """
    by_day = isinstance(processing_date, Column)
    checked = df.withColumn(_DAY, processing_date) if by_day else df
    by = [_DAY] if by_day else []

    broken = {rule.rule_id for rule in rules if is_broken(df, rule)}
    unique = [rule for rule in rules if rule.unique_key and rule.rule_id not in broken]
    shared = [rule for rule in rules if rule not in unique or duplicates]
    known = {
        rule.rule_id: _known_failing(duplicates, rule.unique_key, day_column if by_day else None)
        for rule in unique
        if duplicates
    }
    parts = [_count_rows(checked, by, shared, broken, known)] if shared else []
    if not duplicates:
        parts += [
            _count_duplicates(checked, by, key, [rule for rule in unique if rule.unique_key == key])
            for key in dict.fromkeys(rule.unique_key for rule in unique)
        ]
    if not parts:
        return _graded(_count_rows(checked, by, [], broken), pipeline_id, target_layer, processing_date)
    results = parts[0]
    for part in parts[1:]:
        results = results.unionByName(part)
    return _graded(results, pipeline_id, target_layer, processing_date)


def _known_failing(duplicates: DuplicatedKeys, key: str, day_column: str | None) -> int | DataFrame:
    """Rows with a duplicated key: a number, or one per day."""
    if day_column is None:
        return duplicates.rows([key])
    found = duplicates.of([day_column, key])
    if found is None:
        return 0
    return found.groupBy(named(day_column).alias(_DAY)).agg(F.sum(ROWS).alias("_failing"))


def _count_rows(
    df: DataFrame,
    by: list[str],
    rules: list[Rule],
    broken: set[str],
    known: Mapping[str, int | DataFrame] | None = None,
) -> DataFrame:
    counters, entries, joined = [], [], []
    for position, rule in enumerate(rules):
        found = (known or {}).get(rule.rule_id)
        failing = None if rule.rule_id in broken or found is not None else rule.failing()
        kind = "broken" if rule.rule_id in broken else "skip" if failing is None and found is None else "check"
        number = F.lit(0)
        if isinstance(found, DataFrame):
            joined.append(found.withColumnRenamed("_failing", f"_failing_{position}"))
            number = F.coalesce(F.col(f"_failing_{position}"), F.lit(0))
        elif found is not None:
            number = F.lit(found)
        elif failing is not None:
            counters.append(F.count_if(failing).alias(f"_failing_{position}"))
            number = F.col(f"_failing_{position}")
        entries.append(_entry(rule, kind, number))
    counts = df.groupBy(*by).agg(F.count(F.lit(1)).alias("total_records"), *counters)
    for table in joined:  # a row per day on either side
        counts = counts.join(table, by, "left")
    if not entries:
        none = Rule("", "")
        return counts.select(*by, "total_records", F.inline(F.array(_entry(none, "skip", F.lit(0))))).where(F.lit(False))
    return counts.select(*by, "total_records", F.inline(F.array(*entries)))


def _count_duplicates(df: DataFrame, by: list[str], key: str, rules: list[Rule]) -> DataFrame:
    # NULL keys count as records but never as duplicates.
    per_key = df.groupBy(*by, named(key).alias("_key")).agg(F.count(F.lit(1)).alias("_rows"))
    duplicated = F.col("_key").isNotNull() & (F.col("_rows") > 1)
    counts = per_key.groupBy(*by).agg(
        F.coalesce(F.sum("_rows"), F.lit(0)).alias("total_records"),
        F.coalesce(F.sum(F.when(duplicated, F.col("_rows"))), F.lit(0)).alias("_failing"),
    )
    entries = [_entry(rule, "check", F.col("_failing")) for rule in rules]
    return counts.select(*by, "total_records", F.inline(F.array(*entries)))


def _entry(rule: Rule, kind: str, failing: Column) -> Column:
    return F.struct(
        F.lit(rule.rule_id).alias("rule_id"),
        F.lit(kind).alias("_kind"),
        F.lit(float(rule.warning)).alias("_warning"),
        F.lit(float(rule.error)).alias("_error"),
        failing.cast("bigint").alias("failing_records"),
    )


def success_percentage(total: Column, failing: Column) -> Column:
    return F.when(total == 0, 100.0).otherwise(F.try_divide(total - failing, total) * 100)


def _graded(results: DataFrame, pipeline_id: str, target_layer: str, processing_date: str | Column) -> DataFrame:
    total, kind, percentage = F.col("total_records"), F.col("_kind"), F.col("success_percentage")
    status = (
        F.when(total == 0, "PASS")
        .when(kind == "broken", "EXECUTION_ERROR")
        .when(kind == "skip", "SKIP")
        .when(percentage < F.col("_error"), "ERROR")
        .when(percentage < F.col("_warning"), "WARNING")
        .otherwise("PASS")
    )
    counted = success_percentage(total, F.col("failing_records"))
    return (
        results.withColumn("success_percentage", F.when((total > 0) & (kind == "broken"), 0.0).otherwise(counted))
        .withColumn("status", status)
        .withColumn("pipeline_id", F.lit(pipeline_id))
        .withColumn("target_layer", F.lit(target_layer))
        .withColumn("processing_date", F.col(_DAY) if isinstance(processing_date, Column) else F.lit(processing_date))
        .select(*RESULT_COLUMNS)
    )


def run_rules(
    df: DataFrame,
    rules: Sequence[Rule],
    pipeline_id: str,
    target_layer: str,
    day: str,
    duplicates: DuplicatedKeys | None = None,
) -> list[Row]:
    """Evaluate and fetch the results, one row per rule.

    A condition that fails only on some value (a bad cast, say) would take the shared pass down
    with it. Then every rule runs by itself and only the broken one is an EXECUTION_ERROR.
    """
    try:
        return evaluate(df, rules, pipeline_id, target_layer, day, duplicates).collect()
    except PySparkException:
        total = df.count()  # input that cannot be read at all is no rule's fault
    results = []
    for rule in rules:
        try:
            results += evaluate(df, [rule], pipeline_id, target_layer, day, duplicates).collect()
        except PySparkException:
            results.append(
                Row(
                    pipeline_id=pipeline_id,
                    target_layer=target_layer,
                    processing_date=day,
                    rule_id=rule.rule_id,
                    status="EXECUTION_ERROR",
                    success_percentage=0.0,
                    total_records=total,
                    failing_records=0,
                )
            )
    return results


def severity(status: Column) -> Column:
    ranks = F.lit(None).cast("int")
    for name, rank in SEVERITY.items():
        ranks = F.when(status == name, rank).otherwise(ranks)
    return ranks


def overall(results: DataFrame) -> DataFrame:
    """One status per run: the worst of its rules."""
    worst = F.max(severity(F.col("status")))
    named_worst = F.when(worst == 2, "ERROR").when(worst == 1, "WARNING").otherwise("PASS")
    return results.groupBy("pipeline_id", "target_layer", "processing_date").agg(named_worst.alias("overall_status"))


def overall_status(results: Sequence[Row]) -> str:
    worst = max((SEVERITY[row["status"]] for row in results), default=0)
    return ("PASS", "WARNING", "ERROR")[worst]


def actions_due(results: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """One row per result and action its rule asks for; `handled` tells if it is done here."""
    due = F.array().cast("array<string>")
    for rule in rules:
        for status in ("ERROR", "WARNING"):
            if chosen := rule.actions(status):
                hit = (F.col("rule_id") == rule.rule_id) & (F.col("status") == status)
                due = F.when(hit, F.array(*map(F.lit, chosen))).otherwise(due)
    exploded = results.select("*", F.explode(due).alias("action"))
    return exploded.withColumn("handled", F.col("action").isin(*ACTIONS))


def must_abort(results: Sequence[Row], rules: Sequence[Rule], allow_partial_success: bool = False) -> bool:
    """Stop on an overall ERROR, unless partial success is allowed and no rule asked to abort."""
    if overall_status(results) != "ERROR":
        return False
    asking = {rule.rule_id for rule in rules if "abort_pipeline" in rule.on_error}
    return not allow_partial_success or any(r["status"] == "ERROR" and r["rule_id"] in asking for r in results)


def failing_rows(
    df: DataFrame, rules: Sequence[Rule], day_column: str | None = None, duplicates: DuplicatedKeys | None = None
) -> DataFrame:
    """The rows that fail, with the `rule_id` they fail; a row failing two rules comes twice.

    Without `duplicates`, a uniqueness rule counts its keys here and now. Rules that cannot be resolved or
    have no test yield nothing. With `day_column`, keys must be unique within a day only.
    """
    usable = [rule for rule in rules if not is_broken(df, rule)]
    row_rules = [(rule.rule_id, rule.failing()) for rule in usable if rule.failing() is not None]
    parts = []
    if row_rules:
        # The plain OR reaches the scan as a pushed filter; the array only sees rows that fail.
        failed = F.array_compact(F.array(*(F.when(failing, F.lit(rule_id)) for rule_id, failing in row_rules)))
        rows = df.where(any_of([failing for _, failing in row_rules]))
        parts.append(rows.select("*", F.explode(failed).alias("rule_id")))
    for rule in usable:
        if rule.unique_key:
            keys = [day_column, rule.unique_key] if day_column else [rule.unique_key]
            parts.append(rows_with_duplicated_key(df, keys, duplicates).withColumn("rule_id", F.lit(rule.rule_id)))
    if not parts:
        return df.withColumn("rule_id", F.lit("")).where(F.lit(False))
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


def passing_rows(
    df: DataFrame, rules: Sequence[Rule], day_column: str | None = None, duplicates: DuplicatedKeys | None = None
) -> DataFrame:
    """The rows that fail none of the rules."""
    usable = [rule for rule in rules if not is_broken(df, rule)]
    row_rules = [failing for rule in usable if (failing := rule.failing()) is not None]
    result = df.where(~F.coalesce(any_of(row_rules), F.lit(False))) if row_rules else df
    unique = dict.fromkeys(rule.unique_key for rule in usable if rule.unique_key)
    if unique and duplicates is None:
        duplicates = DuplicatedKeys(df)  # of all rows, not of those that passed so far
    for key in unique:
        keys = [day_column, key] if day_column else [key]
        result = rows_without_duplicated_key(result, keys, duplicates)
    return result


def quarantine_due(results: Sequence[Row], rules: Sequence[Rule]) -> list[Row]:
    """The results whose failing rows are to be quarantined."""
    known = {rule.rule_id: rule for rule in rules}
    return [
        row
        for row in results
        if row["failing_records"] > 0 and "quarantine" in known[row["rule_id"]].actions(row["status"])
    ]


def quarantine(
    df: DataFrame,
    rules: Sequence[Rule],
    results: Sequence[Row],
    path: str,
    layer: str,
    day: str,
    duplicates: DuplicatedKeys | None = None,
) -> int:
    """Copy the failing rows of the rules whose outcome asks for it; a rerun replaces them."""
    due = quarantine_due(results, rules)
    parts = {"target_layer": layer, "processing_date": day}
    if not due:
        Files(df.sparkSession).delete(slice_path(path, parts))
        return 0
    return overwrite_slice(rows_due(df, rules, due, duplicates), path, parts, ["rule_id"], clustered=True)


def rows_due(df: DataFrame, rules: Sequence[Rule], due: Sequence[Row], duplicates: DuplicatedKeys | None = None) -> DataFrame:
    """The failing rows of some results, laid out to be written by `rule_id`.

    Rows of a rule that fails many are left in the tasks that find them, behind a join too: each writes a file of fair size.
    Those of the other rules are few, and are shuffled into few files.
    """
    asked = {row["rule_id"] for row in due}
    plenty = {row["rule_id"] for row in due if row["failing_records"] * PLENTY >= row["total_records"]}
    parts = []
    if plenty:
        parts.append(failing_rows(df, [rule for rule in rules if rule.rule_id in plenty], duplicates=duplicates))
    if asked - plenty:
        few = failing_rows(df, [rule for rule in rules if rule.rule_id in asked - plenty], duplicates=duplicates)
        parts.append(few.hint("rebalance", "rule_id"))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def save_results(results: DataFrame, path: str, layer: str, day: str) -> int:
    """Store the results of a run in place of those of an earlier run for the layer and date."""
    return overwrite_slice(results, path, {"target_layer": layer, "processing_date": day})


def stored_results(spark: SparkSession, path: str, layer: str, day: str) -> list[Row]:
    """The stored results of a layer and date, one row per rule; none if it was not checked."""
    parts = {"target_layer": layer, "processing_date": day}
    if not Files(spark).exists(slice_path(path, parts)):
        return []
    return read_slices(spark, path, [parts]).collect()


def gate(spark: SparkSession, path: str, layer: str, day: str) -> str:
    """The stored status of a layer and date: PASS, WARNING, ERROR, or UNKNOWN without results."""
    found = stored_results(spark, path, layer, day)
    return overall_status(found) if found else "UNKNOWN"


def gates(results: DataFrame) -> DataFrame:
    """The decision per layer and date: `blocked` on ERROR, otherwise `open`."""
    blocked = F.when(F.col("overall_status") == "ERROR", "blocked").otherwise("open")
    return overall(results).withColumn("decision", blocked)
