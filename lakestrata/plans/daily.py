"""The daily load: landing to bronze, quality check, silver, and the gold dates it touches.

Silver is partitioned by load day and, inside, by order date. A rerun replaces its load day
whole, and a gold date is always computed from all silver rows of that date, archived ones included,
whichever day they were loaded on, so late rows add to a date instead of replacing it. Rows without a
date are a date of their own. Which load days hold rows of a date is noted in empty folders, so only
the folders of the touched dates are listed and read.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from datetime import date, datetime, timezone
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, Row, SparkSession
from pyspark.sql import functions as F

from lakestrata.functions.columns import named
from lakestrata.operators.contract import Contract, project
from lakestrata.operators.duplicates import DuplicatedKeys
from lakestrata.operators.governance import broadcast_few
from lakestrata.operators.quality import (
    RESULT_SCHEMA,
    DataQualityError,
    Rule,
    must_abort,
    overall_status,
    passing_rows,
    quarantine,
    quarantine_due,
    run_rules,
    save_results,
    stored_results,
    success_percentage,
)
from lakestrata.operators.runlog import RunLog
from lakestrata.operators.steps import LayerStep, Rollup, chain, steps_for, with_date, with_ingestion_timestamp
from lakestrata.operators.subjects import index_subjects
from lakestrata.session import use_utc
from lakestrata.sources.lake import (
    append_rows,
    day_parts,
    drop_slices,
    overwrite_partitions,
    overwrite_slice,
    overwrite_slices,
    read_slices,
    slice_path,
)
from lakestrata.sources.landing import header_differs, landing_path, lost_cells, read_files, read_mixed
from lakestrata.sources.storage import Files, day_name, day_value, in_order, partition_value

RAW_LINE = "_raw_line"
CONTRACT_RESULT_SCHEMA = (
    "check_name string, subject string, total_records bigint, failing_records bigint, "
    "success_percentage double, conforms boolean"
)


@dataclass(frozen=True)
class DailyJob:
    """What is loaded and where it goes. `root` holds one folder per table."""

    pipeline_id: str
    domain: str
    contract: Contract
    steps: Sequence[LayerStep]
    rules: Sequence[Rule]
    landing: str
    root: str
    landing_format: str = "csv"
    timestamp_column: str = "order_timestamp"
    checked_layer: str = "silver"
    allow_partial_success: bool = False
    drop_quarantined: bool = False
    quarantine_enabled: bool = True
    quarantine_path: str | None = None
    expected_interval_hours: int = 24
    environment: str = "local"
    version: str = "unknown"
    rollup: Rollup | None = None  # the gold aggregate as mergeable parts per load, in place of the gold steps
    subject_key: str | None = None  # the column by which subjects are indexed, so that erasure reads few partitions

    def path(self, table: str) -> str:
        if table == "quarantine" and self.quarantine_path:
            return self.quarantine_path.rstrip("/")
        return f"{self.root.rstrip('/')}/{table}"

    def new_log(self) -> RunLog:
        return RunLog(self.pipeline_id, self.domain, environment=self.environment, pipeline_version=self.version)

    # Landing to bronze

    def landing_rows(self, spark: SparkSession, paths: str | Sequence[str], mixed: bool = False) -> DataFrame:
        """The rows of landing files in contract types; the raw line stays beside rows that did not parse."""
        schema = self.contract.schema("landing")
        if self.landing_format not in ("csv", "json"):
            return read_files(spark, paths, self.landing_format, schema).withColumn(RAW_LINE, F.lit(None).cast("string"))
        if mixed:
            return read_mixed(spark, [paths] if isinstance(paths, str) else paths, schema, RAW_LINE)
        return read_files(spark, paths, self.landing_format, schema, RAW_LINE)

    def lost(self, rows: DataFrame) -> dict[str, Column]:
        """For each column, true where the landing file holds a value that did not parse."""
        return lost_cells(rows, RAW_LINE, self.landing_format)

    def load_counters(self, rows: DataFrame) -> list[Column]:
        """Aggregates over loaded rows: rows, raw lines, lost and missing values, the latest moment.

        Rows without raw lines beside them, as those of bronze, are taken to have lost nothing.
        """
        raw = RAW_LINE in rows.columns
        lost = self.lost(rows) if raw else dict.fromkeys(self.contract.schema("landing").names, F.lit(False))
        missing = [c.name for c in self.contract.of_layer("landing") if c.not_null and c.name in rows.columns]
        latest = F.max(named(self.timestamp_column).try_cast("timestamp")) if self.timestamp_column in rows.columns else F.lit(None).cast("timestamp")
        return [
            F.count(F.lit(1)).alias("rows"),
            F.count(F.col(RAW_LINE) if raw else F.lit(None)).alias("raw_lines"),
            F.unix_micros(latest).alias("latest"),
            *(F.count_if(where).alias(f"lost:{name}") for name, where in lost.items()),
            *(F.count_if(named(name).isNull()).alias(f"null:{name}") for name in missing),
        ]

    def save_load_results(self, spark: SparkSession, found: dict[date, dict], as_of: datetime) -> None:
        """Store what was counted while loading, as results of the contract's checks per day."""
        rows = []
        for day, counts in found.items():
            for name, number in counts.items():
                kind, _, subject = name.partition(":")
                if subject:
                    check = {"lost": "type", "null": "not_null"}[kind]
                    rows.append((check, subject, counts["rows"], number, day))
            if self.contract.max_latency_minutes is not None:
                moment = as_of if as_of.tzinfo else as_of.replace(tzinfo=timezone.utc)
                latest = counts["latest"]
                late = latest is None or moment.timestamp() * 1e6 - latest > self.contract.max_latency_minutes * 60e6
                rows.append(("freshness", self.timestamp_column, counts["rows"], counts["rows"] if late else 0, day))
        if not rows:
            return
        schema = "check_name string, subject string, total_records bigint, failing_records bigint, processing_date date"
        percentage = success_percentage(F.col("total_records"), F.col("failing_records"))
        results = spark.createDataFrame(rows, schema).withColumn("success_percentage", percentage)
        results = results.withColumn("conforms", F.col("failing_records") == 0)
        overwrite_partitions(results, self.path("contract_results"), ["processing_date"])

    def keep_raw_lines(self, rows: DataFrame, day: Column) -> None:
        """Store the lines of some days that did not parse, with the names of the lost columns."""
        spark = rows.sparkSession
        lost = F.array_compact(F.array(*(F.when(where, F.lit(name)) for name, where in self.lost(rows).items())))
        lines = rows.withColumn("processing_date", day).where(F.col(RAW_LINE).isNotNull())
        lines = lines.select(F.col(RAW_LINE).alias("line"), lost.alias("lost_columns"), "processing_date")
        overwrite_partitions(lines, self.path("unparsed"), ["processing_date"])

    def drop_raw_lines(self, spark: SparkSession, days: Sequence[date]) -> None:
        drop_slices(spark, [slice_path(self.path("unparsed"), {"processing_date": day.isoformat()}) for day in days])

    # Data subjects

    def index_path(self, table: str) -> str:
        return self.path(f"subject_index/{table}")

    def index_subjects(self, spark: SparkSession, table: str, slices: Sequence[Mapping[str, str]] | None = None) -> None:
        """Keep the subject index of a table up to date, of some slices just written or of all."""
        if self.subject_key:
            index_subjects(spark, self.path(table), self.index_path(table), self.subject_key, slices)

    def note_erased(self, spark: SparkSession, subjects: DataFrame, key: str) -> None:
        """Remember erased subjects by a digest, so that loading their files again does not bring them back."""
        path = slice_path(self.path("erased"), {"key": key})
        new = subjects.select(F.sha2(named(key).cast("string"), 256).alias("digest")).na.drop().distinct()
        if Files(spark).exists(path):
            new = new.join(spark.read.parquet(path), "digest", "left_anti")
        append_rows(new.withColumn("key", F.lit(key)), self.path("erased"), ["key"])

    def without_erased(self, rows: DataFrame) -> DataFrame:
        """Rows of subjects that were not erased; rows without a key stay."""
        spark = rows.sparkSession
        for folder in Files(spark).folders(self.path("erased")):
            key = partition_value(folder, "key")
            if key in rows.columns:
                listed = spark.read.parquet(folder)
                listed = broadcast_few(listed, listed.count())  # from the file footers
                rows = rows.join(listed, F.sha2(named(key).cast("string"), 256) == listed["digest"], "left_anti")
        return rows

    def ingest(self, spark: SparkSession, day: date, as_of: datetime) -> int:
        """Load the files of a day, in contract types, in place of an earlier load of that day.

        Returns the rows written. Without any row nothing is written. Values that do not parse are NULL in
        bronze; they are counted per column in the same pass, and their raw lines are kept.
        """
        path = landing_path(self.landing, day)
        rows = self.without_erased(self.landing_rows(spark, path))
        try:
            if rows.isEmpty():
                return 0
            counts = self._write_bronze(rows, day, as_of)
        except Exception as error:  # the reader's own error comes in several classes
            if self.landing_format != "csv" or not header_differs(error):
                raise
            rows = self.without_erased(self.landing_rows(spark, path, mixed=True))
            counts = self._write_bronze(rows, day, as_of)
        self.drop_raw_lines(spark, [day])
        if counts["raw_lines"]:
            self.keep_raw_lines(rows, F.lit(day))
        self.save_load_results(spark, {day: counts}, as_of)
        self.index_subjects(spark, "bronze", [day_parts(day)])
        return counts["rows"]

    def _write_bronze(self, rows: DataFrame, day: date, as_of: datetime) -> dict:
        # No shuffle lies between the counters and the write, so a task that runs again is counted once.
        seen = Observation()
        counted = rows.observe(seen, *self.load_counters(rows)).drop(RAW_LINE)
        overwrite_slice(with_ingestion_timestamp(as_of)(counted), self.path("bronze"), day_parts(day))
        return seen.get

    def bronze(self, spark: SparkSession, day: date) -> DataFrame | None:
        """The bronze rows of a day, or None if that day was never loaded."""
        if not Files(spark).exists(slice_path(self.path("bronze"), day_parts(day))):
            return None
        return read_slices(spark, self.path("bronze"), [day_parts(day)]).drop("year", "month", "day")

    # Quality

    def check(self, spark: SparkSession, day: date, duplicates: DuplicatedKeys | None = None) -> list[Row]:
        """Check the bronze day, store the results, quarantine, and stop if the rules say so."""
        rows = self._loaded(spark, day)
        layer, text = self.checked_layer, day.isoformat()
        own = duplicates or DuplicatedKeys(rows)
        try:
            results = run_rules(rows, self.rules, self.pipeline_id, layer, text, own)
            if results:
                save_results(spark.createDataFrame(results, RESULT_SCHEMA), self.path("dq_results"), layer, text)
            else:
                self.forget_results(spark, [day])
            if self.quarantine_enabled:
                quarantine(rows, self.rules, results, self.path("quarantine"), layer, text, own)
        finally:
            if duplicates is None:
                own.clear()
        if must_abort(results, self.rules, self.allow_partial_success):
            raise DataQualityError(self.pipeline_id, layer, text, results)
        return results

    def forget_results(self, spark: SparkSession, days: Sequence[date]) -> None:
        """Drop the stored results of days that have no rules any more."""
        parts = [{"target_layer": self.checked_layer, "processing_date": day.isoformat()} for day in days]
        drop_slices(spark, [slice_path(self.path("dq_results"), item) for item in parts])

    def results(self, spark: SparkSession, day: date) -> list[Row]:
        return stored_results(spark, self.path("dq_results"), self.checked_layer, day.isoformat())

    def dropped_rules(self, results: Sequence[Row]) -> list[Rule]:
        """The rules whose failing rows went to quarantine by these results, if such rows go no further."""
        if not (self.drop_quarantined and self.quarantine_enabled):
            return []
        current = {rule.rule_id for rule in self.rules}
        due = {row["rule_id"] for row in quarantine_due([r for r in results if r["rule_id"] in current], self.rules)}
        return [rule for rule in self.rules if rule.rule_id in due]

    def _loaded(self, spark: SparkSession, day: date) -> DataFrame:
        rows = self.bronze(spark, day)
        if rows is None:
            raise FileNotFoundError(f"no bronze rows for {day}")
        return rows

    # Bronze to silver

    def build_silver(
        self, spark: SparkSession, day: date, skip_check: bool = False, duplicates: DuplicatedKeys | None = None
    ) -> tuple[int, list[date | None]]:
        """Transform a bronze day; returns the rows written and the order dates touched.

        Refuses to run when the stored check of that day is an ERROR, unless told to skip it.
        """
        results = self.results(spark, day)
        if not skip_check and overall_status(results) == "ERROR":
            raise DataQualityError(self.pipeline_id, self.checked_layer, day.isoformat(), results)
        rows = self._loaded(spark, day)
        dropped = self.dropped_rules(results)
        own = duplicates or DuplicatedKeys(rows)
        try:
            passed = passing_rows(rows, dropped, duplicates=own) if dropped else rows
            before = self.note_replaced(spark, [day])
            on_time = F.col("order_date") == F.lit(day)
            joined = any(rule.unique_key for rule in dropped)  # then rows do not lie where they were read
            written = overwrite_slice(
                self.silver_rows(passed),
                self.path("silver"),
                {"load_date": day.isoformat()},
                ["order_date"],
                bulk=None if joined else on_time,
            )
        finally:
            if duplicates is None:
                own.clear()
        now = set(self.silver_folders(spark, [day]))
        self.note_dates(spark, {day: now})
        self.save_states(spark, [day])
        self.index_subjects(spark, "silver", [{"load_date": day.isoformat()}])
        return written, in_order(before | now)

    def silver_rows(self, rows: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
        """Bronze rows through the silver steps, in the contract's columns and types, with their order date."""
        return with_date(self.timestamp_column)(self._projected(chain(rows, steps_for("silver", self.steps)), "silver", keep))

    def _projected(self, rows: DataFrame, layer: str, keep: Sequence[str] = ()) -> DataFrame:
        return project(rows, self.contract, layer, keep) if layer in self.contract.layers else rows

    def note_replaced(self, spark: SparkSession, load_days: Sequence[date]) -> set[date | None]:
        """Note the order dates of silver rows that are about to be replaced, as folder names.

        The note outlives a run that dies before gold is refreshed, so that the next run
        still knows which dates the replaced rows belonged to.
        """
        files, root = Files(spark), self.path("gold_pending")
        replaced = [path for found in self.silver_folders(spark, load_days).values() for path in found]
        columns = ("load_date", "order_date")
        files.make_folders(slice_path(root, {name: partition_value(path, name) for name in columns}) for path in replaced)
        loads = [slice_path(root, {"load_date": day.isoformat(), "order_date": "*"}) for day in load_days]
        return {day_value(path, "order_date") for path in files.glob_all(loads)}

    def settle(self, spark: SparkSession, load_days: Sequence[date]) -> None:
        """Drop the notes of load days whose dates have been refreshed in gold."""
        drop_slices(spark, [slice_path(self.path("gold_pending"), {"load_date": day.isoformat()}) for day in load_days])

    def unsettled(self, spark: SparkSession) -> list[date]:
        """Load days of runs that died between silver and gold."""
        found = Files(spark).folders(self.path("gold_pending"))
        return sorted(date.fromisoformat(partition_value(path, "load_date")) for path in found)

    def heal(self, spark: SparkSession, but: Sequence[date] = ()) -> list[date]:
        """Load days that a died run left half replaced, built again from bronze; returns those that could be."""
        healed = []
        for day in self.unsettled(spark):
            if day not in but and self.bronze(spark, day) is not None and overall_status(self.results(spark, day)) != "ERROR":
                _, touched = self.build_silver(spark, day)
                self.refresh_gold(spark, touched)
                self.settle(spark, [day])
                healed.append(day)
        return healed

    def note_dates(self, spark: SparkSession, found: dict[date, set[date | None]]) -> None:
        """Note which order dates a load day has rows of."""
        root = self.path("silver_dates")
        Files(spark).make_folders(
            slice_path(root, {"order_date": day_name(day), "load_date": load.isoformat()})
            for load, days in found.items()
            for day in days
        )

    def silver_folders(
        self, spark: SparkSession, load_days: Sequence[date] | None = None, order_dates: Sequence[date | None] | None = None
    ) -> dict[date | None, list[str]]:
        """Folders per order date (None: rows without one), of some load days, of some order dates, or all.

        Only names are listed. For order dates the notes tell which load days to look at, so what is
        listed does not grow with the table.
        """
        files, root = Files(spark), self.path("silver")
        if order_dates is not None:
            noted = files.glob_all(
                slice_path(self.path("silver_dates"), {"order_date": day_name(day), "load_date": "*"}) for day in order_dates
            )
            columns = ("load_date", "order_date")
            wanted = [slice_path(root, {name: partition_value(path, name) for name in columns}) for path in noted]
        else:
            loads = [day.isoformat() for day in load_days] if load_days is not None else ["*"]
            wanted = [slice_path(root, {"load_date": load, "order_date": "*"}) for load in loads]
        folders: dict[date | None, list[str]] = {}
        for path in files.glob_all(wanted):
            folders.setdefault(day_value(path, "order_date"), []).append(path)
        return folders

    def archived_folders(self, spark: SparkSession, order_dates: Sequence[date | None] | None) -> dict[date | None, list[str]]:
        """Archived silver folders per order date: the last archive of each load day that is not in silver any more."""
        files, root = Files(spark), self.path("silver_archive")
        if not files.exists(root):
            return {}
        if order_dates is None:
            wanted = [slice_path(root, {"run": "*", "load_date": "*", "order_date": "*"})]
        else:
            noted = files.glob_all(
                slice_path(self.path("silver_dates"), {"order_date": day_name(day), "load_date": "*"}) for day in order_dates
            )
            wanted = [
                slice_path(root, {"run": "*", **{name: partition_value(path, name) for name in ("load_date", "order_date")}})
                for path in noted
            ]
        found = files.glob_all(wanted)
        loads = sorted({partition_value(path, "load_date") for path in found})
        live = files.glob_all(slice_path(self.path("silver"), {"load_date": load}) for load in loads)
        live = {partition_value(path, "load_date") for path in live}
        runs = files.glob_all(slice_path(root, {"run": "*", "load_date": load}) for load in loads if load not in live)
        last: dict[str, str] = {}
        for path in runs:
            load = partition_value(path, "load_date")
            last[load] = max(last.get(load, ""), partition_value(path, "run"))
        folders: dict[date | None, list[str]] = {}
        for path in found:
            if last.get(partition_value(path, "load_date")) == partition_value(path, "run"):
                folders.setdefault(day_value(path, "order_date"), []).append(path)
        return folders

    def silver(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(self.path("silver")).withColumn("order_date", F.col("order_date").cast("date"))

    # Silver to gold

    def refresh_gold(self, spark: SparkSession, dates: Sequence[date | None] | None = None) -> int:
        """Recompute gold for some order dates (or all); dates without sales any more go away.

        Only the silver folders of these dates are listed and read, from every load day, archived or not. With a rollup
        no silver row is read, but the parts that each load has stored for these dates.
        """
        if dates is not None and not dates:
            return 0
        if self.rollup:
            gold, there = self.merged_states(spark, dates)
            written = overwrite_partitions(self._projected(gold, "gold"), self.path("gold"), ["order_date"]) if there else 0
            gone = set(self._gold_dates(spark) if dates is None else dates) - there
            drop_slices(spark, [slice_path(self.path("gold"), {"order_date": day_name(day)}) for day in in_order(gone)])
            return written
        live = self.silver_folders(spark, order_dates=dates)
        archived = self.archived_folders(spark, dates)
        parts = [
            spark.read.option("basePath", self.path(table)).parquet(*[path for found in folders.values() for path in found])
            for table, folders in (("silver", live), ("silver_archive", archived))
            if folders
        ]
        written = 0
        if parts:
            # without the columns of the folders: a gold step takes the date from the moment, as on any silver table
            silver = reduce(DataFrame.unionByName, (part.drop("run", "load_date", "order_date") for part in parts))
            gold = self._projected(chain(silver, steps_for("gold", self.steps)), "gold")
            written = overwrite_partitions(gold, self.path("gold"), ["order_date"])
        gone = set(self._gold_dates(spark) if dates is None else dates) - set(live) - set(archived)
        drop_slices(spark, [slice_path(self.path("gold"), {"order_date": day_name(day)}) for day in in_order(gone)])
        return written

    def save_states(self, spark: SparkSession, loads: Sequence[date]) -> None:
        """The parts of gold that some load days contribute, per order date, in place of what they contributed before.

        Only the silver rows of these loads are read, archived ones where a load is not in silver any more.
        """
        if not self.rollup or not loads:
            return
        files, texts = Files(spark), [day.isoformat() for day in loads]
        live = files.glob_all(slice_path(self.path("silver"), {"load_date": text}) for text in texts)
        sources = [("silver", live)]
        gone = set(texts) - {partition_value(path, "load_date") for path in live}
        if gone and files.exists(self.path("silver_archive")):
            runs = files.glob_all(slice_path(self.path("silver_archive"), {"run": "*", "load_date": text}) for text in sorted(gone))
            last = {partition_value(path, "load_date"): path for path in sorted(runs, key=lambda path: partition_value(path, "run"))}
            sources.append(("silver_archive", list(last.values())))
        parts = [spark.read.option("basePath", self.path(table)).parquet(*paths).drop("run") for table, paths in sources if paths]
        root, slices = self.path("gold_states"), [{"load_date": text} for text in texts]
        if not parts:
            drop_slices(spark, [slice_path(root, item) for item in slices])
            return
        rows = reduce(DataFrame.unionByName, parts)
        overwrite_slices(self.rollup.partial(rows, ["load_date"]), root, slices, ["order_date"])

    def merged_states(self, spark: SparkSession, dates: Sequence[date | None] | None) -> tuple[DataFrame | None, set[date | None]]:
        """Gold rows of some order dates (or all) from the stored parts, and the dates that have any."""
        files, root = Files(spark), self.path("gold_states")
        if dates is None:
            found = files.glob(slice_path(root, {"load_date": "*", "order_date": "*"}))
        else:
            noted = files.glob_all(slice_path(self.path("silver_dates"), {"order_date": day_name(day), "load_date": "*"}) for day in dates)
            found = files.glob_all(slice_path(root, {name: partition_value(path, name) for name in ("load_date", "order_date")}) for path in noted)
        if not found:
            return None, set()
        states = spark.read.option("basePath", root).parquet(*found).withColumn("order_date", F.col("order_date").cast("date"))
        return self.rollup.merge(states), {day_value(path, "order_date") for path in found}

    def _gold_dates(self, spark: SparkSession) -> set[date | None]:
        return {day_value(path, "order_date") for path in Files(spark).glob(slice_path(self.path("gold"), {"order_date": "*"}))}

    def gold(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(self.path("gold")).withColumn("order_date", F.col("order_date").cast("date"))

    # All of it

    def run(
        self, spark: SparkSession, day: date, as_of: datetime, log: RunLog | None = None, skip_check: bool = False
    ) -> str:
        """Load one day through all layers; returns the overall quality status.

        Every step leaves an event; the events are stored at the end, also when a step fails.
        """
        use_utc(spark)
        log = log or self.new_log()
        status, step, keys = "PASS", "IngestBronze", None
        try:
            log.event("PipelineStart", "STARTING", {"processing_date": day})
            loaded = self.ingest(spark, day, as_of)
            log.event(step, "SUCCEEDED", {"rows": loaded})
            if loaded:
                keys = DuplicatedKeys(self._loaded(spark, day))
                step = "DataQuality"
                status = overall_status(self.check(spark, day, keys))
                log.event(step, "WARNING" if status == "WARNING" else "SUCCEEDED", {"status": status})
                step = "TransformSilver"
                self.heal(spark, [day])
                written, touched = self.build_silver(spark, day, skip_check, keys)
                log.event(step, "SUCCEEDED", {"rows": written, "order_dates": len(touched)})
                step = "TransformGold"
                log.event(step, "SUCCEEDED", {"rows": self.refresh_gold(spark, touched)})
                self.settle(spark, [day])
            log.event("PipelineEnd", "SUCCEEDED", {"status": status})
            return status
        except Exception as error:
            log.failure(step, error)
            raise
        finally:
            if keys is not None:
                keys.clear()
            log.flush(spark, self.path("run_log"))
