"""The run log: one row per step event, and a summary per execution."""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from dataclasses import asdict, dataclass, field
from datetime import datetime, timezone
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakestrata.sources.lake import append_rows

# Statuses of an event.
STATUSES = ("STARTING", "SUCCEEDED", "FAILED", "INFO", "WARNING")
EVENT_SCHEMA = (
    "log_id string, pipeline_id string, execution_id string, step_name string, domain string, status string, "
    "timestamp_utc timestamp, details string, environment string, pipeline_version string"
)
PARTITIONS = ["domain", "pipeline_id", "year", "month", "day"]


@dataclass(frozen=True)
class Failure:
    """What the log keeps of an error."""

    error: str
    text: str
    rules: list[dict[str, Any]] = field(default_factory=list)

    @classmethod
    def of(cls, error: Exception) -> Failure:
        return cls(type(error).__name__, str(error), [row.asDict() for row in getattr(error, "results", ())])


@dataclass
class RunLog:
    """Events of one execution, kept until `flush` appends them to the log table in one write."""

    pipeline_id: str
    domain: str
    execution_id: str = field(default_factory=lambda: f"run_{uuid.uuid4().hex}")
    environment: str = "local"
    pipeline_version: str = "unknown"
    events: list[tuple] = field(default_factory=list)

    def event(self, step_name: str, status: str, details: Any = None) -> None:
        if status.upper() not in STATUSES:
            raise ValueError(f"unknown status: {status}")
        now = datetime.now(timezone.utc)
        self.events.append(
            (
                str(uuid.uuid4()),
                self.pipeline_id,
                self.execution_id,
                step_name,
                self.domain,
                status.upper(),
                now,
                json.dumps(details if details is not None else {}, default=str),
                self.environment,
                self.pipeline_version,
            )
        )

    def failure(self, step_name: str, error: Exception, **details: Any) -> None:
        """Leave a FAILED event that tells the error, and the rule results it carries."""
        self.event(step_name, "FAILED", {**details, **asdict(Failure.of(error))})

    def flush(self, spark: SparkSession, path: str) -> int:
        if not self.events:
            return 0
        written = append_events(spark.createDataFrame(self.events, EVENT_SCHEMA), path)
        self.events.clear()
        return written


def append_events(events: DataFrame, path: str) -> int:
    """Append events under domain, pipeline and day."""
    stamped = events.withColumns(
        {
            "year": F.date_format("timestamp_utc", "yyyy"),
            "month": F.date_format("timestamp_utc", "MM"),
            "day": F.date_format("timestamp_utc", "dd"),
        }
    )
    return append_rows(stamped.hint("rebalance", *PARTITIONS), path, PARTITIONS)


def run_summary(events: DataFrame) -> DataFrame:
    """Per execution: first and last event, duration, events by status, last status, first failed step.

    Events are first reduced to one row per execution, step and status. That takes numbers only, so
    it is a hash aggregate before the shuffle, and the texts are compared on a handful of rows.
    Events at the same microsecond are ordered by step and status, whatever order they are read in.
    """
    status, number = F.col("status"), F.col("events")
    per_step = events.groupBy("execution_id", "step_name", "status").agg(
        F.min("timestamp_utc").alias("first"), F.max("timestamp_utc").alias("last"), F.count(F.lit(1)).alias("events")
    )
    failed_first = F.when(status == "FAILED", F.struct("first", "step_name"))
    return (
        per_step.groupBy("execution_id")
        .agg(
            F.min("first").alias("started_at"),
            F.max("last").alias("ended_at"),
            F.sum("events").alias("events"),
            *(F.sum(F.when(status == name, number).otherwise(0)).alias(name.lower()) for name in STATUSES),
            F.max(F.struct("last", "step_name", "status"))["status"].alias("last_status"),
            F.min(failed_first)["step_name"].alias("failed_step"),
        )
        .withColumn("duration_seconds", F.unix_timestamp("ended_at") - F.unix_timestamp("started_at"))
    )


def step_attempts(events: DataFrame, pause: str = "30 minutes", by: Sequence[str] = ("pipeline_id", "step_name")) -> DataFrame:
    """Runs of a step with its retries: events of a step that lie no further apart than `pause` are one run.

    Per run: first and last event, how often the step started and failed, the mean seconds from one start to the next (NULL with less than
    two), and its outcome: the last of SUCCEEDED and FAILED, or NULL if it never ended. With
    `spark.sql.sessionWindow.merge.sessions.in.local.partition`, which `session.tune_for` sets, tasks merge their events into
    runs before the shuffle, so that a step with most of the events is not one task's work. Events without a time are left out.
    """
    starts = F.when(F.col("status") == "STARTING", F.col("timestamp_utc"))
    ends = F.when(F.col("status").isin("SUCCEEDED", "FAILED"), F.struct("timestamp_utc", "status"))
    apart = (F.unix_micros("__last_start") - F.unix_micros("__first_start")) / 1_000_000
    return (
        events.where(F.col("timestamp_utc").isNotNull())
        .groupBy(*by, F.session_window("timestamp_utc", pause).alias("__run"))
        .agg(
            F.min("timestamp_utc").alias("started_at"),
            F.max("timestamp_utc").alias("ended_at"),
            F.count(F.lit(1)).alias("events"),
            F.count(starts).alias("attempts"),
            F.count_if(F.col("status") == "FAILED").alias("failures"),
            F.max(ends)["status"].alias("outcome"),
            F.min(starts).alias("__first_start"),
            F.max(starts).alias("__last_start"),
        )
        .withColumn("seconds_between", F.when(F.col("attempts") > 1, apart / (F.col("attempts") - 1)))
        .drop("__run", "__first_start", "__last_start")
    )
