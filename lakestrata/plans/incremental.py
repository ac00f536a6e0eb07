"""Landing files as they arrive: each call loads the days that got new files since the last one."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakestrata.plans.backfill import run_days
from lakestrata.plans.daily import DailyJob
from lakestrata.sources.landing import landing_day
from lakestrata.sources.storage import Files

EVERY_FILE = "3650000d"
# The columns of a file that is listed and not read.
FILE_COLUMNS = "path string, modificationTime timestamp, length long, content binary"


def landing_files(job: DailyJob, spark: SparkSession, files_per_batch: int | None = None) -> DataFrame:
    """A stream of the landing files' paths; their contents are not read."""
    reader = spark.readStream.format("binaryFile").schema(FILE_COLUMNS).option("maxFileAge", EVERY_FILE)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    pattern = job.landing
    for part in ("{yyyy}", "{MM}", "{dd}"):
        pattern = pattern.replace(part, "*")
    return reader.load(pattern).select("path")


def load_new_days(
    job: DailyJob, spark: SparkSession, as_of: datetime, skip_check: bool = False, files_per_batch: int | None = None
) -> dict[date, str]:
    """Run the job for every day with files that no earlier call has seen; returns the quality status of each.

    The stream's checkpoint, in the job's folder `landing_stream`, remembers files by name for ever, old ones too. A batch is the new files, and
    what is loaded is whole days, from all files of the day, in place of an earlier load. So a batch that died is repeated by the next call without
    any row twice, and late files of a day replace it by the whole day. A file that is rewritten under its old name is not new: run such a day with
    `run_days`, or correct its rows with `redrive`. `files_per_batch` bounds the days of a batch; without it all new files are one.
    """
    folder = job.landing[: job.landing.index("{")].rsplit("/", 1)[0]
    if not Files(spark).exists(folder):
        return {}
    statuses: dict[date, str] = {}

    def load(batch: DataFrame, _: int) -> None:
        # names of days only: one row for each day of the batch
        days = batch.select(landing_day(job.landing, F.col("path")).alias("day")).distinct().collect()
        if days:
            statuses.update(run_days(job, batch.sparkSession, sorted(row.day for row in days), as_of, skip_check))

    stream = landing_files(job, spark, files_per_batch).writeStream.foreachBatch(load)
    stream = stream.option("checkpointLocation", job.path("landing_stream")).trigger(availableNow=True).start()
    stream.awaitTermination()
    return statuses
