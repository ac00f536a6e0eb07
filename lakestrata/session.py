"""What the jobs need from a Spark session: UTC dates and a folder every executor can reach."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import SparkSession

from lakestrata.sources.storage import Files

# Runtime settings for large inputs. AQE then sizes reducers and splits hot partitions by
# itself; the initial partition number only has to be high enough for the biggest shuffle.
LARGE_INPUT_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "256m",
    "spark.sql.sessionWindow.merge.sessions.in.local.partition": "true",
}
TARGET_SHUFFLE_BYTES = 256 * 1024 * 1024

_scratch: list[tuple[SparkSession, str]] = []
_named: dict[str, str] = {}


def use_utc(spark: SparkSession) -> SparkSession:
    """Dates are cut from UTC timestamps, so the session zone must not decide them."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def tune_for(spark: SparkSession, shuffle_bytes: int) -> SparkSession:
    """Apply the large-input settings, with enough shuffle partitions for `shuffle_bytes`.

    The program that makes the session calls this, as it knows the cluster; no job changes these settings.
    """
    for key, value in LARGE_INPUT_SETTINGS.items():
        spark.conf.set(key, value)
    partitions = max(200, -(-shuffle_bytes // TARGET_SHUFFLE_BYTES))
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    return spark


def use_folder(spark: SparkSession, path: str) -> None:
    """Name the shared folder of a session that has no `spark.checkpoint.dir`, as tests and checks do."""
    _named[spark.sparkContext.applicationId] = path.rstrip("/")


def has_folder(spark: SparkSession) -> bool:
    """Whether the session names a shared folder."""
    return bool(spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.applicationId in _named)


def shared_dir(spark: SparkSession) -> str:
    """The folder named by `spark.checkpoint.dir`, else the one named by `use_folder`."""
    configured = spark.conf.get("spark.checkpoint.dir", None) or _named.get(spark.sparkContext.applicationId)
    if not configured:
        raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
    return configured.rstrip("/")


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A new folder under the shared one, for tables written half-way through a query."""
    path = f"{shared_dir(spark)}/lakestrata/{name}-{uuid.uuid4().hex}"
    _scratch.append((spark, path))
    return path


def clear_scratch(paths: Sequence[str] | None = None) -> None:
    """Delete scratch folders, all of this process or the given ones; call it when the results have been read."""
    for spark, path in list(_scratch):
        if paths is None or path in paths:
            _scratch.remove((spark, path))
            Files(spark).delete(path)
