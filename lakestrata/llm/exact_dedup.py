"""Exact deduplication with the state of a stream: digest, stable id and content locator, kept on disk for ever.

A file stream folds every text into keyed RocksDB state without watermark, so nothing expires. Per digest
the state holds the locator (id, file, row in the file) of the row that stays and how many rows there are.
A later run with the same state folder reads the new files only. Texts are not in the state: where a digest
was hit more than once, the texts behind it are fetched again and their full bytes compared, so two texts
of one digest are never taken for copies.

Everything is DataFrame code. The aggregation in front of the state combines within each task, and so does
the comparison of bytes: a text that a third of all rows share costs one row per task.

Defined results: a null text counts as empty, and empty texts are copies of each other. Of equal texts the row
with the largest id stays; a null id is smaller than any other; of repeated rows with one id the last in
file order stays (locators break the tie). Other columns are not read. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakestrata.llm.common import ascii_lower, new_folder, settings, stored, whole_text

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def located(files: DataFrame, digest: Callable[[Column], Column], id_column: str, text_column: str) -> DataFrame:
    """Digest, normalised text and locator of every row read from files."""
    text = ascii_lower(whole_text(text_column))
    return files.select(
        digest(text).alias("digest"),
        text.alias("text"),
        F.struct(
            F.col(id_column).alias("id"),
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.row_index").alias("row"),
        ).alias("place"),
    )


def fold_into_state(
    spark: SparkSession,
    path: str,
    state: str,
    digest: Callable[[Column], Column] = sha256,
    id_column: str = "doc_id",
    text_column: str = "text",
    batch_bytes: int = 1 << 40,
) -> None:
    """Read the files of `path` that the state folder has not seen, in batches of at most `batch_bytes`."""
    schema = spark.read.parquet(path).select(id_column, text_column).schema
    whole = path.rstrip("/")
    with settings(
        spark,
        spark__sql__streaming__stateStore__providerClass=ROCKSDB,
        spark__sql__streaming__stateStore__rocksdb__changelogCheckpointing__enabled="true",
        spark__sql__streaming__stateStore__unloadOnCommit="true",  # what a partition keeps on its machine goes with its task
        spark__sql__streaming__stateStore__rocksdb__boundedMemoryUsage="true",
        spark__sql__streaming__stateStore__rocksdb__maxMemoryUsageMB="300",
        spark__sql__streaming__stateStore__rocksdb__writeBufferSizeMB="4",
    ):
        files = (
            spark.readStream.schema(schema)
            .option("maxBytesPerTrigger", str(batch_bytes))
            .option("maxFileAge", "36500d")  # files older than the newest one seen by more than this would be left out
            .parquet(f"{whole[:-1]}[{whole[-1]}]")  # as a pattern, a single file may be given too
        )
        groups = (
            located(files, digest, id_column, text_column)
            .groupBy("digest")
            .agg(F.max("place").alias("keeper"), F.count(F.lit(1)).alias("group_size"))
        )
        (
            groups.writeStream.format("noop")
            .outputMode("update")
            .option("checkpointLocation", state)
            .trigger(availableNow=True)
            .start()
            .awaitTermination()
        )


def read_state(spark: SparkSession, state: str) -> DataFrame:
    """Digest, locator of the row that stays, and number of rows."""
    kept = spark.read.format("statestore").load(state)
    keeper, size = kept.schema["value"].dataType.names
    return kept.select(
        F.col("key.digest").alias("digest"), F.col(f"value.{keeper}").alias("keeper"), F.col(f"value.{size}").alias("group_size")
    )


def exact_dedup(
    spark: SparkSession,
    path: str,
    state: str | None = None,
    digest: Callable[[Column], Column] = sha256,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """For every row of the files in `path`: doc_id, keep_id, group_size, kept, text_sha256."""
    state = state or new_folder(spark, "exact-state")
    fold_into_state(spark, path, state, digest, id_column, text_column)
    groups = stored(read_state(spark, state), new_folder(spark, "exact-groups"))
    files = spark.read.schema(spark.read.parquet(path).select(id_column, text_column).schema).parquet(path)
    rows = located(files, digest, id_column, text_column)

    hits = groups.filter("group_size > 1").select("digest")
    texts = rows.join(hits, "digest", "left_semi").groupBy("digest", "text").agg(
        F.max("place").alias("keeper"), F.count(F.lit(1)).alias("group_size")
    )
    # digests that stand for more than one text: none, unless the digest is weak
    shared = stored(
        texts.groupBy("digest").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("digest"),
        new_folder(spark, "exact-shared"),
    )
    code = F.lower(F.hex("digest")) if digest is sha256 else F.sha2("text", 256)
    rows = rows.withColumn("text_sha256", code)
    if shared.isEmpty():
        found = rows.drop("text").join(groups, "digest")
    else:
        found = (
            rows.join(shared, "digest", "left_anti").drop("text").join(groups, "digest")
        ).unionByName(
            rows.join(shared, "digest", "left_semi").join(texts, ["digest", "text"]).drop("text")
        )
    return found.select(
        F.col("place.id").alias("doc_id"),
        F.col("keeper.id").alias("keep_id"),
        "group_size",
        (F.col("place") == F.col("keeper")).alias("kept"),
        "text_sha256",
    )
