"""A membership index of data subjects: for each partition of a table, which subjects it may hold.

A partition's filter is a blocked Bloom filter: a key sets `BITS` bits in one 64-bit word, and there are about
`KEYS_PER_WORD` keys a word. Filters are rows of a table partitioned like the data, so writing a partition replaces its filter alone.
A look-up joins the words of the listed subjects with those of the filters: partitions that certainly hold none are
neither listed further nor read, and one in which a filter errs is read in vain.

Each filter carries a stamp of the files it was made from. A partition whose files have changed since, or that has no filter, counts as one
that may hold every subject, so a forgotten index costs time and nothing else.
"""

from __future__ import annotations

import hashlib
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakestrata.functions.columns import named
from lakestrata.operators.governance import Listed, erase_from_table, listed_subjects, read_as_text
from lakestrata.sources.lake import overwrite_partitions, partition_folders, partition_names, slice_path
from lakestrata.sources.storage import NULL_PARTITION, Files, partition_value

KEYS_PER_WORD = 4
BITS = 6
WORD, HELD, WORDS, STAMP = "_word", "_held", "_words", "_stamp"


def _bits(key: Column) -> Column:
    """The bits of a key within its word."""
    spread = F.xxhash64(F.lit("bits"), key)
    places = [F.shiftrightunsigned(spread, 6 * i).bitwiseAND(F.lit(63)).cast("int") for i in range(BITS)]
    held = F.lit(0).cast("long")
    for place in places:
        held = held.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), place))
    return held


def _word(key: Column, words: Column) -> Column:
    """The number of a key's word in a filter of 2^n words."""
    return F.xxhash64(F.lit("word"), key).bitwiseAND(words - 1)


def _folders(spark: SparkSession, path: str, slices: Sequence[Mapping[str, str]] | None = None) -> dict[tuple[str, ...], str]:
    """Folders of all partitions, or of those within some slices."""
    names = partition_names(spark, path)
    if slices is None:
        return partition_folders(spark, path, names)
    found = Files(spark).glob_all(slice_path(path, {**dict.fromkeys(names, "*"), **parts}) for parts in slices)
    return {tuple(partition_value(item, name) for name in names): item for item in found}


def stamps(spark: SparkSession, folders: Mapping[tuple[str, ...], str]) -> dict[tuple[str, ...], str]:
    """For each partition, a digest of the names and lengths of its files."""
    found = Files(spark).all_data_files(list(folders.values()))
    return {values: hashlib.sha256(repr(sorted(own.items())).encode()).hexdigest() for values, own in zip(folders, found)}


def _indexed(spark: SparkSession, index_path: str, names: Sequence[str]) -> dict[tuple[str, ...], str]:
    """The stamp of each filter; one row per partition reaches the driver."""
    if not Files(spark).exists(index_path) or partition_names(spark, index_path) != list(names):
        return {}
    found = read_as_text(spark, index_path).groupBy(*map(named, names)).agg(F.first(STAMP).alias(STAMP)).collect()
    return {tuple(NULL_PARTITION if row[name] is None else row[name] for name in names): row[STAMP] for row in found}


def _as_rows(spark: SparkSession, names: Sequence[str], parts: Mapping[tuple[str, ...], str]) -> DataFrame:
    fields = ", ".join(f"`{name}` string" for name in [*names, STAMP])
    return spark.createDataFrame([(*values, stamp) for values, stamp in parts.items()], fields)


def _text(names: Sequence[str]) -> list[Column]:
    return [F.coalesce(named(name).cast("string"), F.lit(NULL_PARTITION)).alias(name) for name in names]


def index_subjects(
    spark: SparkSession, path: str, index_path: str, key: str, slices: Sequence[Mapping[str, str]] | None = None
) -> int:
    """Make the filters of the partitions that have none or an old one, or of all in some slices just written; returns how many.

    Filters of dropped partitions stay, but are not used. Only the key column of those partitions is read. Keys are made distinct per partition first, so a hot subject is one row of each task.
    They meet the sizes of their filters, a row per partition, where they lie, so that no partition's keys pass through one task.
    """
    names = partition_names(spark, path)
    if not names:
        return 0
    folders = _folders(spark, path, slices)
    then = _indexed(spark, index_path, names) if slices is None else {}
    due = {values: stamp for values, stamp in stamps(spark, folders).items() if then.get(values) != stamp}
    if not due:
        return 0
    keys = read_as_text(spark, path, [folders[values] for values in due]).select(*_text(names), named(key).alias("_key"))
    keys = keys.where(F.col("_key").isNotNull()).distinct()
    sizes = keys.groupBy(*names).agg(F.count(F.lit(1)).alias("_keys"))
    # a partition without any key has a filter too: one empty word
    per_word = F.greatest(F.coalesce("_keys", F.lit(1)) / F.lit(KEYS_PER_WORD), F.lit(1))
    words = F.pow(F.lit(2), F.ceil(F.log2(per_word))).cast("long").alias(WORDS)
    known = _as_rows(spark, names, due).join(sizes, names, "left").select(*names, STAMP, words, F.col("_keys").isNull().alias("_empty"))
    bare = known.where("_empty").select(*names, STAMP, WORDS, F.lit(0).cast("long").alias(WORD), F.lit(0).cast("long").alias(HELD))
    filters = (
        keys.join(F.broadcast(known), names)
        .select(*names, STAMP, WORDS, _word(F.col("_key"), F.col(WORDS)).alias(WORD), _bits(F.col("_key")).alias(HELD))
        .groupBy(*names, STAMP, WORDS, WORD)
        .agg(F.bit_or(HELD).alias(HELD))
        .unionByName(bare)
    )
    overwrite_partitions(filters, index_path, names)
    return len(due)


def may_hold(spark: SparkSession, path: str, index_path: str, subjects: DataFrame | Listed, key: str) -> dict[tuple[str, ...], str]:
    """Folders of the partitions that may hold some of the subjects; names of partitions reach the driver."""
    names = partition_names(spark, path)
    folders = _folders(spark, path)
    now, then = stamps(spark, folders), _indexed(spark, index_path, names)
    fresh = {values for values, stamp in now.items() if then.get(values) == stamp}
    hit: set[tuple[str, ...]] = set()
    if fresh:
        index = read_as_text(spark, index_path)
        sizes = [row[0] for row in index.select(WORDS).distinct().collect()]  # powers of two, so at most 63
        listed = (subjects.keys if isinstance(subjects, Listed) else subjects).select(named(key).alias("_key")).na.drop().distinct()
        listed = listed.withColumn(WORDS, F.explode(F.array(*(F.lit(size).cast("long") for size in sizes))))
        asked = listed.select(WORDS, _word(F.col("_key"), F.col(WORDS)).alias(WORD), _bits(F.col("_key")).alias("_bits")).distinct()
        met = index.join(asked, [WORDS, WORD]).where(F.col(HELD).bitwiseAND(F.col("_bits")) == F.col("_bits"))
        hit = {tuple(row) for row in met.select(*_text(names)).distinct().collect()}
    return {values: folder for values, folder in folders.items() if values not in fresh or values in hit}


def erase_indexed(spark: SparkSession, path: str, index_path: str, subjects: DataFrame, key: str) -> list[dict[str, str]]:
    """`erase_from_table`, reading only partitions that may hold a subject; the filters of what changed are made anew."""
    names = partition_names(spark, path)
    if not names:
        raise ValueError(f"{path} is not a partitioned table")
    with listed_subjects(subjects, key) as listed:
        folders = may_hold(spark, path, index_path, listed, key)
        changed = erase_from_table(spark, path, listed, key, list(folders.values())) if folders else []
    if changed:
        index_subjects(spark, path, index_path, key)
    return changed
