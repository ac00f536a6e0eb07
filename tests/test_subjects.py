from pathlib import Path

import pytest
from pyspark.sql import functions as F
from support import plan, rows

from lakestrata.operators import governance
from lakestrata.operators import subjects as S
from lakestrata.operators.governance import erase_from_table
from lakestrata.session import shared_dir
from lakestrata.sources.lake import overwrite_partitions
from lakestrata.sources.storage import Files


@pytest.fixture
def places(spark, tmp_path):
    """A table of 40 partitions; each subject is in one of them, but u0 in all, and rows without a key or a part."""
    df = spark.range(4000).select(
        F.lpad((F.col("id") % 40).cast("string"), 2, "0").alias("part"), F.concat(F.lit("u"), F.when(F.col("id") < 40, 0).otherwise(F.col("id"))).alias("email"), "id"
    )
    more = spark.createDataFrame([("07", None, -1), (None, "u5", -2), (None, None, -3), ("99", None, -4)], "part string, email string, id long")
    path = str(tmp_path / "t")
    overwrite_partitions(df.unionByName(more), path, ["part"])
    return path, str(tmp_path / "index")


def subjects(spark, *names):
    return spark.createDataFrame([(name,) for name in names], "email string")


def hidden(path, keep):
    """Make every partition but some unreadable, so that reading it fails."""
    for file in Path(path).glob("*/part-*"):
        if file.parent.name not in keep:
            file.write_bytes(b"x" * file.stat().st_size)


def test_only_partitions_that_may_hold_a_subject_are_read(spark, places):
    path, index = places
    assert S.index_subjects(spark, path, index, "email") == 42
    wanted = subjects(spark, "u47", "u87", "u100", None)
    folders = S.may_hold(spark, path, index, wanted, "email")
    own = {("07",), ("20",)}
    assert own <= set(folders) and len(folders) <= 8
    # what is not named by the filters cannot be read any more, and nobody tries
    hidden(path, {f"part={values[0]}" for values in folders})
    changed = S.erase_indexed(spark, path, index, wanted, "email")
    assert changed == [{"part": "07"}, {"part": "20"}]
    assert rows(spark.read.parquet(f"{path}/part=07").where("email IN ('u47', 'u87')")) == []


def test_as_without_an_index(spark, places, tmp_path):
    path, index = places
    other = str(tmp_path / "other")
    overwrite_partitions(spark.read.option("basePath", path).parquet(path).withColumn("part", F.lpad(F.col("part").cast("string"), 2, "0")), other, ["part"])
    S.index_subjects(spark, path, index, "email")
    wanted = subjects(spark, "u0", "u5", "u111", "nobody")
    assert S.erase_indexed(spark, path, index, wanted, "email") == erase_from_table(spark, other, wanted, "email")
    assert rows(spark.read.parquet(path), "id") == rows(spark.read.parquet(other), "id")
    assert S.erase_indexed(spark, path, index, wanted, "email") == []


def test_changed_and_new_partitions_count_as_holding_everyone(spark, places):
    path, index = places
    S.index_subjects(spark, path, index, "email")
    spark.createDataFrame([("u4711", 1)], "email string, id long").write.mode("append").parquet(f"{path}/part=03")
    spark.createDataFrame([("u4711", 2)], "email string, id long").write.parquet(f"{path}/part=new")
    wanted = subjects(spark, "u4711")
    assert {("03",), ("new",)} <= set(S.may_hold(spark, path, index, wanted, "email"))
    assert S.erase_indexed(spark, path, index, wanted, "email") == [{"part": "03"}, {"part": "new"}]
    assert spark.read.parquet(path).where("email = 'u4711'").count() == 0
    assert S.index_subjects(spark, path, index, "email") == 0  # erasure left the index up to date


def test_an_index_that_is_not_there(spark, places):
    path, index = places
    assert len(S.may_hold(spark, path, index, subjects(spark, "u1"), "email")) == 42
    assert S.erase_indexed(spark, path, index, subjects(spark, "u50"), "email") == [{"part": "10"}]
    with pytest.raises(ValueError):
        S.erase_indexed(spark, f"{path}/part=10", index, subjects(spark, "u50"), "email")


def written(monkeypatch, module):
    """What a module hands to `overwrite_partitions`: the plan, and whether the rows lie as they are to be written."""
    calls, write = [], module.overwrite_partitions

    def note(df, path, names, clustered=False):
        calls.append((plan(df), clustered))
        return write(df, path, names, clustered)

    monkeypatch.setattr(module, "overwrite_partitions", note)
    return calls


@pytest.mark.parametrize("few", [True, False])
def test_the_list_is_computed_once_and_few_subjects_shuffle_no_rows(spark, places, settings, monkeypatch, few):
    path, index = places
    settings(spark__sql__autoBroadcastJoinThreshold="-1")
    if not few:
        monkeypatch.setattr(governance, "MOST_BROADCAST", 1)
    S.index_subjects(spark, path, index, "email")
    before = rows(spark.read.parquet(path).where("coalesce(email, '') NOT IN ('u5', 'u47')"), "id")
    seen, writes = spark.sparkContext.accumulator(0), written(monkeypatch, governance)
    wanted = spark.sparkContext.parallelize(["u5", "u47"], 1).map(lambda name: seen.add(1) or (name,)).toDF("email string")
    assert len(S.erase_indexed(spark, path, index, wanted, "email")) == 2
    assert seen.value == 2
    assert [clustered for _, clustered in writes] == [few]
    assert ("BroadcastHashJoin" in writes[0][0]) == few and ("SortMergeJoin" in writes[0][0]) != few
    assert rows(spark.read.parquet(path), "id") == before
    assert not [item for item in Files(spark).folders(shared_dir(spark) + "/lakestrata") if "/subjects-" in item]


def test_keys_of_a_partition_are_not_gathered_to_size_its_filter(spark, places, settings, monkeypatch):
    path, index = places
    settings(spark__sql__autoBroadcastJoinThreshold="-1")
    writes = written(monkeypatch, S)
    spark.createDataFrame([(None, 1)], "email string, id long").write.parquet(f"{path}/part=bare")
    assert S.index_subjects(spark, path, index, "email") == 43
    assert "BroadcastHashJoin" in writes[0][0]
    found = spark.read.parquet(index).groupBy("part").agg(F.max(S.HELD).alias("held"), F.max(S.WORDS).alias("words"))
    assert [tuple(row) for row in found.where("part = 'bare'").collect()] == [("bare", 0, 1)] and found.count() == 43
    assert S.index_subjects(spark, path, index, "email") == 0
