from datetime import date

import pytest
from pyspark.sql import functions as F
from support import plan, rows

from lakestrata.operators.key_history import KeyHistory

D1, D2, D3 = (date(2025, 5, d) for d in (1, 2, 3))
TYPES = {"order id": "string", "line": "int"}


def load(spark, *keys):
    return spark.createDataFrame(list(keys), "`order id` string, line int")


@pytest.fixture
def history(spark, tmp_path):
    return KeyHistory(spark, str(tmp_path / "keys"), TYPES, buckets=5)


def test_repeated_within_and_across_loads(spark, history):
    history.replace(load(spark, ("a", 1), ("a", 1), ("b", 1), ("c", 1), (None, 1), (None, 1)), D1)
    history.replace(load(spark, ("b", 1), ("d", 1), ("a", 2)), D2)
    third = load(spark, ("a", 1), ("b", 1), ("e", 1), ("e", 1), ("f", 1), ("a", None), ("a", None))
    assert rows(history.repeated_in(third, D3)) == [("a", 1, 1, 2, D1), ("b", 1, 1, 2, D1), ("e", 1, 2, 0, None)]
    assert rows(history.repeated()) == [("a", 1, 2, 1, D1), ("b", 1, 2, 2, D1)]
    # a load that is stored already does not count against itself
    history.replace(third, D3)
    assert rows(history.repeated_in(third, D3)) == [("a", 1, 1, 2, D1), ("b", 1, 1, 2, D1), ("e", 1, 2, 0, None)]


def test_a_day_loaded_again_replaces_its_keys(spark, history):
    history.replace(load(spark, ("a", 1), ("b", 1)), D1)
    history.replace(load(spark, ("a", 1)), D2)
    history.replace(load(spark, ("c", 1)), D1)
    assert rows(history.repeated()) == []
    assert rows(history.all()) == [("a", 1, 1, D2), ("c", 1, 1, D1)]
    history.forget(D2)
    assert rows(history.all()) == [("c", 1, 1, D1)]


def test_many_loads_at_once_and_another_session(spark, history, tmp_path):
    both = load(spark, ("a", 1), ("b", 1)).withColumn("load_date", F.lit(D1)).unionByName(load(spark, ("a", 1)).withColumn("load_date", F.lit(D2)))
    history.replace_all(both)
    other = spark.newSession()
    again = KeyHistory(other, str(tmp_path / "keys"), TYPES, buckets=5)
    assert rows(again.repeated()) == [("a", 1, 2, 2, D1)]


@pytest.mark.parametrize("partitions", ["3", "50"])
def test_stored_keys_are_not_shuffled(spark, history, settings, partitions):
    settings(spark__sql__autoBroadcastJoinThreshold="-1", spark__sql__adaptive__autoBroadcastJoinThreshold="-1", spark__sql__shuffle__partitions=partitions)
    history.replace(load(spark, *((f"k{i}", 1) for i in range(300))), D1)
    history.replace(load(spark, *((f"k{i}", 1) for i in range(200, 500))), D2)
    new = load(spark, *((f"k{i}", 1) for i in range(250, 600)))
    found = history.repeated_in(new, D3)
    assert found.count() == 250
    assert "Exchange" not in plan(history.repeated())
    # two exchanges deal out the new keys, counted and then by bucket; the stored table has none
    assert plan(found).split("\n(1)")[0].count("Exchange") == 2 and "Bucketed: true" in plan(found)
