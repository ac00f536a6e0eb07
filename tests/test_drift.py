from collections import Counter, defaultdict
import random

import pytest
from support import plan, rows

from lakestrata.operators.drift import drift_summary, version_drift

SCHEMA = "k string, a string, b int"


def brute(old, new):
    """Differences of two lists of (key, a, b) by counting rows in plain Python."""
    surplus = Counter(new)
    surplus.subtract(Counter(old))
    keys = defaultdict(lambda: ([], []))
    for row, n in surplus.items():
        if n:
            keys[row[0]][n > 0].extend([row] * abs(n))
    out = []
    for key, (gone, came) in keys.items():
        kind = "added" if not gone else "removed" if not came else "changed"
        single = len(gone) == len(came) == 1
        changed = [name for i, name in enumerate(("a", "b"), 1) if gone[0][i] != came[0][i]] if single else None
        out.append((key, kind, len(gone), len(came), changed))
    return sorted(out, key=repr)


def test_as_counted_in_python(spark):
    rng = random.Random(5)
    made = lambda n: [(rng.choice([None, "x", "y", *map(str, range(60))]), rng.choice([None, "", "p", "q"]), rng.choice([None, 0, 1])) for _ in range(n)]
    shared = made(80)
    old, new = shared + made(40), shared + made(40)
    found = version_drift(spark.createDataFrame(old, SCHEMA).repartition(5), spark.createDataFrame(new, SCHEMA).repartition(3), ["k"])
    assert [(*r[:4], r[4] and list(r[4])) for r in rows(found)] == brute(old, new)


def test_null_is_no_value_and_cells_do_not_mix(spark):
    old = spark.createDataFrame([("1", None, 0), ("2", "p", None), ("3", "", 1)], SCHEMA)
    new = spark.createDataFrame([("1", "", 0), ("2", None, None), ("3", "", 1)], SCHEMA)
    assert rows(version_drift(old, new, ["k"]), "k", "changed_columns") == [("1", ["a"]), ("2", ["a"])]


def test_empty_equal_and_extra_columns(spark):
    df = spark.createDataFrame([("1", "p", 0), ("1", "p", 0)], SCHEMA)
    empty = spark.createDataFrame([], SCHEMA)
    assert rows(version_drift(df, df.withColumnRenamed("b", "c"), ["k"])) == []  # only `a` is in both
    assert rows(version_drift(df, empty, ["k"])) == [("1", "removed", 2, 0, None)]
    assert rows(version_drift(empty, empty, ["k"])) == []
    assert rows(version_drift(df, df.distinct(), ["k"])) == [("1", "removed", 1, 0, None)]
    assert rows(version_drift(df, empty, ["k", "a", "b"], [])) == [("1", "p", 0, "removed", 2, 0, None)]
    with pytest.raises(ValueError, match="not in both"):
        version_drift(df, df, ["k"], ["z"])
    with pytest.raises(ValueError, match="by a key"):
        version_drift(df, df, [])


def test_clashing_names(spark):
    old = spark.createDataFrame([("1", 2, 3)], "change string, old_rows int, `a.b` int")
    new = spark.createDataFrame([("1", 2, 4)], "change string, old_rows int, `a.b` int")
    found = version_drift(old, new, ["change"])
    assert [tuple(r) for r in found.collect()] == [("1", "changed", 1, 1, ["a.b"])]


def test_summary(spark):
    old = spark.createDataFrame([("1", "p", 0), ("2", "p", 0), ("3", "p", 0)], SCHEMA)
    new = spark.createDataFrame([("1", "q", 1), ("2", "q", 0), ("4", "p", 0)], SCHEMA)
    found = rows(drift_summary(version_drift(old, new, ["k"])))
    assert found == sorted(
        [("added", None, 1, 0, 1), ("removed", None, 1, 1, 0), ("changed", None, 2, 2, 2), ("changed", "a", 2, 2, 2), ("changed", "b", 1, 1, 1)], key=repr
    )


def test_a_hot_key_is_summed_before_the_shuffle(spark):
    many = spark.range(20_000).selectExpr("'hot' AS k", "CAST(id % 3 AS string) AS a", "1 AS b")
    found = version_drift(many, many.where("a != '2'"), ["k"])
    assert rows(found) == [("hot", "removed", 6666, 0, None)]
    text = plan(found)
    assert "Join" not in text and "Window" not in text
    assert "partial_sum" in text
