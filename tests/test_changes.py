from datetime import datetime, timedelta

import pytest
from support import plan, rows

from lakestrata.operators.contract import load_gaps
from lakestrata.operators.runlog import step_attempts
from lakestrata.operators.steps import AggSpec, totals

SPECS = [AggSpec("n", "sum", "total"), AggSpec("n", "avg", "mean"), AggSpec("n", "count", "filled")]


def test_totals_tell_a_null_value_from_a_total(spark):
    df = spark.createDataFrame([("a", "x", 1), ("a", None, 2), (None, "x", 4), ("a", "x", None)], "p string, q string, n int")
    found = totals(["p", "q"], SPECS)(df)
    assert rows(found, "p", "q", "total_level", "total", "filled") == sorted(
        [("a", "x", 0, 1, 1), ("a", None, 0, 2, 1), (None, "x", 0, 4, 1), ("a", None, 1, 3, 2), (None, None, 1, 4, 1), (None, None, 3, 7, 3)], key=repr
    )
    chosen = totals(["p", "q"], SPECS, levels=[["q"], []])(df)
    assert rows(chosen, "p", "q", "total_level", "total") == sorted([(None, "x", 2, 5), (None, None, 2, 2), (None, None, 3, 7)], key=repr)


def test_totals_expand_once_and_sum_before_the_shuffle(spark):
    df = spark.range(1000).selectExpr("id % 3 AS p", "id % 5 AS q", "id AS n")
    text = plan(totals(["p", "q"], [AggSpec("n", "sum", "total")])(df))
    assert text.count("Expand (") == 1 and "partial_sum" in text
    assert sum("Exchange (" in line for line in text.split("\n\n\n")[0].splitlines()) <= 1


def test_totals_of_nothing_and_wrong_levels(spark):
    empty = spark.createDataFrame([], "p string, n int")
    assert rows(totals(["p"], SPECS, levels=[["p"]])(empty)) == []
    assert rows(totals([], SPECS)(empty), "total_level", "filled") == [(0, 0)]
    with pytest.raises(ValueError, match="not grouped by: z"):
        totals(["p"], SPECS, levels=[["z"]])
    with pytest.raises(ValueError, match="no level"):
        totals(["p"], SPECS, levels=[])


def hours(spark, given, schema="k string, ts timestamp"):
    return spark.createDataFrame([(key, datetime(1969, 12, 1) + timedelta(hours=at)) for key, at in given], schema)


def brute_gaps(given):
    """Neighbours more than an hour apart, per key."""
    per_key = {}
    for key, at in given:
        per_key.setdefault(key, set()).add(at)
    return sorted(((key, b - a) for key, found in per_key.items() for a, b in zip(sorted(found), sorted(found)[1:]) if b - a > 1), key=repr)


def test_gaps_within_and_across_ranges(spark):
    edges = [k * 4096 + d for k in (0, 1, 2, 7, 8, 64, 65, 100) for d in (-1, 0, 1, 2000)]
    given = [(None, at) for at in edges] + [("hot", at) for at in range(0, 9000, 1) if at % 613 not in (0, 1)] + [("one", 5), ("one", 5)]
    found = load_gaps(hours(spark, given), "ts", 1, by=["k"])
    assert rows(found, "k", "gap_hours") == brute_gaps(given)


def test_gaps_of_the_whole_table_without_a_window_over_all(spark):
    given = [("x", at) for at in (0, 1, 2, 5, 4095, 4096, 50_000, 400_000)] + [("y", 6), ("y", 7)]
    found = load_gaps(hours(spark, given), "ts", 1)
    assert sorted(r.gap_hours for r in found.collect()) == sorted(gap for _, gap in brute_gaps([("all", at) for _, at in given]))
    text = plan(found)
    assert "SinglePartition" not in text
    assert rows(load_gaps(hours(spark, given[:1]), "ts", 1)) == []
    assert rows(load_gaps(spark.createDataFrame([], "ts timestamp"), "ts", 1)) == []


def test_gaps_over_all_years(spark):
    moments = [datetime(1, 1, 2), datetime(1970, 1, 1), datetime(9999, 12, 30)]
    found = load_gaps(spark.createDataFrame([(m,) for m in moments], "ts timestamp"), "ts", 1)
    expected = sorted(int((b - a).total_seconds()) // 3600 for a, b in zip(moments, moments[1:]))
    assert sorted(r.gap_hours for r in found.select("gap_hours").collect()) == expected


def test_attempts(spark, settings):
    start = datetime(2025, 1, 1)
    at = lambda minutes: start + timedelta(minutes=minutes)
    events = [
        ("p", "load", "STARTING", at(0)), ("p", "load", "FAILED", at(5)), ("p", "load", "STARTING", at(20)), ("p", "load", "FAILED", at(21)),
        ("p", "load", "STARTING", at(40)), ("p", "load", "SUCCEEDED", at(45)), ("p", "load", "STARTING", at(76)), ("p", "check", "INFO", at(1)),
        ("q", "load", "SUCCEEDED", at(2)), ("q", "load", "FAILED", at(2)), ("p", "load", "STARTING", None),
    ]
    df = spark.createDataFrame(events, "pipeline_id string, step_name string, status string, timestamp_utc timestamp").repartition(4)
    expected = sorted(
        [("p", "load", 6, 3, 2, "SUCCEEDED", 1200.0), ("p", "load", 1, 1, 0, None, None), ("p", "check", 1, 0, 0, None, None), ("q", "load", 2, 0, 1, "SUCCEEDED", None)],
        key=repr,
    )
    columns = ("pipeline_id", "step_name", "events", "attempts", "failures", "outcome", "seconds_between")
    assert rows(step_attempts(df), *columns) == expected
    settings(spark__sql__sessionWindow__merge__sessions__in__local__partition="true")
    merged = step_attempts(df)
    assert rows(merged, *columns) == expected
    assert "MergingSessions" in plan(merged)


def test_events_exactly_a_pause_apart_are_one_run(spark):
    moments = [datetime(2025, 1, 1), datetime(2025, 1, 1, 0, 30), datetime(2025, 1, 1, 1, 0, 0, 1)]
    df = spark.createDataFrame([("p", "s", "STARTING", m) for m in moments], "pipeline_id string, step_name string, status string, timestamp_utc timestamp")
    assert rows(step_attempts(df), "attempts") == [(1,), (2,)]
