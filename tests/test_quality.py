from datetime import date

import pytest
from support import plan, rows
from pyspark.sql import Row
from pyspark.sql import functions as F

import __spark_entry__ as entry
from lakestrata.operators import duplicates, quality
from lakestrata.operators.quality import Rule
from lakestrata.plans.sales import RULES
from lakestrata.sources.lake import overwrite_partitions

DATA = [("a", 1, 10), ("b", -1, None), ("c", None, 5), ("c", 3, 5), (None, 4, 1), (None, 5, 2)]


@pytest.fixture
def df(spark):
    return spark.createDataFrame(DATA, "k string, q int, p int")


def graded(df, *rules):
    results = quality.evaluate(df, rules, "p1", "silver", "2025-05-05").collect()
    return {r["rule_id"]: (r["status"], r["success_percentage"], r["total_records"], r["failing_records"]) for r in results}


def test_condition_null_is_not_a_failure(df):
    assert graded(df, Rule("r", "validity", condition="q > 0")) == {"r": ("ERROR", 5 / 6 * 100, 6, 1)}


def test_condition_takes_precedence_over_the_type(df):
    assert graded(df, Rule("r", "completeness", column="p", condition="p > 0")) == {"r": ("PASS", 100.0, 6, 0)}
    assert graded(df, Rule("r", "uniqueness", column="k", condition="q > -9")) == {"r": ("PASS", 100.0, 6, 0)}


def test_completeness(df):
    assert graded(df, Rule("r", "completeness", column="p", warning=99.0, error=80.0))["r"] == ("WARNING", 5 / 6 * 100, 6, 1)


def test_uniqueness_counts_every_row_of_a_key_but_no_null(df):
    assert graded(df, Rule("r", "uniqueness", column="k"))["r"] == ("ERROR", 4 / 6 * 100, 6, 2)


def test_skip_and_execution_error_beside_others(df):
    found = graded(
        df,
        Rule("skip", "referential", column="k"),
        Rule("bare", "completeness"),
        Rule("missing", "validity", condition="nope > 0"),
        Rule("syntax", "validity", condition="q >"),
        Rule("aggregate", "validity", condition="max(q) > 0"),
        Rule("key", "uniqueness", column="nope"),
        Rule("fine", "validity", condition="p IS NULL OR p > 0"),
    )
    assert found["skip"] == found["bare"] == ("SKIP", 100.0, 6, 0)
    for rule_id in ("missing", "syntax", "aggregate", "key"):
        assert found[rule_id] == ("EXECUTION_ERROR", 0.0, 6, 0)
    assert found["fine"] == ("PASS", 100.0, 6, 0)


def test_empty_input_passes_whatever_the_rule(df):
    rules = [Rule("a", "validity", condition="q > 0"), Rule("b", "uniqueness", column="k"), Rule("c", "x"), Rule("d", "validity", condition="nope")]
    assert set(graded(df.where("false"), *rules).values()) == {("PASS", 100.0, 0, 0)}


def test_thresholds_are_exclusive(spark):
    df = spark.range(100).withColumn("bad", F.col("id") == 0)
    rules = [Rule(f"w{w}e{e}", "validity", condition="NOT bad", warning=w, error=e) for w, e in ((99, 95), (99.5, 95), (100, 99.5))]
    assert [found[0] for found in graded(df, *rules).values()] == ["PASS", "WARNING", "ERROR"]


def test_no_rules_give_no_results(df):
    assert quality.evaluate(df, [], "p1", "silver", "2025-05-05").collect() == []
    assert quality.overall_status([]) == "PASS"


def test_many_days_in_one_pass_equal_the_single_days(spark):
    data = [(date(2025, 5, 1 + n % 3), f"k{n % 5}" if n % 4 else None, n - 3) for n in range(40)]
    df = spark.createDataFrame(data, "d date, k string, q int")
    rules = [Rule("q", "validity", condition="q > 0"), Rule("k", "uniqueness", column="k"), Rule("n", "completeness", column="k")]
    together = rows(quality.evaluate(df, rules, "p", "silver", F.col("d")))
    single = []
    for day in (1, 2, 3):
        one = quality.evaluate(df.where(F.col("d") == F.lit(date(2025, 5, day))), rules, "p", "silver", f"2025-05-0{day}")
        single += rows(one.withColumn("processing_date", F.col("processing_date").cast("date")))
    assert together == sorted(single, key=repr)


def test_row_rules_share_one_pass_over_the_columns_they_need(spark, tmp_path):
    spark.createDataFrame([("a", 1, 2.0, "x")], "order_id string, quantity int, unit_price_brl double, customer_email string").withColumn(
        "wide", F.lit("never read")
    ).write.parquet(str(tmp_path / "t"))
    text = plan(quality.evaluate(spark.read.parquet(str(tmp_path / "t")), RULES, "p", "silver", "d"))
    assert text.count("Scan parquet") == 2  # once in the tree, once in the details
    assert "wide" not in text and "order_id" not in text
    assert "Exchange SinglePartition" in text or "SinglePartition" in text


def test_rule_failing_at_run_time_is_isolated(spark):
    df = spark.createDataFrame([("1",), ("x",)], "t string")
    rules = [Rule("cast", "validity", condition="CAST(t AS INT) > 0"), Rule("ok", "validity", condition="t IS NOT NULL")]
    found = {row["rule_id"]: row["status"] for row in quality.run_rules(df, rules, "p", "silver", "d")}
    assert found == {"cast": "EXECUTION_ERROR", "ok": "PASS"}


def test_unreadable_input_is_no_rule_failure(spark):
    df = spark.createDataFrame([("x",)], "t string").select(F.raise_error(F.lit("lost")).cast("string").alias("t"))
    with pytest.raises(Exception, match="lost"):
        quality.run_rules(df.where("t <> ''"), [Rule("r", "validity", condition="t = 'x'")], "p", "silver", "d")


RULE_DOCUMENT = {
    "rule_id": "r1",
    "type": "validity",
    "target": {"column": "q"},
    "condition": {"sql": "q > 0"},
    "thresholds": {"warning": 99.0, "error": 95.0},
    "actions": {"on_error": ["log", "quarantine"]},
}


def test_rules_beside_a_profile_follow_its_scope():
    config = {"quality_profile": {"scope": ["silver"]}, "rules": [RULE_DOCUMENT]}
    assert [rule.rule_id for rule in quality.rules_for(config, "silver")] == ["r1"]
    assert quality.rules_for(config, "gold") == []


def test_rules_of_several_profiles_and_bare_rules():
    inner = {**RULE_DOCUMENT, "rule_id": "r2"}
    config = {"quality_profiles": [{"scope": ["gold"], "rules": [inner]}, {"rules": [RULE_DOCUMENT]}]}
    assert [rule.rule_id for rule in quality.rules_for(config, "gold")] == ["r2", "r1"]
    assert [rule.rule_id for rule in quality.rules_for(config, "silver")] == ["r1"]
    (bare,) = quality.rules_for({"rules": [RULE_DOCUMENT]}, "bronze")
    assert (bare.condition, bare.warning, bare.error, bare.on_error, bare.on_warning) == ("q > 0", 99.0, 95.0, ("log", "quarantine"), ())


def test_rule_without_thresholds_needs_all_rows(df):
    (rule,) = quality.rules_for({"rules": [{"rule_id": "r", "type": "completeness", "target": {"column": "p"}}]}, "silver")
    assert graded(df, rule)["r"][0] == "ERROR"


def results(*statuses):
    return [Row(rule_id=f"r{n}", status=status, failing_records=1) for n, status in enumerate(statuses)]


@pytest.mark.parametrize(
    "statuses, worst",
    [((), "PASS"), (("PASS", "SKIP"), "PASS"), (("PASS", "WARNING"), "WARNING"), (("WARNING", "EXECUTION_ERROR"), "ERROR"), (("ERROR",), "ERROR")],
)
def test_overall_status(spark, statuses, worst):
    assert quality.overall_status(results(*statuses)) == worst
    if statuses:
        df = spark.createDataFrame([("p", "silver", "d", s) for s in statuses], "pipeline_id string, target_layer string, processing_date string, status string")
        assert quality.overall(df).first()["overall_status"] == worst


def test_abort_decision():
    asking = [Rule("r0", "validity", on_error=("abort_pipeline",))]
    silent = [Rule("r0", "validity", on_error=("log",))]
    assert not quality.must_abort(results("WARNING"), asking)
    assert quality.must_abort(results("ERROR"), silent)
    assert not quality.must_abort(results("ERROR"), silent, allow_partial_success=True)
    assert quality.must_abort(results("ERROR"), asking, allow_partial_success=True)
    # A rule that could not run triggers no action of its own.
    assert not quality.must_abort(results("EXECUTION_ERROR"), asking, allow_partial_success=True)


def test_actions_due(df):
    rules = [
        Rule("q", "validity", condition="q > 0", on_error=("log", "notify_slack")),
        Rule("p", "completeness", column="p", warning=99, error=50, on_warning=("quarantine",), on_error=("log",)),
        Rule("broken", "validity", condition="nope", on_error=("log",)),
    ]
    due = quality.actions_due(quality.evaluate(df, rules, "p1", "silver", "d"), rules)
    assert rows(due, "rule_id", "action", "handled") == [("p", "quarantine", True), ("q", "log", True), ("q", "notify_slack", False)]


ALL = [Rule("q", "validity", condition="q > 0"), Rule("p", "completeness", column="p"), Rule("k", "uniqueness", column="k"), Rule("x", "validity", condition="nope")]


def test_failing_rows_per_rule(df):
    found = rows(quality.failing_rows(df, ALL), "rule_id", "k", "q", "p")
    assert found == [("k", "c", 3, 5), ("k", "c", None, 5), ("p", "b", -1, None), ("q", "b", -1, None)]


def test_passing_rows_are_the_others(df):
    assert rows(quality.passing_rows(df, ALL)) == [("a", 1, 10), (None, 4, 1), (None, 5, 2)]


def test_passing_rows_judge_keys_before_other_rules_drop_rows(spark):
    df = spark.createDataFrame([("a", 1), ("a", -1)], "k string, q int")
    assert rows(quality.passing_rows(df, [Rule("q", "validity", condition="q > 0"), Rule("k", "uniqueness", column="k")])) == []


def test_failing_rows_push_the_filter_to_the_scan(df, spark, tmp_path):
    df.write.parquet(str(tmp_path / "t"))
    text = plan(quality.failing_rows(spark.read.parquet(str(tmp_path / "t")), ALL[:2]))
    assert "Or(LessThanOrEqual(q,0),IsNull(p))" in text.replace("PushedFilters: ", "")


def test_quarantine_rerun_replaces_and_clears(df, spark, tmp_path):
    path = str(tmp_path / "quarantine")
    rules = [Rule("q", "validity", condition="q > 0", on_error=("quarantine",)), Rule("k", "uniqueness", column="k", on_error=("quarantine",)), Rule("p", "completeness", column="p", on_error=("log",))]
    found = quality.run_rules(df, rules, "p1", "silver", "2025-05-05")
    for _ in range(2):
        assert quality.quarantine(df, rules, found, path, "silver", "2025-05-05") == 3
    stored = spark.read.parquet(path)
    assert rows(stored, "target_layer", F.col("processing_date").cast("string"), "rule_id", "k") == [("silver", "2025-05-05", "k", "c")] * 2 + [("silver", "2025-05-05", "q", "b")]
    other = df.where("k = 'c'")
    again = quality.run_rules(other, rules, "p1", "silver", "2025-05-05")
    quality.quarantine(other, rules, again, path, "silver", "2025-05-05")
    assert {row["rule_id"] for row in spark.read.parquet(path).collect()} == {"k"}
    quality.quarantine(df, rules, [], path, "silver", "2025-05-05")
    assert not (tmp_path / "quarantine/target_layer=silver/processing_date=2025-05-05").exists()


def test_quarantine_shuffles_the_rows_of_rules_that_fail_few(spark, tmp_path, settings):
    settings(spark__sql__autoBroadcastJoinThreshold="-1")
    columns = ["CAST(id DIV 2 AS STRING) AS k", "IF(id = 7, -1, CAST(id AS INT)) AS q"]
    spark.range(0, 1000, 1, 4).selectExpr(*columns).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    rules = [Rule("q", "validity", condition="q >= 0", on_error=("quarantine",)), Rule("k", "uniqueness", column="k", on_error=("quarantine",))]
    due = {row["rule_id"]: row for row in quality.run_rules(df, rules, "p1", "silver", "2025-05-05")}
    assert {name: row["failing_records"] for name, row in due.items()} == {"q": 1, "k": 1000}
    # behind the join of the duplicated keys their rows are not shuffled again
    assert "REBALANCE" not in plan(quality.rows_due(df, rules, [due["k"]])).upper()
    assert plan(quality.rows_due(df, rules, [due["q"]])).upper().count("REBALANCE_PARTITIONS") > 0
    both = quality.rows_due(df, rules, list(due.values()))
    assert rows(both, "rule_id", "k", "q") == rows(quality.failing_rows(df, rules), "rule_id", "k", "q")
    path = str(tmp_path / "quarantine")
    assert quality.quarantine(df, rules, list(due.values()), path, "silver", "2025-05-05") == 1001
    assert rows(spark.read.parquet(path), "rule_id", "k", "q") == rows(both, "rule_id", "k", "q")


def test_quarantine_query_counts_its_keys_once(spark, monkeypatch):
    calls = []
    count = duplicates.key_counts
    monkeypatch.setattr(duplicates, "key_counts", lambda *of: calls.append(of) or count(*of))
    assert entry.queries()["dq_quarantine"](spark, "/root/testdata/sf0.001").count() > 0
    assert len(calls) == 1


def test_gate_follows_the_latest_results(df, spark, tmp_path):
    path = str(tmp_path / "dq")
    assert quality.gate(spark, path, "silver", "2025-05-05") == "UNKNOWN"
    bad = quality.evaluate(df, [Rule("q", "validity", condition="q > 0")], "p1", "silver", "2025-05-05")
    quality.save_results(bad, path, "silver", "2025-05-05")
    assert quality.gate(spark, path, "silver", "2025-05-05") == "ERROR"
    assert quality.gate(spark, path, "silver", "2025-05-06") == "UNKNOWN"
    good = quality.evaluate(df.where("q > 0"), [Rule("q", "validity", condition="q > 0")], "p1", "silver", "2025-05-05")
    quality.save_results(good, path, "silver", "2025-05-05")
    assert quality.gate(spark, path, "silver", "2025-05-05") == "PASS"


def test_gates_of_many_days(df, spark, tmp_path):
    days = df.withColumn("d", F.when(F.col("q") < 0, F.lit(date(2025, 5, 6))).otherwise(F.lit(date(2025, 5, 5))))
    found = quality.evaluate(days, [Rule("q", "validity", condition="q > 0")], "p1", "silver", F.col("d"))
    overwrite_partitions(found, str(tmp_path / "dq"), ["target_layer", "processing_date"])
    decided = quality.gates(spark.read.parquet(str(tmp_path / "dq")))
    assert rows(decided, "processing_date", "decision") == [(date(2025, 5, 5), "open"), (date(2025, 5, 6), "blocked")]
