from dataclasses import replace
from datetime import date, datetime, timedelta
from decimal import Decimal
from pathlib import Path
from shutil import rmtree

import pytest
from support import plan, rows
from pyspark.sql import functions as F

from lakestrata.operators.governance import Retention
from lakestrata.operators.quality import DataQualityError, Rule
from lakestrata.operators.runlog import RunLog, run_summary
from lakestrata.operators.steps import chain, steps_for
from lakestrata.plans import sales
from lakestrata.plans.backfill import run_days
from lakestrata.plans.daily import DailyJob
from lakestrata.plans.stewardship import erase_from_lake, retain_lake
from lakestrata.session import shared_dir
from lakestrata.sources.lake import day_parts, slice_path
from lakestrata.sources.landing import landing_day
from lakestrata.sources.storage import Files

HEADER = "order_id,product_id,quantity,unit_price_brl,order_timestamp,customer_email,status"
AS_OF = datetime(2025, 5, 10, 12)
D5, D6, D7 = (date(2025, 5, d) for d in (5, 6, 7))


@pytest.fixture
def job(tmp_path):
    return DailyJob(
        pipeline_id=sales.PIPELINE_ID,
        domain=sales.DOMAIN,
        contract=sales.CONTRACT,
        steps=sales.STEPS,
        rules=sales.RULES,
        landing=str(tmp_path / "landing/{yyyy}/{MM}/{dd}/"),
        root=str(tmp_path / "lake"),
    )


def land(job, day, *lines):
    folder = Path(job.landing.format(yyyy=day.year, MM=f"{day.month:02d}", dd=f"{day.day:02d}"))
    folder.mkdir(parents=True, exist_ok=True)
    (folder / "f.csv").write_text("\n".join([HEADER, *lines, ""]))


def line(order, product, quantity, price, ts, status="completed", email="a@x"):
    return f"{order},{product},{quantity},{price},{ts},{email},{status}"


def gold(job, spark):
    return rows(job.gold(spark), "product_id", "order_date", "total_quantity", "total_aggregated_value_usd")


def test_a_day_through_all_layers(spark, job):
    land(
        job,
        D5,
        line("O1", "A", 2, 100.0, "2025-05-05T10:00:00Z"),
        line("O2", "A", 1, 50.0, "2025-05-05T23:59:59Z"),
        line("O3", "B", 1, 10.0, "2025-05-05T01:00:00Z", status="pending"),
    )
    assert job.run(spark, D5, AS_OF) == "PASS"
    bronze = job.bronze(spark, D5)
    assert bronze.count() == 3 and bronze.dtypes == [(f.name, f.dataType.simpleString()) for f in sales.CONTRACT.schema("bronze")]
    assert rows(job.silver(spark), "order_id", "unit_price_usd", "total_value_usd") == [
        ("O1", Decimal("20.00"), Decimal("40.00")),
        ("O2", Decimal("10.00"), Decimal("10.00")),
    ]
    assert gold(job, spark) == [("A", D5, 3, Decimal("50.00"))]
    assert dict(job.gold(spark).dtypes)["total_aggregated_value_usd"] == "decimal(20,2)"


def test_rerun_changes_nothing_and_late_rows_add_up(spark, job):
    land(job, D5, line("O1", "A", 2, 100.0, "2025-05-05T10:00:00Z"))
    land(job, D6, line("O2", "A", 1, 100.0, "2025-05-05T22:00:00Z"), line("O3", "A", 4, 100.0, "2025-05-06T10:00:00Z"))
    for day in (D5, D6, D6, D5):
        job.run(spark, day, AS_OF)
    assert gold(job, spark) == [("A", D5, 3, Decimal("60.00")), ("A", D6, 4, Decimal("80.00"))]


def test_a_corrected_load_takes_back_its_dates(spark, job):
    land(job, D5, line("O1", "A", 2, 100.0, "2025-05-05T10:00:00Z"))
    land(job, D6, line("O2", "A", 1, 100.0, "2025-05-05T22:00:00Z"), line("O3", "A", 4, 100.0, "2025-05-07T10:00:00Z"))
    job.run(spark, D5, AS_OF)
    job.run(spark, D6, AS_OF)
    assert len(gold(job, spark)) == 2
    land(job, D6, line("O3", "B", 4, 100.0, "2025-05-06T10:00:00Z"))
    job.run(spark, D6, AS_OF)
    assert gold(job, spark) == [("A", D5, 2, Decimal("40.00")), ("B", D6, 4, Decimal("80.00"))]


@pytest.mark.parametrize("many", [False, True])
def test_a_run_that_dies_before_gold_is_made_good_by_the_next(spark, job, monkeypatch, many):
    def run(day):
        return run_days(job, spark, [day], AS_OF) if many else job.run(spark, day, AS_OF)

    land(job, D6, line("O2", "A", 1, 100.0, "2025-05-05T22:00:00Z"), line("O3", "A", 4, 100.0, "2025-05-06T10:00:00Z"))
    run(D6)
    land(job, D6, line("O3", "B", 4, 100.0, "2025-05-06T10:00:00Z"))
    with monkeypatch.context() as broken:
        broken.setattr(DailyJob, "refresh_gold", lambda *_: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            run(D6)
    assert len(gold(job, spark)) == 2  # still the old one
    run(D6)
    assert gold(job, spark) == [("B", D6, 4, Decimal("80.00"))]


def test_untouched_gold_dates_are_not_rewritten(spark, job, tmp_path):
    def files():
        return {p.parent.name: p.name for p in (tmp_path / "lake/gold").glob("order_date=*/part-*")}

    land(job, D5, line("O1", "A", 2, 100.0, "2025-05-05T10:00:00Z"))
    land(job, D6, line("O2", "A", 2, 100.0, "2025-05-06T10:00:00Z"))
    job.run(spark, D5, AS_OF)
    before = files()
    job.run(spark, D6, AS_OF)
    assert files()["order_date=2025-05-05"] == before["order_date=2025-05-05"]


def test_gold_can_be_rebuilt_whole(spark, job):
    land(job, D5, line("O1", "A", 2, 100.0, "2025-05-05T10:00:00Z"), line("O2", "A", 2, 100.0, "2025-05-06T10:00:00Z"))
    job.run(spark, D5, AS_OF)
    expected = gold(job, spark)
    assert job.refresh_gold(spark) == 2
    assert gold(job, spark) == expected
    assert job.refresh_gold(spark, []) == 0


def test_empty_and_missing_days(spark, job):
    land(job, D5)
    assert job.run(spark, D5, AS_OF) == "PASS"
    assert job.bronze(spark, D5) is None
    with pytest.raises(FileNotFoundError):
        job.run(spark, D6, AS_OF)
    with pytest.raises(FileNotFoundError):
        job.build_silver(spark, D6)
    land(job, D5, line("O1", "A", 2, 100.0, "2025-05-05T10:00:00Z"))
    job.run(spark, D5, AS_OF)
    land(job, D5)
    assert job.run(spark, D5, AS_OF) == "PASS"
    assert job.bronze(spark, D5).count() == 1  # an empty file replaces nothing


def test_what_did_not_parse_is_counted_and_kept(spark, job):
    bad = [line("O1", "A", "n/a", 100.0, "2025-05-05T10:00:00Z"), line("O2", "A", 1, 100.0, "05/05/2025 10h"), line("O3", "A", "", "x", "2025-05-05T11:00:00Z")]
    land(job, D5, *bad, *[line(f"P{n}", "C", 1, 5.0, "2025-05-05T10:00:00Z") for n in range(7)])
    land(job, D6, line("O9", "A", 1, 1.0, "2025-05-06T10:00:00Z"))
    job.ingest(spark, D5, AS_OF)
    together = replace(job, root=job.root + "-together")
    run_days(together, spark, [D5, D6], AS_OF)
    for one in (job, together):
        kept = rows(spark.read.parquet(one.path("unparsed")), "line", F.array_join("lost_columns", ",").alias("lost"))
        assert kept == sorted(zip(bad, ["quantity", "order_timestamp", "unit_price_brl"]), key=repr)
        found = spark.read.parquet(one.path("contract_results")).where(F.col("processing_date") == F.lit(D5)).where("check_name = 'type' AND failing_records > 0")
        assert rows(found, "subject", "total_records", "failing_records", "conforms") == [(name, 10, 1, False) for name in ("order_timestamp", "quantity", "unit_price_brl")]
        missing = spark.read.parquet(one.path("contract_results")).where(F.col("processing_date") == F.lit(D5)).where("check_name = 'not_null'")
        assert dict(rows(missing, "subject", "failing_records"))["quantity"] == 2
    land(job, D5, line("O1", "A", 1, 100.0, "2025-05-05T10:00:00Z"))
    job.ingest(spark, D5, AS_OF)
    run_days(together, spark, [D5], AS_OF)
    for one in (job, together):
        assert not Files(spark).glob(one.path("unparsed") + "/processing_date=*")


@pytest.mark.parametrize("many", [False, True])
def test_rows_below_the_threshold_are_not_dropped(spark, job, many):
    """A rule that passes sends nothing to quarantine, and so nothing may be missing from silver."""
    job = replace(job, drop_quarantined=True)
    land(job, D5, *[line(f"O{n}", "A", -1 if n == 0 else 1, 100.0, "2025-05-05T10:00:00Z") for n in range(200)])
    assert (run_days(job, spark, [D5], AS_OF) == {D5: "PASS"}) if many else job.run(spark, D5, AS_OF) == "PASS"
    assert job.silver(spark).count() == 200 and not Files(spark).exists(job.path("quarantine"))


def test_results_go_when_the_rules_go(spark, job):
    land(job, D5, *BAD)
    with pytest.raises(DataQualityError):
        job.run(spark, D5, AS_OF)
    none = replace(job, rules=())
    assert none.run(spark, D5, AS_OF) == "PASS"
    assert run_days(none, spark, [D5], AS_OF) == {D5: "PASS"}


def test_scratch_is_gone_after_a_run(spark, job):
    rules = (Rule("UNIQUE", "uniqueness", column="order_id", error=0.0, on_warning=("quarantine",)),)
    land(job, D5, line("O1", "A", 1, 1.0, "2025-05-05T10:00:00Z"), line("O1", "A", 1, 1.0, "2025-05-05T10:00:00Z"))
    folder = shared_dir(spark) + "/lakestrata"
    before = set(Files(spark).folders(folder))
    replace(job, rules=rules, drop_quarantined=True).run(spark, D5, AS_OF)
    run_days(replace(job, rules=rules, drop_quarantined=True), spark, [D5], AS_OF)
    assert set(Files(spark).folders(folder)) == before


def test_late_rows_for_an_archived_date_add_to_gold(spark, job):
    keep = {"silver": Retention("1d", "archive_local")}
    land(job, D5, line("O1", "A", 2, 100.0, "2025-05-05T10:00:00Z"))
    land(job, D6, line("O2", "A", 1, 100.0, "2025-05-05T22:00:00Z"))
    job.run(spark, D5, AS_OF)
    assert retain_lake(job, spark, keep, D7) == {"silver": [D5]}
    job.run(spark, D6, AS_OF)
    assert gold(job, spark) == [("A", D5, 3, Decimal("60.00"))]
    assert retain_lake(job, spark, keep, date(2025, 5, 8)) == {"silver": [D6]}
    job.refresh_gold(spark, [D5])
    assert gold(job, spark) == [("A", D5, 3, Decimal("60.00"))]
    # a load day that is run again takes the place of its archived rows
    land(job, D5, line("O1", "A", 5, 100.0, "2025-05-05T10:00:00Z"))
    job.run(spark, D5, AS_OF)
    assert gold(job, spark) == [("A", D5, 6, Decimal("120.00"))]


def test_erasure_reaches_every_table_and_gold(spark, job):
    land(job, D5, line("O1", "A", 2, 100.0, "2025-05-05T10:00:00Z", email="gone@x"), line("O2", "A", 1, 100.0, "2025-05-05T11:00:00Z"))
    land(job, D6, line("O3", "B", 1, 100.0, "2025-05-06T11:00:00Z", email="gone@x"))
    for day in (D5, D6):
        job.run(spark, day, AS_OF)
    retain_lake(job, spark, {"silver": Retention("1d", "archive_local")}, D7)
    erase_from_lake(job, spark, spark.createDataFrame([("gone@x",)], "customer_email string"), "customer_email")
    for name in ("bronze", "silver", "silver_archive"):
        if list(Path(job.path(name)).rglob("part-*.parquet")):
            assert spark.read.parquet(job.path(name)).where("customer_email = 'gone@x'").count() == 0
    assert gold(job, spark) == [("A", D5, 1, Decimal("20.00"))]
    job.refresh_gold(spark)
    assert gold(job, spark) == [("A", D5, 1, Decimal("20.00"))]


@pytest.mark.parametrize("key", [None, "customer_email"])
@pytest.mark.parametrize("together", [False, True])
def test_erased_subjects_are_in_no_archive_and_do_not_come_back(spark, job, key, together):
    job = replace(job, subject_key=key, allow_partial_success=True)
    for day in (D5, D6):
        land(job, day, line(f"O1{day}", "A", 2, 100.0, f"{day}T10:00:00Z", email="gone@x"), line(f"O2{day}", "A", 1, 100.0, f"{day}T10:00:00Z", email="here@x"))
    load = (lambda: run_days(job, spark, [D5, D6], AS_OF)) if together else (lambda: [job.run(spark, day, AS_OF) for day in (D5, D6)])
    load()
    retain_lake(job, spark, {"bronze": Retention("4d", "archive_local")}, date(2025, 5, 10))
    assert spark.read.parquet(job.path("bronze_archive")).count() == 2
    changed = erase_from_lake(job, spark, spark.createDataFrame([("gone@x",), ("nobody@x",)], "customer_email string"), "customer_email")
    assert {table for table, parts in changed.items() if parts} == {"bronze", "bronze_archive", "silver"}
    for name in ("bronze", "bronze_archive", "silver"):
        assert [row.customer_email for row in spark.read.parquet(job.path(name)).select("customer_email").distinct().collect()] == ["here@x"]
    load()
    assert spark.read.parquet(job.path("bronze")).where("customer_email = 'gone@x'").count() == 0
    assert gold(job, spark) == [("A", D5, 1, Decimal("20.00")), ("A", D6, 1, Decimal("20.00"))]
    again = erase_from_lake(job, spark, spark.createDataFrame([("gone@x",)], "customer_email string"), "customer_email")
    assert not any(again.values())
    assert spark.read.parquet(job.path("erased")).count() == 2  # each noted once


def test_another_run_heals_a_load_day_that_died_half_way(spark, job, monkeypatch):
    land(job, D5, line("O1", "A", 2, 100.0, "2025-05-05T10:00:00Z"), line("O2", "A", 1, 100.0, "2025-05-04T10:00:00Z"))
    land(job, D6, line("O3", "B", 1, 100.0, "2025-05-06T10:00:00Z"))
    job.run(spark, D5, AS_OF)
    land(job, D5, line("O1", "A", 2, 100.0, "2025-05-05T10:00:00Z"))
    with monkeypatch.context() as broken:
        broken.setattr(DailyJob, "silver_rows", lambda *_: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            job.run(spark, D5, AS_OF)
    job.run(spark, D6, AS_OF)
    assert gold(job, spark) == [("A", D5, 2, Decimal("40.00")), ("B", D6, 1, Decimal("20.00"))]
    assert job.unsettled(spark) == []


def test_a_daily_run_lists_only_touched_folders(spark, job, monkeypatch):
    land(job, D5, line("O1", "A", 2, 100.0, "2025-05-05T10:00:00Z"))
    job.run(spark, D5, AS_OF)
    old = [date(2023, 1, 1) + timedelta(days=n) for n in range(400)]
    Files(spark).make_folders(f"{job.path('silver')}/load_date={d}/order_date={d}" for d in old)
    job.note_dates(spark, {d: {d} for d in old})
    listed = []
    real = Files.glob
    monkeypatch.setattr(Files, "glob", lambda self, pattern: listed.append(pattern) or real(self, pattern))
    land(job, D6, line("O2", "A", 1, 100.0, "2025-05-05T22:00:00Z"))
    job.run(spark, D6, AS_OF)
    assert len(listed) < 20 and not any("load_date=*" in pattern and "silver/" in pattern for pattern in listed)
    assert gold(job, spark) == [("A", D5, 3, Decimal("60.00"))]


@pytest.mark.parametrize("many", [False, True])
def test_files_with_other_headers_are_read_by_name(spark, job, many):
    land(job, D5, line("O1", "A", 2, 100.0, "2025-05-05T10:00:00Z"))
    land(job, D6, line("O2", "B", 1, 50.0, "2025-05-06T10:00:00Z"))
    folder = Path(job.landing.format(yyyy=2025, MM="05", dd="06"))
    (folder / "g.csv").write_text("status,order_id,quantity,product_id,unit_price_brl,order_timestamp,customer_email\ncompleted,O3,4,B,50.0,2025-05-06T11:00:00Z,a@x\n")
    if many:
        assert run_days(job, spark, [D5, D6], AS_OF) == {D5: "PASS", D6: "PASS"}
    else:
        assert [job.run(spark, day, AS_OF) for day in (D5, D6)] == ["PASS", "PASS"]
    assert gold(job, spark) == [("A", D5, 2, Decimal("40.00")), ("B", D6, 5, Decimal("50.00"))]


def test_days_without_files_are_left_alone_and_logged(spark, job):
    land(job, D5, line("O1", "A", 2, 100.0, "2025-05-05T10:00:00Z"))
    job.run(spark, D5, AS_OF)
    before = files_of(job)
    rmtree(Path(job.landing.format(yyyy=2025, MM="05", dd="05")))
    land(job, D6, line("O2", "A", 1, 100.0, "2025-05-06T10:00:00Z"))
    log = RunLog(sales.PIPELINE_ID, sales.DOMAIN, execution_id="many")
    assert run_days(job, spark, [D5, D6], AS_OF, log=log) == {D6: "PASS"}
    assert {name for name in files_of(job) if "load_date=2025-05-05" in name} == {name for name in before if "load_date=2025-05-05" in name}
    events = spark.read.parquet(job.path("run_log")).where("execution_id = 'many'")
    assert ("IngestBronze", "FAILED") in rows(events, "step_name", "status")
    assert events.where("status = 'FAILED'").first()["details"].count("2025-05-05") == 1


def files_of(job):
    return {str(p) for p in Path(job.path("silver")).rglob("part-*")}


def test_silver_of_many_days_is_one_file_per_date_also_behind_a_join(spark, job, settings):
    settings(spark__sql__autoBroadcastJoinThreshold="-1", spark__sql__adaptive__autoBroadcastJoinThreshold="-1", spark__sql__shuffle__partitions="16")
    rules = (Rule("UNIQUE", "uniqueness", column="order_id", error=0.0, on_warning=("quarantine",)),)
    days = [date(2025, 6, n) for n in range(1, 13)]
    for day in days:
        land(job, day, *[line(f"O{min(n, 30)}", "A", 1, 1.0, f"{day}T10:00:00Z") for n in range(40)])
    run_days(replace(job, rules=rules, drop_quarantined=True), spark, days, AS_OF)
    assert len(files_of(job)) <= len(days) + 2
    assert job.silver(spark).count() == 30 * len(days)


BAD = [line(f"O{n}", "A", -1 if n == 0 else 1, 100.0, "2025-05-05T10:00:00Z") for n in range(10)]


def test_bad_quality_stops_the_run_and_is_quarantined(spark, job):
    land(job, D5, *BAD)
    with pytest.raises(DataQualityError) as caught:
        job.run(spark, D5, AS_OF)
    assert {row["rule_id"]: row["status"] for row in caught.value.results}["DQ-SALES-001"] == "ERROR"
    assert rows(spark.read.parquet(job.path("quarantine")), "rule_id", "order_id") == [("DQ-SALES-001", "O0")]
    with pytest.raises(DataQualityError):
        job.build_silver(spark, D5)
    written, touched = job.build_silver(spark, D5, skip_check=True)
    assert (written, touched) == (10, [D5])  # quarantine copies: the bad row goes on
    # A corrected file clears the stored status.
    land(job, D5, *BAD[1:])
    assert job.run(spark, D5, AS_OF) == "PASS"
    assert gold(job, spark) == [("A", D5, 9, Decimal("180.00"))]


def test_partial_success_goes_on_with_or_without_the_quarantined_rows(spark, job):
    land(job, D5, *BAD)
    lenient = replace(job, allow_partial_success=True)
    lenient.ingest(spark, D5, AS_OF)
    assert lenient.check(spark, D5)[0]["status"] == "ERROR"
    with pytest.raises(DataQualityError):
        lenient.run(spark, D5, AS_OF)  # the gate still sees the ERROR
    assert lenient.run(spark, D5, AS_OF, skip_check=True) == "ERROR"
    assert job.silver(spark).count() == 10
    replace(lenient, drop_quarantined=True).build_silver(spark, D5, skip_check=True)
    assert job.silver(spark).count() == 9


def test_an_unchecked_day_is_let_through(spark, job):
    land(job, D5, *BAD)
    job.ingest(spark, D5, AS_OF)
    assert job.build_silver(spark, D5)[0] == 10


def test_dates_are_utc_whatever_the_session_says(spark, job, settings):
    settings(spark__sql__session__timeZone="America/Sao_Paulo")
    land(job, D5, line("O1", "A", 2, 100.0, "2025-05-05T00:30:00Z"), line("O2", "A", 1, 100.0, "2025-05-05T23:30:00Z"))
    job.run(spark, D5, AS_OF)
    assert gold(job, spark) == [("A", D5, 3, Decimal("60.00"))]


def test_rows_without_time_or_price(spark, job):
    land(job, D5, line("O1", "A", 2, "", "2025-05-05T10:00:00Z"), line("O2", "B", 1, 100.0, ""), *[line(f"P{n}", "C", 1, 5.0, "2025-05-05T10:00:00Z") for n in range(98)])
    job.run(spark, D5, AS_OF)
    assert job.silver(spark).count() == 100
    assert gold(job, spark) == [("A", D5, 2, None), ("B", None, 1, Decimal("20.00")), ("C", D5, 98, Decimal("98.00"))]


def test_run_log_of_good_and_bad_runs(spark, job):
    land(job, D5, line("O1", "A", 2, 100.0, "2025-05-05T10:00:00Z"))
    job.run(spark, D5, AS_OF, RunLog(sales.PIPELINE_ID, sales.DOMAIN, execution_id="good"))
    with pytest.raises(FileNotFoundError):
        job.run(spark, D6, AS_OF, RunLog(sales.PIPELINE_ID, sales.DOMAIN, execution_id="bad"))
    summary = {row["execution_id"]: row for row in run_summary(spark.read.parquet(job.path("run_log"))).collect()}
    assert (summary["good"]["last_status"], summary["good"]["failed_step"], summary["good"]["failed"]) == ("SUCCEEDED", None, 0)
    assert (summary["bad"]["last_status"], summary["bad"]["failed_step"], summary["bad"]["failed"]) == ("FAILED", "IngestBronze", 1)
    assert summary["good"]["events"] == 6 and summary["good"]["succeeded"] == 5


def test_unknown_log_status():
    with pytest.raises(ValueError):
        RunLog("p", "d").event("step", "DONE")


def test_run_summary_breaks_ties(spark):
    at = datetime(2025, 5, 5)
    data = [("e", s, st, at) for s, st in (("b", "FAILED"), ("a", "FAILED"), ("c", "INFO"), ("c", "SUCCEEDED"))]
    df = spark.createDataFrame(data * 3, "execution_id string, step_name string, status string, timestamp_utc timestamp")
    row = run_summary(df.repartition(5)).first()
    assert (row["failed_step"], row["last_status"], row["events"], row["failed"], row["duration_seconds"]) == ("a", "SUCCEEDED", 12, 6, 0)


# Plans


def test_silver_and_gold_push_down_and_prune(spark, job):
    land(job, D5, line("O1", "A", 2, 100.0, "2025-05-05T10:00:00Z"))
    job.run(spark, D5, AS_OF)
    silver = chain(job.bronze(spark, D5), steps_for("silver", sales.STEPS))
    daily = chain(silver, steps_for("gold", sales.STEPS))
    text = plan(daily)
    assert "EqualTo(status,completed)" in text
    schema = next(part for part in text.splitlines() if part.startswith("ReadSchema"))
    assert "customer_email" not in schema and "order_id" not in schema and "_ingestion_timestamp" not in schema
    assert text.count("Exchange") == 2 and "HashAggregate" in text and "SortAggregate" not in text  # tree and details


def test_only_the_day_is_listed(spark, job, tmp_path):
    for day in (D5, D6):
        land(job, day, line("O1", "A", 2, 100.0, f"{day}T10:00:00Z"))
        job.ingest(spark, day, AS_OF)
    assert all("day=06" in name for name in job.bronze(spark, D6).inputFiles())
    assert slice_path("/t", day_parts(D6)) == "/t/year=2025/month=05/day=06"


# Many days at once


def many_days(job):
    job_rules = (*job.rules, Rule("UNIQUE", "uniqueness", column="order_id", warning=100.0, error=10.0, on_warning=("quarantine",)))
    land(job, D5, line("O1", "A", 2, 100.0, "2025-05-05T10:00:00Z"), line("O1", "B", 1, 5.0, "2025-05-05T11:00:00Z"), *[line(f"G{n}", "G", 1, 5.0, "2025-05-05T12:00:00Z") for n in range(9)])
    land(job, D6, *BAD)
    land(job, D7, line("O1", "A", 1, 100.0, "2025-05-05T22:00:00Z"), line("O3", "A", 4, "", "2025-05-07T10:00:00Z"), *[line(f"H{n}", "H", 1, 5.0, "2025-05-07T12:00:00Z") for n in range(98)])
    land(job, date(2025, 5, 9))
    return replace(job, rules=job_rules)


def contents(spark, job):
    found = {}
    for name in ("bronze", "silver", "gold", "dq_results", "quarantine"):
        if Path(job.path(name)).exists():
            df = spark.read.parquet(job.path(name))
            found[name] = rows(df, *(F.col(c).cast("string") for c in sorted(df.columns)))
    return found


@pytest.mark.parametrize("drop", [False, True])
def test_many_days_equal_the_days_one_by_one(spark, job, drop):
    job = replace(many_days(job), drop_quarantined=drop)
    together = replace(job, root=job.root + "-together")
    days = [D5, D6, D7, date(2025, 5, 8), date(2025, 5, 9)]
    alone = {}
    for day in days:
        try:
            alone[day] = job.run(spark, day, AS_OF)
        except DataQualityError:
            alone[day] = "ERROR"
        except FileNotFoundError:
            pass
    del alone[date(2025, 5, 9)]  # no rows: nothing to check
    for _ in range(2):  # a rerun changes nothing
        assert run_days(together, spark, days, AS_OF) == alone == {D5: "WARNING", D6: "ERROR", D7: "WARNING"}
        assert contents(spark, together) == contents(spark, job)
    assert any("UNIQUE" in row for row in contents(spark, job)["quarantine"])
    if drop:
        return
    # A corrected file for the bad day, and one that takes back late rows.
    land(job, D6, *BAD[1:])
    land(job, D7, line("O3", "A", 4, 10.0, "2025-05-07T10:00:00Z"))
    for day in (D6, D7):
        job.run(spark, day, AS_OF)
    run_days(together, spark, [D6, D7], AS_OF)
    assert contents(spark, together) == contents(spark, job)


def test_many_days_with_a_rule_that_fails_on_one(spark, job):
    job = replace(job, rules=[Rule("cast", "validity", condition="CAST(customer_email AS INT) > 0")])
    land(job, D5, line("O1", "A", 2, 100.0, "2025-05-05T10:00:00Z", email="1"))
    land(job, D6, line("O1", "A", 2, 100.0, "2025-05-05T10:00:00Z", email="x"))
    assert run_days(job, spark, [D5, D6], AS_OF) == {D5: "PASS", D6: "ERROR"}


def test_no_landing_files_at_all(spark, job):
    with pytest.raises(FileNotFoundError):
        run_days(job, spark, [D5, D6], AS_OF)


@pytest.mark.parametrize(
    "template, path, day",
    [
        ("/x/{yyyy}/{MM}/{dd}/", "file:/2020/01/01/x/2025/05/07/f.csv", D7),
        ("s3a://b/day={dd}/m={MM}/y={yyyy}", "s3a://b/day=07/m=05/y=2025/part.csv", D7),
        ("/x/sales_{yyyy}{MM}{dd}.csv", "file:/x/sales_20250507.csv", D7),
    ],
)
def test_day_of_a_file(spark, template, path, day):
    assert spark.createDataFrame([(path,)], "p string").select(landing_day(template, F.col("p"))).first()[0] == day


def test_a_path_without_a_day_is_an_error(spark):
    df = spark.createDataFrame([("file:/x/other/f.csv",)], "p string")
    with pytest.raises(Exception, match="no day in the path"):
        df.select(landing_day("/x/{yyyy}/{MM}/{dd}/", F.col("p"))).collect()


def test_a_template_without_a_day_is_refused(spark):
    with pytest.raises(ValueError):
        landing_day("/x/{yyyy}/{MM}/", F.lit("p"))
