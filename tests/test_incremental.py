from dataclasses import replace
from datetime import date
from decimal import Decimal
from pathlib import Path

import pytest
from support import rows
from test_daily import AS_OF, D5, D6, gold, job, land, line  # noqa: F401

from lakestrata.plans import incremental
from lakestrata.plans.backfill import run_days
from lakestrata.plans.incremental import load_new_days

D4 = date(2025, 5, 4)


def test_nothing_there(spark, job):  # noqa: F811
    assert load_new_days(job, spark, AS_OF) == {}


def test_new_days_and_late_files_equal_run_days(spark, job):  # noqa: F811
    land(job, D5, line("O1", "A", 2, 100.0, "2025-05-05T10:00:00Z"))
    land(job, D4, line("O0", "A", 1, 100.0, "2025-05-04T10:00:00Z"))
    assert load_new_days(job, spark, AS_OF) == {D4: "PASS", D5: "PASS"}
    assert load_new_days(job, spark, AS_OF) == {}
    land(job, D6, line("O2", "A", 1, 100.0, "2025-05-05T22:00:00Z"))
    folder = Path(next(Path(job.landing.split("{")[0]).rglob("05/05")))
    late = folder / "late.csv"
    late.write_text(next(folder.glob("*.csv")).read_text().replace("O1", "O9"))
    assert load_new_days(job, spark, AS_OF, files_per_batch=1) == {D5: "PASS", D6: "PASS"}
    together = replace(job, root=job.root + "-together")
    run_days(together, spark, [D4, D5, D6], AS_OF)
    assert gold(job, spark) == gold(together, spark) == [("A", D4, 1, Decimal("20.00")), ("A", D5, 5, Decimal("100.00"))]
    assert rows(job.silver(spark)) == rows(together.silver(spark))


def test_a_dead_batch_is_repeated_without_rows_twice(spark, job, monkeypatch):  # noqa: F811
    land(job, D5, line("O1", "A", 2, 100.0, "2025-05-05T10:00:00Z"))

    def dies(*given, **more):
        run_days(*given, **more)
        raise RuntimeError("lost")

    with monkeypatch.context() as patched:
        patched.setattr(incremental, "run_days", dies)
        with pytest.raises(Exception, match="lost"):
            load_new_days(job, spark, AS_OF)
    land(job, D6, line("O2", "A", 1, 100.0, "2025-05-05T22:00:00Z"))
    assert load_new_days(job, spark, AS_OF) == {D5: "PASS", D6: "PASS"}
    assert gold(job, spark) == [("A", D5, 3, Decimal("60.00"))]


def test_only_a_header_mismatch_is_read_again(spark, job, monkeypatch):  # noqa: F811
    from lakestrata.plans.daily import DailyJob

    land(job, D5, line("O1", "A", 2, 100.0, "2025-05-05T10:00:00Z"))

    def full(*given, **more):
        raise OSError("disk full")

    monkeypatch.setattr(DailyJob, "_write_bronze", full)
    monkeypatch.setattr("lakestrata.plans.daily.read_mixed", lambda *given: pytest.fail("read again"))
    with pytest.raises(OSError, match="disk full"):
        job.run(spark, D5, AS_OF)
