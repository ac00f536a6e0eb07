from datetime import date, datetime
from decimal import Decimal

import pytest
from support import plan, rows
from pyspark.sql import functions as F

from lakestrata.operators import contract as contracts
from lakestrata.operators.contract import CalculatedField, Contract, ContractColumn, CustomRule
from lakestrata.plans.sales import CONTRACT

DOCUMENT = {
    "schema_specification": {
        "structural": {
            "columns": [
                {"name": "id", "data_type": "string", "constraints": ["not_null", "primary_key"], "description": "Id"},
                {"name": "n", "data_type": "integer", "constraints": ["not_null"]},
                {"name": "total", "data_type": "long"},
                {"name": "untyped"},
                {"data_type": "string"},
            ]
        },
        "semantic": {"calculated_fields": [{"name": "total", "formula": "n * 2", "precision": "bigint"}]},
    },
    "quality_metrics": {
        "completeness": {"threshold": 75.0},
        "freshness": {"max_latency_minutes": 1440},
        "custom_rules": [{"name": "positive", "expression": "n > 0", "error_severity": "critical"}],
    },
}


@pytest.fixture
def contract():
    with pytest.warns(UserWarning, match="without name or type"):
        return Contract.from_dict(DOCUMENT, {"silver": ("id", "total", "not_there"), "raw": ("id", "n")})


def found(df):
    return {(r["check_name"], r["subject"]): (r["failing_records"], r["total_records"], r["conforms"]) for r in df.collect()}


def test_contract_from_a_document(contract):
    assert contract.columns == (
        ContractColumn("id", "string", not_null=True, primary_key=True, comment="Id"),
        ContractColumn("n", "integer", not_null=True),
        ContractColumn("total", "long"),
    )
    assert contract.calculated == (CalculatedField("total", "n * 2", "bigint"),)
    assert contract.custom_rules == (CustomRule("positive", "n > 0"),)
    assert (contract.completeness, contract.max_latency_minutes) == (75.0, 1440)


def test_schema_of_a_layer(spark, contract):
    with pytest.warns(UserWarning, match="not_there"):
        schema = contract.schema("silver")
    assert [(f.name, f.dataType.simpleString(), f.nullable) for f in schema] == [("id", "string", True), ("total", "bigint", True)]
    assert schema["id"].metadata == {"comment": "Id"}
    assert contract.raw_schema("raw").simpleString() == "struct<id:string,n:string>"


def test_layer_projection_casts_and_comments(spark, contract):
    df = spark.createDataFrame([("12", "a", 1)], "total string, id string, extra int")
    with pytest.warns(UserWarning):
        projected = contracts.project(df, contract, "silver")
    assert projected.dtypes == [("id", "string"), ("total", "bigint")]
    assert projected.schema["id"].metadata["comment"] == "Id"
    assert rows(projected) == [("a", 12)]


def test_conformance_counts_each_kind_once(spark, contract):
    df = spark.createDataFrame([("a", "1"), (None, "x"), ("c", None), ("d", "-4")], "id string, n string")
    checks = found(contracts.conformance(df, contract, ["type", "not_null", "completeness"]))
    assert checks == {
        ("type", "id"): (0, 4, True),
        ("type", "n"): (1, 4, False),
        ("not_null", "id"): (1, 4, False),
        ("not_null", "n"): (1, 4, False),
        ("completeness", "id"): (1, 4, True),
        ("completeness", "n"): (1, 4, True),
    }
    typed = spark.createDataFrame([("a", 1), ("b", None), ("c", -1)], "id string, n int")
    assert found(contracts.conformance(typed, contract, ["custom"])) == {("custom", "positive"): (1, 3, False)}


def test_conformance_of_no_rows(spark, contract):
    empty = spark.createDataFrame([], "id string, n int")
    assert all(row["conforms"] and row["success_percentage"] == 100.0 for row in contracts.conformance(empty, contract).collect())


def test_conformance_reads_once(spark, contract, tmp_path):
    spark.createDataFrame([("a", 1, "w")], "id string, n int, wide string").write.parquet(str(tmp_path / "t"))
    text = plan(contracts.conformance(spark.read.parquet(str(tmp_path / "t")), contract))
    assert text.count("Scan parquet") == 2 and "wide" not in text


def test_unknown_check_is_refused(spark, contract):
    with pytest.raises(ValueError):
        contracts.conformance(spark.range(1), contract, ["spelling"])


def test_primary_key_violations(spark, contract):
    df = spark.createDataFrame([("a",), ("a",), ("b",), (None,), (None,)], "id string")
    assert rows(contracts.primary_key_violations(df, contract)) == [("a", 2)]


def test_calculated_field_compares_null_safely(spark):
    df = spark.createDataFrame(
        [(2, Decimal("1.50"), Decimal("3.00")), (2, Decimal("1.50"), Decimal("3.01")), (2, None, None), (2, None, Decimal("1.00")), (2, Decimal("1.00"), None)],
        "quantity int, unit_price_usd decimal(18,2), total_value_usd decimal(18,2)",
    )
    wrong = contracts.calculated_violations(df, CONTRACT)
    assert rows(wrong, "total_value_usd", "expected") == [
        (Decimal("1.00"), None),
        (Decimal("3.01"), Decimal("3.00")),
        (None, Decimal("2.00")),
    ]


@pytest.mark.parametrize("as_of, minutes, fresh", [("2025-05-06 10:00:00", 1440, True), ("2025-05-06 10:00:01", 1440, False), ("2025-05-05 10:00:59", 0, True)])
def test_freshness(spark, as_of, minutes, fresh):
    df = spark.createDataFrame([("2025-05-05 10:00:00",), (None,), ("2025-05-01 00:00:00",)], "ts string")
    row = contracts.freshness(df, "ts", as_of, 1440).first()
    assert (row["latency_minutes"], row["fresh"]) == (minutes, fresh)


def test_no_rows_are_not_fresh(spark):
    row = contracts.freshness(spark.createDataFrame([], "ts timestamp"), "ts", "2025-05-05 00:00:00", 1440).first()
    assert (row["latest"], row["fresh"]) == (None, False)


def test_load_gaps(spark):
    days = ["2025-05-01 23:00:00", "2025-05-02 01:00:00", "2025-05-02 02:00:00", "2025-05-05 00:00:00", None]
    df = spark.createDataFrame([(day,) for day in days], "ts string")
    assert rows(contracts.load_gaps(df, "ts", 24)) == [(datetime(2025, 5, 5), datetime(2025, 5, 2), 72)]
    assert rows(contracts.load_gaps(df, "ts", 72)) == []
    loads = spark.range(16).select((F.lit("2025-05-01").cast("timestamp") + F.make_dt_interval(hours=F.col("id") * 6)).alias("ts"))
    assert rows(contracts.load_gaps(loads, "ts", 6)) == []
    assert rows(contracts.load_gaps(loads.where("hour(ts) <> 6"), "ts", 6), "gap_hours") == [(12,)] * 4


def test_load_gaps_within_each_value(spark):
    df = spark.createDataFrame([("a", "2025-05-01"), ("b", "2025-05-02"), ("a", "2025-05-04"), (None, "2025-05-04")], "k string, ts string")
    assert rows(contracts.load_gaps(df, "ts", 24, by=["k"]), "k", "gap_hours") == [("a", 72)]


def test_a_contract_without_a_key_is_refused(spark):
    with pytest.raises(ValueError, match="primary key"):
        contracts.primary_key_violations(spark.range(1), contracts.Contract(columns=()))
