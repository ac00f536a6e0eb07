from datetime import date, datetime
from decimal import Decimal

import pytest
from support import rows

from lakestrata.operators.steps import (
    AggSpec,
    LayerStep,
    aggregate,
    chain,
    convert_currency,
    line_total,
    sql_step,
    steps_for,
    template_step,
    where_equals,
    with_date,
    with_ingestion_timestamp,
)
from lakestrata.plans.documents import step_from_template, steps_from_definition

# Bodies of templates that exist, to show that they run as they are; so are the rows of the four cases.
FILTER = "SELECT * FROM {input_view_or_df} WHERE `{status_column}` = '{desired_status}'"
CONVERT = "SELECT *, CAST( `{source_column}` / {conversion_rate} AS DECIMAL(18,2) ) AS `{target_column}` FROM {input_view_or_df}"


# The four golden cases


def golden_filter(spark):
    return spark.createDataFrame([(1, "completed"), (2, "pending"), (3, "completed")], "id int, status string")


def test_filter(spark):
    kept = where_equals("status", "completed")(golden_filter(spark))
    assert rows(kept) == [(1, "completed"), (3, "completed")]


def test_conversion(spark):
    df = spark.createDataFrame([(100.0,), (50.0,)], "price_brl double")
    assert rows(convert_currency("price_brl", "price_usd", 5.0)(df)) == [
        (100.0, Decimal("20.00")),
        (50.0, Decimal("10.00")),
    ]


def test_total_value(spark):
    df = spark.createDataFrame([(2, Decimal("20.00")), (10, Decimal("3.00"))], "quantity int, unit_price_usd decimal(18,2)")
    assert rows(line_total("quantity", "unit_price_usd", "total_value_usd")(df)) == [
        (10, Decimal("3.00"), Decimal("30.00")),
        (2, Decimal("20.00"), Decimal("40.00")),
    ]


def daily_input(spark):
    return spark.createDataFrame(
        [
            ("PROD_A", "2025-05-05T10:00:00Z", 2, Decimal("40.00")),
            ("PROD_B", "2025-05-05T10:15:00Z", 1, Decimal("24.10")),
            ("PROD_A", "2025-05-05T16:20:00Z", 3, Decimal("60.00")),
        ],
        "product_id string, order_timestamp string, quantity int, total_value_usd decimal(18,2)",
    )


def test_daily_aggregate(spark):
    step = aggregate(
        ["product_id", "order_date"],
        [AggSpec("quantity", "sum", "total_quantity"), AggSpec("total_value_usd", "SUM", "total_aggregated_value_usd")],
        date_from="order_timestamp",
    )
    result = step(daily_input(spark))
    assert result.columns == ["product_id", "order_date", "total_quantity", "total_aggregated_value_usd"]
    assert rows(result) == [
        ("PROD_A", date(2025, 5, 5), 5, Decimal("100.00")),
        ("PROD_B", date(2025, 5, 5), 1, Decimal("24.10")),
    ]


# Edges


def test_filter_drops_null_and_keeps_case(spark):
    df = spark.createDataFrame([(None,), ("Completed",), ("completed",)], "status string")
    assert rows(where_equals("status", "completed")(df)) == [("completed",)]


def test_column_names_with_dots_and_quotes(spark):
    df = spark.createDataFrame([("x", 1), ("y", 2)], "`a.b` string, `c``d` int")
    assert rows(where_equals("a.b", "x")(df)) == [("x", 1)]
    assert rows(aggregate(["a.b"], [AggSpec("c`d", "max", "m")])(df)) == [("x", 1), ("y", 2)]


def test_conversion_by_zero_and_overflow_is_null(spark):
    df = spark.createDataFrame([(Decimal("1.00"),), (None,)], "p decimal(18,2)")
    assert rows(convert_currency("p", "q", 0.0)(df), ) == [(Decimal("1.00"), None), (None, None)]
    wide = spark.createDataFrame([(1e30,)], "p double")
    assert convert_currency("p", "q", 5.0)(wide).first()["q"] is None


def test_price_is_rounded_before_it_is_multiplied(spark):
    df = spark.createDataFrame([(3, Decimal("0.07"))], "quantity int, brl decimal(18,2)")
    priced = chain(df, [convert_currency("brl", "usd", 5.0), line_total("quantity", "usd", "total")])
    # 0.07 / 5 = 0.014 -> 0.01, times 3 = 0.03; rounding once at the end would give 0.04
    assert priced.first()["total"] == Decimal("0.03")


def test_half_cents_round_up(spark):
    df = spark.createDataFrame([(Decimal("0.01"),), (Decimal("-0.01"),)], "p decimal(18,2)")
    assert rows(convert_currency("p", "q", 2.0)(df)) == [
        (Decimal("-0.01"), Decimal("-0.01")),
        (Decimal("0.01"), Decimal("0.01")),
    ]


def test_aggregates_ignore_null(spark):
    df = spark.createDataFrame([("a", 1), ("a", None), ("b", None)], "k string, v int")
    specs = [AggSpec("v", f, f) for f in ("sum", "avg", "count", "min", "max")]
    assert rows(aggregate(["k"], specs)(df)) == [("a", 1, 1.0, 1, 1, 1), ("b", None, None, 0, None, None)]


def test_unknown_aggregate_is_refused():
    with pytest.raises(ValueError, match="median"):
        AggSpec("v", "median", "m")


def test_existing_date_column_is_replaced(spark):
    df = spark.createDataFrame([("2025-05-05 23:59:59", "old")], "ts string, order_date string")
    assert with_date("ts")(df).first()["order_date"] == date(2025, 5, 5)


def test_ingestion_timestamp_is_the_given_one(spark):
    df = with_ingestion_timestamp("2025-05-05 01:02:03")(spark.range(2))
    assert {str(row["_ingestion_timestamp"]) for row in df.collect()} == {"2025-05-05 01:02:03"}


def test_sql_step_binds_values(spark):
    step = sql_step("SELECT id FROM {input} WHERE IDENTIFIER(:c) = :v", c="status", v="x' OR '1'='1")
    assert rows(step(golden_filter(spark))) == []


def test_empty_sql_is_not_implemented():
    with pytest.raises(NotImplementedError):
        sql_step(" ")
    with pytest.raises(NotImplementedError):
        step_from_template({"logic": {}}, {})


def test_template_gives_the_same_as_the_step(spark):
    step = template_step(FILTER, {"status_column": "status", "desired_status": "completed"})
    assert rows(step(golden_filter(spark))) == [(1, "completed"), (3, "completed")]


def test_template_parameters_cannot_change_the_query(spark):
    df = spark.createDataFrame([(1, "it's"), (2, "x")], "id int, `we{i}rd``name` string")
    parameters = {"status_column": "we{i}rd`name", "desired_status": "it's"}
    assert rows(template_step(FILTER, parameters)(df)) == [(1, "it's")]
    hostile = {"status_column": "id", "desired_status": "' OR '1'='1"}
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        template_step(FILTER, hostile)(df).collect()


def test_placeholder_inside_a_literal_is_refused():
    with pytest.raises(ValueError, match="inside a text literal"):
        template_step("SELECT 'x-{v}' AS t FROM {input_view_or_df}", {"v": 1})


def test_moment_without_zone_is_utc(spark, settings):
    settings(spark__sql__session__timeZone="America/Sao_Paulo")
    df = with_ingestion_timestamp(datetime(2025, 5, 5, 1, 2, 3))(spark.range(1))
    assert df.selectExpr("unix_seconds(_ingestion_timestamp)").first()[0] == 1746406923


def test_template_needs_its_parameters():
    with pytest.raises(KeyError, match="desired_status"):
        template_step(FILTER, {"status_column": "status"})


def test_template_number_is_a_decimal_literal(spark):
    df = spark.createDataFrame([(Decimal("1.00"),)], "p decimal(18,2)")
    step = template_step(CONVERT, {"source_column": "p", "conversion_rate": 3.0, "target_column": "q"})
    assert step(df).first()["q"] == Decimal("0.33")


def test_steps_of_a_layer():
    steps = [LayerStep("a"), LayerStep("b", "gold"), LayerStep("c", "silver")]
    assert steps_for("silver", steps) == ["a", "c"]
    assert steps_for("gold", steps) == ["b"]
    with pytest.raises(ValueError):
        steps_for("gold", steps[:1])


def test_steps_from_a_definition(spark):
    definition = {
        "processing": {
            "transformations": [
                {"template_id": "keep", "parameters": {"status_column": "status", "desired_status": "completed"}},
                {
                    "template_id": "count",
                    "parameters": {
                        "group_by_columns": ["order_date"],
                        "aggregation_specs": [{"source_column": "id", "function": "count", "target_column": "n"}],
                        "timestamp_column_for_date": "ts",
                    },
                    "target_layer_step": "gold",
                },
            ]
        }
    }
    templates = {"keep": {"logic": {"sql": FILTER}}, "count": {"logic": {"sql_template": "SELECT {group_by_clause}, {aggregation_clause} FROM (SELECT *, to_date(`{timestamp_column_for_date}`) AS order_date FROM {input_view_or_df}) WHERE id < 100 GROUP BY {group_by_clause}"}}}
    steps = steps_from_definition(definition, templates)
    df = spark.createDataFrame([(1, "completed", "2025-05-05 10:00:00"), (2, "x", "2025-05-05 11:00:00")], "id int, status string, ts string")
    silver = chain(df, steps_for("silver", steps))
    assert rows(chain(silver, steps_for("gold", steps))) == [(date(2025, 5, 5), 1)]
