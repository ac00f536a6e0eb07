"""The daily sales domain: contract, steps, rules and policies."""

from __future__ import annotations

from lakestrata.operators.contract import CalculatedField, Contract, ContractColumn, CustomRule
from lakestrata.operators.governance import Governance, Retention, RolePolicy
from lakestrata.operators.quality import Rule
from lakestrata.operators.steps import AggSpec, LayerStep, Rollup, convert_currency, line_total, where_equals

PIPELINE_ID = "sales_daily_br_v1"
DOMAIN = "sales"
VERSION = "1.0.0"

# The columns of each layer.
LANDING_COLUMNS = (
    "order_id",
    "product_id",
    "quantity",
    "unit_price_brl",
    "order_timestamp",
    "customer_email",
    "status",
)
LAYER_COLUMNS = {
    "landing": LANDING_COLUMNS,
    "bronze": (*LANDING_COLUMNS, "_ingestion_timestamp"),
    "silver": (*LANDING_COLUMNS, "unit_price_usd", "total_value_usd"),
    "gold": ("product_id", "order_date", "total_quantity", "total_aggregated_value_usd"),
}

# Column types and constraints of the contract.
CONTRACT = Contract(
    columns=(
        ContractColumn("order_id", "string", not_null=True, primary_key=True, comment="Order id"),
        ContractColumn("product_id", "string", not_null=True, comment="Product id"),
        ContractColumn("quantity", "integer", not_null=True, comment="Quantity sold"),
        ContractColumn("unit_price_brl", "decimal(18,2)", comment="Unit price in BRL"),
        ContractColumn("order_timestamp", "timestamp", not_null=True, comment="Time of the order, UTC"),
        ContractColumn("customer_email", "string", comment="Customer email, personal data"),
        ContractColumn("status", "string", not_null=True, comment="Order status"),
        ContractColumn("unit_price_usd", "decimal(18,2)", comment="Unit price in USD"),
        ContractColumn("total_value_usd", "decimal(18,2)", comment="Total value in USD"),
        ContractColumn("order_date", "date", not_null=True, comment="Date of the order, UTC"),
        ContractColumn("total_quantity", "long", not_null=True, comment="Quantity per product and date"),
        ContractColumn("total_aggregated_value_usd", "decimal(20,2)", not_null=True, comment="Value in USD per product and date"),
    ),
    layers=LAYER_COLUMNS,
    calculated=(CalculatedField("total_value_usd", "quantity * unit_price_usd", "decimal(18,2)"),),
    custom_rules=(
        CustomRule("positive_quantity", "quantity > 0"),
        CustomRule("valid_price", "unit_price_brl IS NOT NULL AND unit_price_brl >= 0"),
    ),
    completeness=99.5,
    max_latency_minutes=1440,
)
EXPECTED_INTERVAL_HOURS = 24

# The exchange rate and the status that counts as a sale.
CONVERSION_RATE = 5.0
COMPLETED = "completed"

FILTER_COMPLETED = where_equals("status", COMPLETED)
PRICE_IN_USD = convert_currency("unit_price_brl", "unit_price_usd", CONVERSION_RATE)
TOTAL_IN_USD = line_total("quantity", "unit_price_usd", "total_value_usd")
DAILY_ROLLUP = Rollup(
    ["product_id", "order_date"],
    [
        AggSpec("quantity", "sum", "total_quantity", "bigint"),
        AggSpec("total_value_usd", "sum", "total_aggregated_value_usd", "decimal(20,2)"),
    ],
    date_from="order_timestamp",
)
DAILY_BY_PRODUCT = DAILY_ROLLUP.step()

STEPS = (
    LayerStep(FILTER_COMPLETED),
    LayerStep(PRICE_IN_USD),
    LayerStep(TOTAL_IN_USD),
    LayerStep(DAILY_BY_PRODUCT, "gold"),
)

# Rule ids, conditions, thresholds and actions.
RULES = (
    Rule(
        "DQ-SALES-001",
        "validity",
        column="quantity",
        condition="quantity > 0",
        warning=99.0,
        error=95.0,
        on_warning=("log", "notify_slack"),
        on_error=("log", "notify_slack", "quarantine"),
    ),
    Rule(
        "DQ-SALES-002",
        "completeness",
        column="unit_price_brl",
        condition="unit_price_brl IS NOT NULL",
        warning=99.5,
        error=98.0,
        on_warning=("log", "notify_slack"),
        on_error=("log", "notify_slack", "quarantine"),
    ),
    Rule(
        "DQ-SALES-003",
        "completeness",
        column="customer_email",
        condition="customer_email IS NOT NULL AND customer_email != ''",
        warning=95.0,
        error=90.0,
        on_warning=("log",),
        on_error=("log", "notify_slack"),
    ),
)
ALLOW_PARTIAL_SUCCESS = False

# Roles, masks and retention.
GOVERNANCE = Governance(
    roles=(
        RolePolicy("data_analyst_sales", layers=("gold",), masks=(("customer_email", "hash"),)),
        RolePolicy("data_engineer_sales", permissions=("read", "write", "alter")),
    ),
    retention={
        "bronze": Retention("30d", "delete"),
        "silver": Retention("1y", "archive_local"),
        "gold": Retention("5y", "archive_local"),
    },
)
