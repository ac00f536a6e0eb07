"""Column expressions shared by the operators."""

from __future__ import annotations

from datetime import datetime, timezone
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

MONEY = "decimal(18,2)"


def named(name: str) -> Column:
    """A column by its literal name, also when the name holds dots or back-quotes."""
    return F.col(quoted(name))


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def instant(moment: datetime | str) -> Column:
    """A timestamp literal. A datetime without zone is UTC, whatever the zone of driver or session."""
    if isinstance(moment, datetime):
        moment = (moment if moment.tzinfo else moment.replace(tzinfo=timezone.utc)).isoformat()
    return F.lit(moment).cast("timestamp")


def number(value: int | float | Decimal | str) -> Column:
    """A numeric literal typed as SQL text would be: 5 is an int, 5.0 a decimal."""
    return F.lit(value if isinstance(value, int) else Decimal(str(value)))


def converted(amount: Column, rate: int | float | Decimal | str) -> Column:
    """Amount divided by a rate, in cents; NULL where the division is undefined."""
    return F.try_divide(amount, number(rate)).try_cast(MONEY)


def total_value(quantity: Column, unit_price: Column) -> Column:
    """Quantity times the already rounded unit price, in cents."""
    return F.try_multiply(quantity, unit_price).try_cast(MONEY)


def hash_masked(value: Column) -> Column:
    """SHA-256 in hex; NULL stays NULL."""
    return F.sha2(value.cast("string"), 256)


def any_of(conditions: list[Column]) -> Column:
    result = conditions[0]
    for condition in conditions[1:]:
        result = result | condition
    return result
