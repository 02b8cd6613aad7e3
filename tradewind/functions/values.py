"""Typed values: safe casts, defaults, exact money."""

from __future__ import annotations

from decimal import Decimal
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from tradewind.schemas import AMOUNT, MONEY, RATE


def to_type(c: Column, type_name: str) -> Column:
    """Cast that yields null for text that does not parse."""
    return c.try_cast(type_name)


def typed_lit(value: Any, type_name: str) -> Column:
    """Literal with a declared type; None becomes a null of that type."""
    return F.lit(value).cast(type_name)


def or_default(c: Column, value: Any, type_name: str) -> Column:
    """Null replaced by a literal of the same type, so that decimals stay decimals."""
    return F.coalesce(c, typed_lit(value, type_name))


def money(c: Column) -> Column:
    """Price as decimal(15,2), 0.00 when missing or malformed."""
    return or_default(to_type(c, MONEY), Decimal("0.00"), MONEY)


def rate(c: Column) -> Column:
    """Rating as decimal(5,2), 0.00 when missing or malformed."""
    return or_default(to_type(c, RATE), Decimal("0.00"), RATE)


def percent_rate(c: Column) -> Column:
    """A percentage number as a fraction in decimal(5,2), 0.00 when missing."""
    fraction = to_type(c, "decimal(20,6)") / F.lit(100)
    return or_default(to_type(fraction, RATE), Decimal("0.00"), RATE)


def count_or(c: Column, default: int, type_name: str = "bigint") -> Column:
    """Whole number with a default for missing or malformed input."""
    return or_default(to_type(c, type_name), default, type_name)


def amount(units: Column, price: Column) -> Column:
    """Sales amount as an exact decimal product."""
    return (units.cast("decimal(20,0)") * price.cast(MONEY)).cast(AMOUNT)


def adjusted_amount(
    new_units: Column, new_amount: Column, prev_units: Column, prev_amount: Column, has_prev: Column
) -> Column:
    """Cumulative amount carried forward at the present unit price.

    Without an earlier snapshot the new amount stands. A missing result, such as one from
    zero new units, becomes 0.00.
    """
    grown = new_units.cast("decimal(20,0)") - prev_units.cast("decimal(20,0)")
    unit_price = F.try_divide(new_amount.cast("decimal(30,2)"), new_units.cast("decimal(20,0)"))
    carried = prev_amount + grown.cast("decimal(20,0)") * unit_price.cast("decimal(20,6)")
    chosen = F.when(has_prev, carried.cast(AMOUNT)).otherwise(new_amount.cast(AMOUNT))
    return or_default(chosen, Decimal("0.00"), AMOUNT)


def to_long(c: Column) -> Column:
    """Decimal to whole number, cut towards zero."""
    return c.cast("bigint")
