"""Arithmetic that gives the same digits on every run and every partitioning.

Sums of doubles depend on the order in which tasks finish. Money and ratios are
therefore summed and divided as decimals and only the rounded result is turned
into a double.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Pay periods per year.
PAY_PERIODS = {"Hour": 2080, "Week": 52, "Bi-Weekly": 26, "Month": 12, "Year": 1}


def ratio(numerator: Column, denominator: Column, digits: int) -> Column:
    """``numerator / denominator`` rounded half up; NULL for a zero denominator."""
    top = numerator.cast("decimal(20,2)")
    bottom = F.nullif(denominator.cast("decimal(18,0)"), F.lit(0))
    return F.round(top / bottom, digits).cast("double")


def percent(part: Column, whole: Column, digits: int = 2) -> Column:
    return ratio(part * 100, whole, digits)


def div0(numerator: Column, denominator: Column) -> Column:
    """Division that yields 0 when the denominator is 0."""
    return F.when(denominator == 0, F.lit(0.0)).otherwise(numerator / denominator)


def exact_avg(amount: Column, digits: int = 2) -> Column:
    """Average of a money column, rounded half up. An aggregate expression."""
    return F.round(
        F.sum(amount.cast("decimal(18,2)")) / F.nullif(F.count(amount).cast("decimal(18,0)"), F.lit(0)), digits
    ).cast("double")


def positive(amount: Column) -> Column:
    return F.when(amount > 0, amount)


def annualize_wage(amount: Column, unit: Column, compat: bool = False) -> Column:
    """PRJ6: yearly pay from an amount and its pay unit.

    ``compat`` scales hourly pay only and takes every other unit as yearly.
    """
    periods = {"Hour": PAY_PERIODS["Hour"]} if compat else PAY_PERIODS
    factor = F.lit(1)
    for name, per_year in periods.items():
        factor = F.when(unit == name, F.lit(per_year)).otherwise(factor)
    return amount * factor


def salary_mid(low: Column, high: Column) -> Column:
    """PRJ8: the salary measure, halfway between the bounds."""
    return (low + high) / 2
