"""Column helpers with the engine's null rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-10


def flag(condition: Column) -> Column:
    """Unknown counts as false."""
    return F.coalesce(condition, F.lit(False))


def finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))


def changed(log_return: Column) -> Column:
    return F.abs(log_return) > EPS


def as_int(condition: Column) -> Column:
    return condition.cast("int")


def days(first: Column, last: Column) -> Column:
    """Dates from first to last, null (no rows when exploded) if last is before first."""
    return F.when(first <= last, F.sequence(first, last, F.expr("interval 1 day")))


def rounded(x: Column, digits: int = 6) -> Column:
    return F.round(x, digits) + F.lit(0.0)  # no negative zero
