"""Small scalar helpers kept JVM-side (no Python UDFs)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def safe_div(a: Column, b: Column) -> Column:
    """a / b, null when b is 0 or null (ANSI mode would raise on plain '/')."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def sigmoid(z: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def round_d(c: Column, digits: int = 9) -> Column:
    """Round a metric so summation order cannot change its printed value."""
    return F.round(c.cast("double"), digits)
