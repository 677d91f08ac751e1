"""Whole-number arithmetic that stays whole."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def div(a: Column | int, b: Column | int) -> Column:
    """Integral division of non-negative numbers: exact where a double would have rounded."""
    a, b = (x if isinstance(x, Column) else F.lit(x) for x in (a, b))
    return F.call_function("div", a.cast("long"), b.cast("long"))


def ceil_div(a: Column | int, b: int) -> Column:
    a = a if isinstance(a, Column) else F.lit(a)
    return div(a + (b - 1), b)


def ceil_div_by(a: Column, b: Column) -> Column:
    """The same by a column that is above zero (null where it is zero)."""
    return F.call_function("div", (a + b - 1).cast("long"), F.nullif(b.cast("long"), F.lit(0).cast("long")))
