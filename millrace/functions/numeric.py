"""Scalar functions with dataframe-library semantics on Spark columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clean(c: Column) -> Column:
    """NaN as null, so that aggregates skip it."""
    return F.nanvl(c.cast("double"), F.lit(None).cast("double"))


def divide(a: Column, b: Column) -> Column:
    """Quotient; of a zero divisor infinite with the dividend's sign, or not a number for 0 / 0."""
    inf = lambda sign: F.lit(sign * float("inf"))
    return F.when(b == 0, F.when(a > 0, inf(1)).when(a < 0, inf(-1)).when(a == 0, F.lit(float("nan")))).otherwise(F.try_divide(a, b).cast("double"))


def floor_div(a: Column, b: Column) -> Column:
    """Quotient rounded down; null for a zero divisor."""
    return F.floor(F.try_divide(a, b))


def floor_mod(a: Column, b: Column) -> Column:
    """Remainder with the divisor's sign; null for a zero divisor."""
    return a - floor_div(a, b) * b


def half_even(c: Column, decimals: int = 0) -> Column:
    return F.bround(c, decimals)


def truthy(c: Column, kind: str) -> Column:
    """What a null predicate of ``filter`` lets through: nonzero numbers, true, and values that are not empty."""
    if kind == "boolean":
        return F.coalesce(c, F.lit(False))
    if kind in ("string", "binary"):
        return F.coalesce(F.length(c) > 0, F.lit(False))
    if kind.startswith(("array", "map")):
        return F.coalesce(F.size(c) > 0, F.lit(False))
    return F.coalesce(c != 0, F.lit(False))


def seconds(interval: str | float) -> float:
    """Seconds of '500ms', '2h', '1 day' or a number."""
    if isinstance(interval, (int, float)):
        return float(interval)
    import pandas as pd

    return pd.Timedelta(interval).total_seconds()


def variance(n: Column, total: Column, squares: Column, ddof: int) -> Column:
    """Variance from partial sums, null where there are no more than ``ddof`` values."""
    mean = F.try_divide(total, n)
    return F.when(n > ddof, (squares - n * mean * mean) / (n - ddof))
