"""Numeric expressions with dataframe semantics: no error on zero divisors, null stays null."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INF = float("inf")


def _by_zero(a: Column) -> Column:
    return F.when(a > 0, F.lit(INF)).when(a < 0, F.lit(-INF)).when(a == 0, F.lit(float("nan")))


def divide(a: Column, b: Column) -> Column:
    a, b = a.cast("double"), b.cast("double")
    return F.when(b == 0, _by_zero(a)).otherwise(F.try_divide(a, b))


def floor_divide(a: Column, b: Column) -> Column:
    a, b = a.cast("double"), b.cast("double")
    return F.when(b == 0, _by_zero(a)).otherwise(F.floor(F.try_divide(a, b)).cast("double"))


def modulo(a: Column, b: Column) -> Column:
    """Remainder with the sign of the divisor."""
    a, b = a.cast("double"), b.cast("double")
    return F.when(b == 0, F.when(a.isNotNull(), F.lit(float("nan")))).otherwise(
        F.try_mod(F.try_mod(a, b) + b, b))


def power(a: Column, b: Column) -> Column:
    return F.pow(a.cast("double"), b.cast("double"))


def natural_log(c: Column) -> Column:
    c = c.cast("double")
    return F.when(c > 0, F.ln(c)).when(c == 0, F.lit(-INF)).when(c < 0, F.lit(float("nan")))


def natural_log1p(c: Column) -> Column:
    c = c.cast("double")
    return F.when(c > -1, F.log1p(c)).when(c == -1, F.lit(-INF)).when(c < -1, F.lit(float("nan")))


def square_root(c: Column) -> Column:
    c = c.cast("double")
    return F.when(c >= 0, F.sqrt(c)).when(c < 0, F.lit(float("nan")))


def half_even(c: Column, decimals: int = 0) -> Column:
    return F.bround(c, decimals)


def clip(c: Column, lower=None, upper=None) -> Column:
    out = c
    if lower is not None:
        out = F.when(out < lower, F.lit(lower)).otherwise(out)
    if upper is not None:
        out = F.when(out > upper, F.lit(upper)).otherwise(out)
    return out


def nan_to_null(c: Column) -> Column:
    return F.nanvl(c, F.lit(None).cast("double"))


def percent(part: Column, whole: Column, decimals: int = 2) -> Column:
    """100*part/whole rounded; 0 when there is nothing to divide by."""
    return F.coalesce(F.round(F.try_divide(F.lit(100.0) * part, whole.cast("double")), decimals), F.lit(0.0))
