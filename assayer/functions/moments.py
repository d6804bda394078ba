"""Aggregate expressions for distribution shape and linear association."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sample_skewness(c: Column) -> Column:
    """Bias-corrected skewness; null for constant columns or fewer than three values."""
    n = F.count(c).cast("double")
    g1 = F.when(F.stddev_pop(c) > 0, F.skewness(c))
    return F.when(n >= 3, g1 * F.try_divide(F.sqrt(n * (n - 1)), n - 2))


def sample_kurtosis(c: Column) -> Column:
    """Bias-corrected excess kurtosis; for exactly three values the population value."""
    n = F.count(c).cast("double")
    g2 = F.when(F.stddev_pop(c) > 0, F.kurtosis(c))
    corrected = F.try_divide(n - 1, (n - 2) * (n - 3)) * ((n + 1) * g2 + 6)
    return F.when(n > 3, corrected).when(n == 3, g2)


def pearson(a: Column, b: Column) -> Column:
    """Correlation over rows where both are present; null where undefined instead of an ANSI error."""
    x = F.when(b.isNotNull(), a.cast("double"))
    y = F.when(a.isNotNull(), b.cast("double"))
    return F.try_divide(F.covar_samp(x, y), F.nullif(F.stddev_samp(x) * F.stddev_samp(y), F.lit(0.0)))
