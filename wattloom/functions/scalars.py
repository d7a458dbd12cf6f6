"""Scalar expressions used by many operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_even(x: Column, digits: int = 1) -> Column:
    """Rounds half to even, as array libraries do."""
    return F.bround(x, digits)


def transformed(x: Column, transform: str = "none") -> Column:
    """The value transform ahead of binning: none, or log1p of what is above zero to 4 digits."""
    return F.bround(F.log1p(F.greatest(x, F.lit(0.0))), 4) if transform == "log1p" else x


def restored(x: Column, transform: str = "none") -> Column:
    return F.expm1(x) if transform == "log1p" else x


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is null or zero."""
    return F.try_divide(a, b)


def safe_corr(x: str, y: str, least: int = 10) -> Column:
    """Pearson correlation aggregate over pairs without nulls; null under `least` pairs or if a side is constant."""
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    a, b = F.when(both, F.col(x)), F.when(both, F.col(y))
    r = F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))
    return F.when(F.count_if(both) >= least, r)


def adjusted_skew(x: Column) -> Column:
    """Bias-corrected skewness aggregate, null under 3 values."""
    n = F.count(x).cast("double")
    return F.when(n > 2, F.skewness(x) * F.sqrt(n * (n - 1)) / (n - 2))


def adjusted_kurtosis(x: Column) -> Column:
    """Bias-corrected excess kurtosis aggregate, null under 4 values."""
    n = F.count(x).cast("double")
    return F.when(n > 3, ((n + 1) * F.kurtosis(x) + 6) * (n - 1) / ((n - 2) * (n - 3)))


def zscore(x: str, mean: str, sd: str) -> Column:
    return F.coalesce(F.try_divide(F.col(x) - F.col(mean), F.col(sd)), F.col(x) - F.col(mean))
