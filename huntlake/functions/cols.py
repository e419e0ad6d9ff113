"""Small column helpers used everywhere: quoting, null-safe flags, safe ratios."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def c(name: str) -> Column:
    """Column by exact name; names with spaces, dots or '/' are back-tick quoted."""
    return F.col("`" + name.replace("`", "``") + "`")


def as_col(x: str | Column) -> Column:
    return c(x) if isinstance(x, str) else x


def flag(expr: Column) -> Column:
    """Boolean flag with two-valued logic: a NULL comparison counts as false."""
    return F.coalesce(expr, F.lit(False))


def nan_to_null(x: str | Column) -> Column:
    """NaN is an ordinary missing value for this library."""
    col = as_col(x)
    return F.when(F.isnan(col), F.lit(None)).otherwise(col)


def zero_safe_ratio(num: str | Column, den: str | Column) -> Column:
    """num / den with a zero or missing denominator giving 0.

    Missing numerators also give 0, as the ratio is filled with 0 afterwards.
    """
    n, d = as_col(num), as_col(den)
    return F.coalesce(F.try_divide(n, F.nullif(d, F.lit(0))), F.lit(0.0)).cast("double")


def safe_div(num: Column, den: Column) -> Column:
    """num / den, NULL when the denominator is 0 (no ANSI error)."""
    return F.try_divide(num, F.nullif(den, F.lit(0)))


def zero_if_null_div(num: Column, den: Column) -> Column:
    """Metric convention: 0 on a zero denominator."""
    return F.coalesce(safe_div(num.cast("double"), den.cast("double")), F.lit(0.0))
