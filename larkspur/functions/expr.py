"""Expressions whose meaning differs between engines, written once."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F


def col(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def rnd(x: str | Column, digits: int = 7) -> Column:
    return F.round(col(x), digits)


def dow0(ts: str | Column) -> Column:
    """Day of week, Sunday 0."""
    return F.dayofweek(ts) - 1


def month_diff(late: str | Column, early: str | Column) -> Column:
    """Month borders between two dates."""
    return 12 * (F.year(late) - F.year(early)) + F.month(late) - F.month(early)


def safe_div(a: str | Column, b: str | Column) -> Column:
    """a / b; null where b is 0 or null."""
    return col(a).cast("double") / F.nullif(col(b).cast("double"), F.lit(0.0))


def micros(ts: str | Column) -> Column:
    """Microseconds since 1970, of timestamps with or without zone."""
    return F.unix_micros(col(ts).cast("timestamp"))


def skew_corrected(x: str | Column) -> Column:
    """Bias-corrected skewness (aggregate)."""
    n = F.count(x).cast("double")
    return F.skewness(x) * F.sqrt(n * (n - 1)) / (n - 2)


def kurtosis_corrected(x: str | Column) -> Column:
    """Bias-corrected excess kurtosis (aggregate)."""
    n = F.count(x).cast("double")
    return (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.kurtosis(x) + 6)


def percentile(x: str | Column, p: float) -> Column:
    """Exact percentile with linear interpolation (aggregate), for groups that are small by their meaning: it holds all
    distinct values of a group. Else see ``operators.quantiles``."""
    return F.percentile(col(x), F.lit(p))


def percent_of_rank(partition: str, order: str) -> Column:
    """Average rank over size of group: rank(pct=True)."""
    by = Window.partitionBy(partition)
    ties = F.count(F.lit(1)).over(Window.partitionBy(partition, order))
    return (F.rank().over(by.orderBy(order)) + (ties - 1) / 2) / F.count(F.lit(1)).over(by)


def title(x: str | Column) -> Column:
    return F.initcap(col(x))


def hash_bucket(x: str | Column, n: int) -> Column:
    return F.pmod(F.xxhash64(col(x)), F.lit(n))


def clip(x: str | Column, low, high) -> Column:
    """Between low and high; null stays null (least and greatest alone would pass nulls over)."""
    return F.when(col(x).isNotNull(), F.least(F.greatest(col(x), F.lit(low) if not isinstance(low, Column) else low), F.lit(high) if not isinstance(high, Column) else high))


def cyclic(x: Column, period: float) -> tuple[Column, Column]:
    angle = x * F.lit(2 * 3.141592653589793 / period)
    return F.sin(angle), F.cos(angle)
