"""Exact, order-independent moments for fixed-point inputs.

Prices, volumes and money amounts carry a fixed number of decimals. Summing
them as DECIMAL is exact, so a mean, variance or covariance built from those
sums does not depend on how rows were partitioned or in which order partial
aggregates were merged: a 1000-executor run gives bit-for-bit the same result
as a single task. Only the final combination step is done in floating point.

Every helper takes an optional window spec ``over``; without it the
expression is a grouped aggregate (partial aggregation applies).
"""

from __future__ import annotations

from pyspark.sql import Column, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def _agg(expr: Column, over: WindowSpec | None) -> Column:
    return expr.over(over) if over is not None else expr


def fixed(col, scale: int = 4, precision: int = 18) -> Column:
    """Cast to DECIMAL(precision, scale); the value keeps its decimal digits.

    NaN counts as missing (it has no decimal form), like a NULL.
    """
    c = _c(col)
    return F.when(~F.isnan(c), c).cast(DecimalType(precision, scale))


def exact_sum(col, scale: int = 10, over: WindowSpec | None = None) -> Column:
    """Sum with ``scale`` decimals and 18 digits before them; a value beyond
    raises an error, none is dropped."""
    return _agg(F.sum(fixed(col, scale, 18 + scale)), over)


def exact_mean(col, scale: int = 10, over: WindowSpec | None = None) -> Column:
    """sum(decimal) -> double, divided by the count of non-null values."""
    n = _agg(F.count(F.nullif(_c(col).cast("double"), F.lit(float("nan")))), over)
    return F.try_divide(exact_sum(col, scale, over).cast("double"), n.cast("double"))


def exact_comoment(x, y, scale: int = 4, over: WindowSpec | None = None) -> Column:
    """n * sum(x*y) - sum(x) * sum(y), exact (= n^2 * population covariance).

    For values of ``scale`` decimals and 14 digits before them, such as prices
    rounded to four; products of wider decimals would not stay exact.

    Rows where either side is NULL are skipped (pairwise complete).
    """
    both = _c(x).isNotNull() & _c(y).isNotNull()
    dx = F.when(both, fixed(x, scale))
    dy = F.when(both, fixed(y, scale))
    n = _agg(F.count(dx), over)
    return n * _agg(F.sum(dx * dy), over) - _agg(F.sum(dx), over) * _agg(F.sum(dy), over)


def exact_variance(col, ddof: int = 1, scale: int = 4,
                   over: WindowSpec | None = None) -> Column:
    """Variance with ``ddof`` (1 = sample, 0 = population) from exact sums."""
    n = _agg(F.count(fixed(col, scale)), over)
    num = exact_comoment(col, col, scale, over).cast("double")
    return F.try_divide(num, (n * (n - ddof)).cast("double"))


def exact_stddev(col, ddof: int = 1, scale: int = 4,
                 over: WindowSpec | None = None) -> Column:
    return F.sqrt(exact_variance(col, ddof, scale, over))


def pair_count(x, y, over: WindowSpec | None = None) -> Column:
    return _agg(F.count(F.when(_c(x).isNotNull() & _c(y).isNotNull(), F.lit(1))), over)
