"""Canonicalisation: coercion, slicing, keep-first, gap filling, missing counts.

Row order matters in the source semantics (keep-first, forward fill), so
every operator here takes an explicit ordering with a full tie-break; there
is no reliance on input order, which Spark does not have.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelcast.functions.numeric import month_start, to_double


def _cols(names) -> list[str]:
    return [names] if isinstance(names, str) else list(names)


def coerce_numeric(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Text -> DOUBLE, bad text ('.', '', 'n/a') and NaN -> NULL."""
    return df.withColumns({c: to_double(c) for c in cols})


def add_month(df: DataFrame, date_col: str, out: str = "month") -> DataFrame:
    """Month bucket (first day of month)."""
    return df.withColumn(out, month_start(date_col))


def range_slice(df: DataFrame, col: str, start=None, end=None) -> DataFrame:
    """Inclusive [start, end] slice. On a scan column this is pushed down."""
    if start is not None:
        df = df.where(F.col(col) >= F.lit(start).cast("date"))
    if end is not None:
        df = df.where(F.col(col) <= F.lit(end).cast("date"))
    return df


def drop_missing(df: DataFrame, subset: Sequence[str] | None = None) -> DataFrame:
    """Drop rows with any NULL (NaN must already be NULL)."""
    return df.dropna(how="any", subset=list(subset) if subset else None)


def first_per_period(df: DataFrame, keys: Sequence[str], period: Column | str,
                     order: Sequence[str] | Column, values: Sequence[str],
                     period_name: str = "month") -> DataFrame:
    """Keep the first row of each (keys, period) by a total order.

    ``order`` is one orderable column such as ``order_key(ts, seq)`` (one
    ``min_by`` per value column, all on the hash-aggregate path) or a list of
    columns compared as a struct. ``min_by`` is a partial aggregate: no group
    is ever buffered whole, unlike a row_number window over the group.
    """
    p = F.col(period) if isinstance(period, str) else period
    if isinstance(order, Column):
        firsts = [F.min_by(v, order).alias(v) for v in values]
        return df.groupBy(*[F.col(k) for k in keys], p.alias(period_name)).agg(*firsts)
    key = F.struct(*[F.col(o) for o in order])
    first = F.min_by(F.struct(*[F.col(v) for v in values]), key).alias("_first")
    out = df.groupBy(*[F.col(k) for k in keys], p.alias(period_name)).agg(first)
    return out.select(*keys, period_name, *[F.col(f"_first.{v}").alias(v) for v in values])


def duplicate_periods(df: DataFrame, keys: Sequence[str], period: Column | str,
                      period_name: str = "month") -> DataFrame:
    """(keys, period, n_rows) for periods holding more than one row."""
    p = F.col(period) if isinstance(period, str) else period
    return (df.groupBy(*keys, p.alias(period_name))
              .agg(F.count(F.lit(1)).alias("n_rows"))
              .where(F.col("n_rows") > 1))


def month_grid(df: DataFrame, keys: Sequence[str], month: str = "month",
               end: Column | None = None) -> DataFrame:
    """Every month from each key's first month to its last (or ``end``).

    Generated per key with ``sequence``; no keys x calendar cross product.
    """
    hi = F.max(month) if end is None else F.greatest(F.max(month), end)
    span = df.groupBy(*keys).agg(F.min(month).alias("_lo"), hi.alias("_hi"))
    return span.select(*keys, F.explode(
        F.sequence("_lo", "_hi", F.expr("INTERVAL 1 MONTH"))).alias(month))


def reindex_months(df: DataFrame, keys: Sequence[str], month: str = "month",
                   end: Column | None = None) -> DataFrame:
    """The data on its own monthly grid (gaps become NULL rows).

    Each row is followed by the months up to the key's next row, so the data is
    read once and shuffled once.
    """
    w = Window.partitionBy(*keys).orderBy(month)
    last = F.col(month) if end is None else F.greatest(F.col(month), end)
    upto = F.greatest(F.col(month), F.coalesce(F.add_months(F.lead(month).over(w), -1), last))
    values = [c for c in df.columns if c not in (*keys, month)]
    spread = df.withColumn("_to", upto).select(*keys, F.col(month).alias("_own"), *values, F.explode(
        F.sequence(F.col(month), F.col("_to"), F.expr("INTERVAL 1 MONTH"))).alias(month))
    return spread.select(*keys, month, *[F.when(F.col(month) == F.col("_own"), F.col(f"`{c}`")).alias(c) for c in values])


def forward_fill(df: DataFrame, keys: Sequence[str], order: Sequence[str] | str,
                 cols: Sequence[str]) -> DataFrame:
    """D3: last non-NULL value at or before the row, within the key."""
    w = (Window.partitionBy(*keys).orderBy(*_cols(order))
               .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return df.withColumns({c: F.last(c, ignorenulls=True).over(w) for c in cols})


def back_fill(df: DataFrame, keys: Sequence[str], order: Sequence[str] | str,
              cols: Sequence[str]) -> DataFrame:
    """First non-NULL value at or after the row, within the key."""
    w = (Window.partitionBy(*keys).orderBy(*_cols(order))
               .rowsBetween(Window.currentRow, Window.unboundedFollowing))
    return df.withColumns({c: F.first(c, ignorenulls=True).over(w) for c in cols})


def null_counts(df: DataFrame, keys: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Per key, the number of rows and of NULLs in each column."""
    aggs = [F.count(F.lit(1)).alias("n_rows")]
    aggs += [F.count_if(F.col(c).isNull()).alias(f"{c}_missing") for c in cols]
    return df.groupBy(*keys).agg(*aggs)


def split_run_name(df: DataFrame, col: str, sep: str = "_",
                   left: str = "ticker", right: str = "model") -> DataFrame:
    """Split 'TICKER_MODEL' on the first separator; others are skipped."""
    parts = F.split(F.col(col), sep, 2)
    return (df.withColumn("_parts", parts)
              .where(F.size("_parts") == 2)
              .withColumn(left, F.col("_parts")[0])
              .withColumn(right, F.col("_parts")[1])
              .drop("_parts"))


class MissingColumnsError(ValueError):
    """Raised before planning when required columns are absent."""

    def __init__(self, missing: Sequence[str]):
        super().__init__(f"missing columns: {list(missing)}")
        self.missing = list(missing)


def require_columns(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Fail fast (typed error) when target / feature columns are absent."""
    have = set(df.columns)
    missing = [c for c in cols if c not in have]
    if missing:
        raise MissingColumnsError(missing)
    return df


def columns_except(df: DataFrame, target: str, extra: Sequence[str] = ()) -> list[str]:
    """P10: every column but the target, its ``{target}_t*`` leads and ``extra``."""
    return [c for c in df.columns
            if c != target and not c.startswith(f"{target}_t") and c not in set(extra)]


def preview(df: DataFrame, n: int = 5, order: Sequence[str] = ("ticker", "month")) -> DataFrame:
    """First ``n`` rows in time order (a bounded top-n, not a collect)."""
    return df.orderBy(*[c for c in order if c in df.columns]).limit(n)
