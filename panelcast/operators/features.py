"""Window features over the long panel: lags, moving averages, volatility.

All expressions share ``Window.partitionBy(key).orderBy(month)`` and are built
in ONE select, so Catalyst plans a single shuffle + sort and one Window
operator instead of one pass per derived column. Lags are row-based (a
missing month is skipped over, as with a positional shift).

A partition holds one entity's monthly rows, bounded by the calendar length,
whatever the size of the raw data behind the bars.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelcast.functions.exact import exact_mean, exact_stddev
from panelcast.functions.numeric import nan_to_null


def panel_window(key: str | Sequence[str] = "ticker", order: str = "month"):
    keys = [key] if isinstance(key, str) else list(key)
    return Window.partitionBy(*keys).orderBy(order)


def lag_exprs(cols: Sequence[str], lags: Sequence[int], w) -> list[Column]:
    """``{col}_lag{k}`` for each column and lag."""
    return [F.lag(c, k).over(w).alias(f"{c}_lag{k}") for c in cols for k in lags]


def lead_expr(col: str, horizon: int, w, name: str | None = None) -> Column:
    """Value ``horizon`` rows ahead (the forecast target)."""
    return F.lead(col, horizon).over(w).alias(name or f"{col}_t{horizon}")


def moving_average_expr(col: str, window: int, w, exact_scale: int | None = 4) -> Column:
    """Mean of the last ``window`` rows, NULL until the window is full."""
    frame = w.rowsBetween(-(window - 1), Window.currentRow)
    n = F.count(nan_to_null(col)).over(frame)  # a NaN leaves the window short
    mean = exact_mean(col, exact_scale, over=frame) if exact_scale is not None \
        else F.avg(col).over(frame)
    return F.when(n == window, mean).alias(f"{col}_ma{window}")


def volatility_expr(col: str, window: int, w, exact_scale: int | None = 4) -> Column:
    """Sample std of the level over the last ``window`` rows (full only)."""
    frame = w.rowsBetween(-(window - 1), Window.currentRow)
    n = F.count(nan_to_null(col)).over(frame)
    sd = exact_stddev(col, 1, exact_scale, over=frame) if exact_scale is not None \
        else F.stddev_samp(col).over(frame)
    return F.when(n == window, sd).alias(f"{col}_volatility")


def feature_columns(target: str, lag_cols: Sequence[str], lags: Sequence[int],
                    mas: Sequence[int], volatility: bool, lag_target: bool) -> list[str]:
    cols = [f"{target}_ma{m}" for m in mas]
    if volatility:
        cols.append(f"{target}_volatility")
    lagged = ([target] if lag_target else []) + list(lag_cols)
    cols += [f"{c}_lag{k}" for c in lagged for k in lags]
    return cols


def build_features(panel: DataFrame, target: str = "close",
                   lag_cols: Sequence[str] = ("volume",), lags: Sequence[int] = (1, 3, 6),
                   mas: Sequence[int] = (3, 12), volatility: bool = True,
                   lag_target: bool = False, warmup: str = "drop",
                   key: str = "ticker", order: str = "month",
                   exact_scale: int | None = 4) -> DataFrame:
    """Feature table.

    ``warmup='drop'`` removes rows with any NULL feature (current pipeline);
    ``'backfill'`` fills the leading gap of each lag / MA with its first
    available value (golden tables) and keeps every row.
    """
    w = panel_window(key, order)
    lagged = ([target] if lag_target else []) + list(lag_cols)
    exprs = [F.col(c) for c in panel.columns]
    exprs += [moving_average_expr(target, m, w, exact_scale) for m in mas]
    if volatility:
        exprs.append(volatility_expr(target, 3, w, exact_scale))
    exprs += lag_exprs(lagged, lags, w)
    out = panel.select(*exprs)
    derived = feature_columns(target, lag_cols, lags, mas, volatility, lag_target)
    if warmup == "drop":
        return out.dropna(how="any")
    if warmup == "backfill":
        fwd = w.rowsBetween(Window.currentRow, Window.unboundedFollowing)
        return out.withColumns({c: F.first(c, ignorenulls=True).over(fwd) for c in derived})
    raise ValueError(f"warmup must be 'drop' or 'backfill', got {warmup!r}")


def lagged_comparison(panel: DataFrame, value: str, others: Sequence[str], lag: int = 3,
                      key: str = "ticker", order: str = "month") -> DataFrame:
    """A value next to other series lagged by ``lag`` rows."""
    w = panel_window(key, order)
    return panel.select(key, order, value,
                        *[F.lag(c, lag).over(w).alias(f"{c}_lag{lag}") for c in others])
