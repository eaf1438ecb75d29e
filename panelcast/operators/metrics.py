"""Scores and reports over backtest tables (all grouped aggregates)."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from panelcast.functions.numeric import round_half_even
from panelcast.operators.forecast import r2_expr
from panelcast.operators.matrices import key_matrices

RUN_KEYS = ("ticker", "model", "horizon")


def regression_metrics(bt: DataFrame, keys: Sequence[str] = RUN_KEYS,
                       actual: str = "actual", predicted: str = "predicted",
                       digits: int | None = 4) -> DataFrame:
    """RMSE, MAE, R2 per run, rounded half-even to ``digits``."""
    err = F.col(actual) - F.col(predicted)
    out = bt.groupBy(*keys).agg(
        F.sqrt(F.avg(err * err)).alias("rmse"),
        F.avg(F.abs(err)).alias("mae"),
        r2_expr(actual, predicted).alias("r2"),
        F.count(F.lit(1)).alias("n"))
    if digits is not None:
        out = out.withColumns({c: round_half_even(c, digits) for c in ("rmse", "mae", "r2")})
    return out


def bias_directional(bt: DataFrame, keys: Sequence[str] = RUN_KEYS, date: str = "date",
                     actual: str = "actual", predicted: str = "predicted",
                     digits: int | None = 4) -> DataFrame:
    """mean(pred - actual) and the share of rows whose predicted move
    from the previous actual has the sign of the actual move.

    The first row of each run has no previous actual and is not counted.
    """
    w = Window.partitionBy(*keys).orderBy(date)
    prev = F.lag(actual, 1).over(w)
    moved = bt.select(*keys, actual, predicted,
                      (F.signum(F.col(predicted) - prev) == F.signum(F.col(actual) - prev))
                      .cast("double").alias("_hit"))
    out = moved.groupBy(*keys).agg(
        F.avg(F.col(predicted) - F.col(actual)).alias("bias"),
        F.avg("_hit").alias("directional_accuracy"))
    if digits is not None:
        out = out.withColumns({c: round_half_even(c, digits)
                               for c in ("bias", "directional_accuracy")})
    return out


def signal_counts(bt: DataFrame, keys: Sequence[str] = ("ticker", "model")) -> DataFrame:
    """Number of backtest rows per signal."""
    return bt.groupBy(*keys, "signal").agg(F.count(F.lit(1)).alias("n"))


def markers(bt: DataFrame, which: Sequence[str] = ("Buy", "Sell")) -> DataFrame:
    """The Buy / Sell points (date, actual and predicted price) of each run."""
    return bt.where(F.col("signal").isin(list(which))).select(
        "ticker", "model", "horizon", "date", "actual", "predicted", "signal")


def top_k(df: DataFrame, k: int, by: str, tie: Sequence[str], descending: bool = True) -> DataFrame:
    """Global top-k (per-partition top-k, then a merge of k rows each)."""
    first = F.col(by).desc_nulls_last() if descending else F.col(by).asc_nulls_last()
    return df.orderBy(first, *[F.col(t).asc() for t in tie]).limit(k)


def top_k_per_group(df: DataFrame, k: int, group: Sequence[str], by: str,
                    tie: Sequence[str], rank: str = "rank") -> DataFrame:
    """K best rows of each group by ``by`` desc, ties broken by ``tie``."""
    w = Window.partitionBy(*group).orderBy(F.col(by).desc_nulls_last(), *tie)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= k)


def _moments(x: np.ndarray) -> np.ndarray:
    """Pairwise-complete moments of a block of rows, stacked: counts, means of
    the row's and the column's variable, and their centred products (xx, yy, xy)."""
    ok = ~np.isnan(x)
    m = ok.astype(float)
    shift = np.divide(np.where(ok, x, 0).sum(0), m.sum(0), out=np.zeros(x.shape[1]), where=m.sum(0) > 0)
    z = np.where(ok, x - shift, 0.0)
    n = m.T @ m
    some = np.maximum(n, 1)
    mx, my = z.T @ m / some, m.T @ z / some
    sq = z * z
    return np.stack([n, mx + shift[:, None], my + shift[None, :], sq.T @ m - n * mx * mx,
                     m.T @ sq - n * my * my, z.T @ z - n * mx * my])


def _merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Moments of two blocks together."""
    n = a[0] + b[0]
    share = a[0] * b[0] / np.maximum(n, 1)
    dx, dy = b[1] - a[1], b[2] - a[2]
    w = b[0] / np.maximum(n, 1)
    return np.stack([n, a[1] + dx * w, a[2] + dy * w, a[3] + b[3] + share * dx * dx,
                     a[4] + b[4] + share * dy * dy, a[5] + b[5] + share * dx * dy])


def correlation_matrix(df: DataFrame, cols: Sequence[str], key: str | None = "ticker",
                       digits: int | None = 4) -> DataFrame:
    """Pearson r for every ordered column pair (pairwise complete), long.

    Each task turns its rows into one matrix of centred moments per key, and a
    key's matrices are merged (``matrices.key_matrices``). Constant columns
    have no r.
    """
    cols = list(cols)
    k = len(cols)
    keys = [key] if key else []

    def finish(batches):
        for pdf in batches:
            for at, raw in zip(pdf[key] if key else [""] * len(pdf), pdf["m"]):
                total = np.frombuffer(raw).reshape(6, k, k)
                scale = np.sqrt(np.maximum(total[3], 0) * np.maximum(total[4], 0))
                # a variance that is rounding only is none
                tiny = (total[3] <= 1e-14 * total[0] * total[1] ** 2) | (total[4] <= 1e-14 * total[0] * total[2] ** 2)
                r = np.divide(total[5], scale, out=np.full((k, k), np.nan), where=(scale > 0) & ~tiny & (total[0] > 1))
                yield pd.DataFrame({**({key: at} if key else {}), "_a": np.repeat(np.arange(k), k),
                                    "_b": np.tile(np.arange(k), k), "_r": np.clip(r.ravel(), -1, 1)})

    schema = StructType([*[df.schema[c] for c in keys], StructField("_a", IntegerType()),
                         StructField("_b", IntegerType()), StructField("_r", DoubleType())])
    out = key_matrices(df, keys, cols, _moments, _merged).mapInPandas(finish, schema)
    names = F.array(*[F.lit(c) for c in cols])
    out = out.select(*keys, F.get(names, F.col("_a")).alias("col_a"), F.get(names, F.col("_b")).alias("col_b"),
                     F.when(~F.isnan("_r"), F.col("_r")).alias("r"))
    return out if digits is None else out.withColumn("r", round_half_even("r", digits))


def latest_per_run(results: DataFrame, keys: Sequence[str] = ("ticker", "model"),
                   order: str = "run_seq") -> DataFrame:
    """One result per (ticker, model); the last run wins on a collision."""
    others = [c for c in results.columns if c not in keys]
    last = F.max_by(F.struct(*[F.col(c) for c in others]), F.col(order)).alias("_r")
    return results.groupBy(*keys).agg(last).select(*keys, "_r.*")


def sort_table(df: DataFrame, by: Sequence[str], ascending: Sequence[bool] | None = None) -> DataFrame:
    """Multi-column sort of a report table (output edge only)."""
    asc = list(ascending) if ascending is not None else [True] * len(by)
    return df.orderBy(*[F.col(c).asc() if a else F.col(c).desc() for c, a in zip(by, asc)])
