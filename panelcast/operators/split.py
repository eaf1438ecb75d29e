"""Supervised frame: forecast target, chronological split, train-only scaling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelcast.functions.exact import exact_mean, exact_stddev
from panelcast.operators.features import lead_expr, panel_window


def add_target(df: DataFrame, target: str = "close", horizon: int = 1,
               key: str = "ticker", order: str = "month", name: str = "y") -> DataFrame:
    """W2 + P9: y = target ``horizon`` rows ahead; rows without it are dropped."""
    w = panel_window(key, order)
    return (df.select("*", lead_expr(target, horizon, w, name))
              .where(F.col(name).isNotNull()))


def add_targets(df: DataFrame, horizons: Sequence[int], target: str = "close",
                key: str | Sequence[str] = "ticker", order: str = "month", name: str = "y") -> DataFrame:
    """W2 + P9 for several horizons: one row for each row and ``horizon`` that
    has a target; all leads share one window."""
    w = panel_window(key, order)
    wide = df.select("*", *[lead_expr(target, h, w, f"_y{h}") for h in horizons])
    pairs = F.array(*[F.struct(F.lit(int(h)).alias("horizon"), F.col(f"_y{h}").alias(name)) for h in horizons])
    return wide.select(*[F.col(f"`{c}`") for c in df.columns], F.explode(pairs).alias("_p")).select(
        *[F.col(f"`{c}`") for c in df.columns], "_p.*").where(F.col(name).isNotNull())


def chrono_split(df: DataFrame, test_size: float = 0.2, key: str | Sequence[str] = "ticker",
                 order: str = "month", flag: str = "is_test") -> DataFrame:
    """Per key, the last ceil(test_size * n) rows (in time) are the test set.

    Same sizes as an unshuffled ``train_test_split`` with a float test size.
    Adds ``rn`` (1-based position) and ``n`` (rows of the key).
    """
    w = panel_window(key, order)
    n = F.count(F.lit(1)).over(Window.partitionBy(key))
    n_test = F.ceil(F.lit(float(test_size)) * n.cast("double"))
    return (df.withColumn("rn", F.row_number().over(w))
              .withColumn("n", n)
              .withColumn(flag, F.col("rn") > F.col("n") - n_test))


def min_rows(df: DataFrame, minimum: int, key: str = "ticker") -> DataFrame:
    """Keep keys with at least ``minimum`` rows."""
    n = F.count(F.lit(1)).over(Window.partitionBy(key))
    return df.withColumn("_n", n).where(F.col("_n") >= minimum).drop("_n")


def scaler_table(df: DataFrame, features: Sequence[str], key: str | Sequence[str] = "ticker",
                 train_flag: str = "is_test", exact_scale: int | None = None) -> DataFrame:
    """Train-only mean and population std, one row per key with
    ``{feature}__mean`` and ``{feature}__std`` (a zero or undefined std is 1).

    ``exact_scale`` names the decimals of fixed-point features, whose moments
    are then the same on any partitioning.
    """
    train = F.col(train_flag) == F.lit(False)
    aggs = []
    for f in features:
        v = F.when(train, F.col(f))
        if exact_scale is None:
            aggs += [F.avg(v).alias(f"{f}__mean"), F.stddev_pop(v).alias(f"{f}__std")]
        else:
            aggs += [exact_mean(v).alias(f"{f}__mean"), exact_stddev(v, 0, exact_scale).alias(f"{f}__std")]
    wide = df.groupBy(*([key] if isinstance(key, str) else key)).agg(*aggs)
    return wide.withColumns({f"{f}__std": F.when(F.col(f"{f}__std") != 0, F.col(f"{f}__std")).otherwise(F.lit(1.0))
                             for f in features})


def scaler_stats(df: DataFrame, features: Sequence[str], key: str | Sequence[str] = "ticker",
                 train_flag: str = "is_test") -> DataFrame:
    """Train-only mean and population std per (key, feature), long form.

    Zero (or undefined) std becomes 1, as a standard scaler does. One
    aggregation pass with partial aggregation for all features at once.
    """
    wide = scaler_table(df, features, key, train_flag)
    pairs = [F.struct(F.lit(f).alias("feature"), F.col(f"{f}__mean").alias("mean"),
                      F.col(f"{f}__std").alias("std")) for f in features]
    keys = [key] if isinstance(key, str) else list(key)
    return wide.select(*keys, F.explode(F.array(*pairs)).alias("s")).select(*keys, "s.*")


def apply_scaler(df: DataFrame, stats: DataFrame, features: Sequence[str],
                 key: str | Sequence[str] = "ticker", suffix: str = "") -> DataFrame:
    """Standardise features with per-key train statistics.

    ``stats`` holds one row per (key, feature); it is pivoted to one row per
    key, so the join side is bounded by the number of keys.
    """
    keys = [key] if isinstance(key, str) else list(key)
    wide = (stats.groupBy(*keys).pivot("feature", list(features))
                 .agg(F.first(F.struct("mean", "std"))))
    joined = df.join(wide.select(*keys, *[F.col(f"`{f}`").alias(f"__s_{f}") for f in features]),
                     on=keys, how="left")
    scaled = {f + suffix: (F.col(f) - F.col(f"__s_{f}.mean")) / F.col(f"__s_{f}.std")
              for f in features}
    return joined.withColumns(scaled).drop(*[f"__s_{f}" for f in features])


def target_scaling(df: DataFrame, y: str = "y", key: str | Sequence[str] = "ticker",
                   train_flag: str = "is_test", exact_scale: int | None = None) -> DataFrame:
    """y_mean / y_std from train rows; y_scaled and its inverse y_back."""
    stats = scaler_table(df, [y], key, train_flag, exact_scale).withColumnsRenamed({f"{y}__mean": "y_mean", f"{y}__std": "y_std"})
    out = df.join(stats, on=key, how="left")
    out = out.withColumn("y_scaled", (F.col(y) - F.col("y_mean")) / F.col("y_std"))
    return out.withColumn("y_back", inverse_scale("y_scaled"))


def inverse_scale(col: str | Column, mean: str = "y_mean", std: str = "y_std") -> Column:
    c = F.col(col) if isinstance(col, str) else col
    return c * F.col(std) + F.col(mean)
