"""End-to-end plans: read -> align -> features -> target/split -> fit -> score.

An experiment is a config row (name, tickers, indicators, options); one
generic pipeline runs any number of them. Tickers are a column of the panel,
never a Python loop: per-ticker work is partitioning.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelcast.functions.numeric import safe_name
from panelcast.operators import align, clean, features, forecast, split
from panelcast.session import cut_lineage
from panelcast.sources import testdata


@dataclass(frozen=True)
class Experiment:
    name: str
    indicators: tuple[str, ...]
    tickers: tuple[str, ...] | None = None      # None = every ticker in the data
    lags: tuple[int, ...] = (1, 3, 6)
    mas: tuple[int, ...] = (3, 12)
    horizons: tuple[int, ...] = (1,)
    align: str = "inner"                        # 'inner' | 'asof'
    warmup: str = "drop"                        # 'drop' | 'backfill'
    lag_target: bool = False
    lag_volume: bool = True
    volatility: bool = True
    start: str | None = None
    end: str | None = None
    test_size: float = 0.2
    neutral: str = "Hold"

    @property
    def indicator_cols(self) -> list[str]:
        return [safe_name(s) for s in self.indicators]

    def feature_list(self) -> list[str]:
        """Model inputs: ma3, ma12, volume_lag1, volatility + each indicator's
        level and lags."""
        cols = [f"close_ma{m}" for m in self.mas]
        if self.lag_volume:
            cols.append("volume_lag1")
        if self.volatility:
            cols.append("close_volatility")
        for c in self.indicator_cols:
            cols += [c] + [f"{c}_lag{k}" for k in self.lags]
        return cols


# Indicator ids of the driver tables (order priorities), the test-data
# counterpart of a macro-series list.
TEST_SERIES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")

# Experiment configs over the test data, shaped like the named experiments:
# several indicators -> one index; one indicator -> a few assets; etc.
TEST_EXPERIMENTS = (
    Experiment("leading_indicators", TEST_SERIES),
    Experiment("single_driver_assets", ("1-URGENT",), ("Brand#1", "Brand#2", "Brand#3")),
    Experiment("two_drivers_sector", ("2-HIGH", "5-LOW"),
               ("Brand#11", "Brand#12", "Brand#13", "Brand#14")),
    Experiment("one_driver_one_asset", ("3-MEDIUM",), ("Brand#21",)),
)


def load_prices(spark: SparkSession, sf_dir: str, exp: Experiment) -> DataFrame:
    p = testdata.prices(spark, sf_dir, exp.start, exp.end)
    if exp.tickers:
        p = p.where(F.col("ticker").isin(list(exp.tickers)))
    return p


def align_frames(prices: DataFrame, indicators: DataFrame, exp: Experiment,
                 check_present: bool = True) -> tuple[DataFrame, list[str]]:
    """Prices aligned with the experiment's indicators (present ones only).

    ``indicators`` is long (series_id, month, value), at any frequency; as-of
    alignment carries low-frequency and ended series forward.
    """
    if exp.tickers:
        prices = prices.where(F.col("ticker").isin(list(exp.tickers)))
    # P7 date window: prices inside [start, end]; indicators up to end (and
    # from start for inner alignment - an as-of value may come from earlier)
    prices = clean.range_slice(prices, "month", exp.start, exp.end)
    indicators = clean.range_slice(indicators, "month",
                                   None if exp.align == "asof" else exp.start, exp.end)
    ids = align.present_series(indicators, exp.indicators) if check_present \
        else list(exp.indicators)
    if exp.align == "asof":
        return align.align_asof(prices, indicators, ids), ids
    return align.align_inner(prices, indicators, ids), ids


def features_from(prices: DataFrame, indicators: DataFrame, exp: Experiment,
                  check_present: bool = True) -> DataFrame:
    """Feature table of one experiment from any (prices, indicators) frames."""
    clean.require_columns(prices, ["ticker", "month", "close", "volume"])
    clean.require_columns(indicators, ["series_id", "month", "value"])
    panel, ids = align_frames(prices, indicators, exp, check_present)
    ind_cols = [safe_name(s) for s in ids]
    lag_cols = (["volume"] if exp.lag_volume else []) + ind_cols
    return features.build_features(panel, target="close", lag_cols=lag_cols, lags=exp.lags,
                                   mas=exp.mas, volatility=exp.volatility,
                                   lag_target=exp.lag_target, warmup=exp.warmup)


def feature_table(spark: SparkSession, sf_dir: str, exp: Experiment,
                  check_present: bool = True) -> DataFrame:
    prices = load_prices(spark, sf_dir, exp)
    if exp.align == "asof":
        ind = testdata.quarterly(spark, sf_dir, None, exp.end)  # earlier values carry in
    else:
        ind = testdata.indicators(spark, sf_dir, exp.start, exp.end)
    return features_from(prices, ind, exp, check_present)


def supervised(feat: DataFrame, horizon: int, test_size: float = 0.2) -> DataFrame:
    """W2 + P9 + W5: y = close h rows ahead, chronological split flags."""
    return split.chrono_split(split.add_target(feat, "close", horizon), test_size)


def ols_single_backtest(feat: DataFrame, horizon: int, x: str = "close",
                        model: str = "OLS", test_size: float = 0.2,
                        neutral: str = "Hold") -> DataFrame:
    """G5 (closed form) -> G1/G2 backtest rows for one horizon."""
    sup = supervised(feat, horizon, test_size)
    coef = forecast.fit_ols_single(sup, x)
    scored = forecast.predict_single(sup, coef, x)
    return forecast.backtest(scored, model, horizon, neutral=neutral)


def ols_multi_backtest(feat: DataFrame, feats: Sequence[str], horizon: int,
                       model: str = "LinearRegression", test_size: float = 0.2,
                       neutral: str = "") -> DataFrame:
    """G3 + G5 (many features) -> backtest rows.

    The supervised frame (one row per ticker-month) feeds the scaler, the
    moments and the predictions; it is checkpointed once to the shared
    checkpoint folder instead of being recomputed from the raw scans.
    """
    sup = cut_lineage(supervised(feat, horizon, test_size))
    coef, stats = forecast.fit_ols(sup, feats)
    scored = forecast.predict_ols(sup, coef, stats, feats)
    return forecast.backtest(scored, model, horizon, neutral=neutral)


def horizon_backtests(feat: DataFrame, horizons: Sequence[int], x: str = "close", model: str = "OLS",
                      test_size: float = 0.2, neutral: str = "Hold",
                      runs: Sequence[str] = ("ticker",)) -> DataFrame:
    """One backtest table over a list of horizons (and of further run
    columns): the horizon is a key like the ticker, so the plan is the same for
    any number of them."""
    keys = [*runs, "horizon"]
    sup = split.chrono_split(split.add_targets(feat, horizons, "close", list(runs)), test_size, key=keys)
    scored = forecast.predict_single(sup, forecast.fit_ols_single(sup, x, key=keys), x, key=keys)
    return forecast.backtest(scored, model, "horizon", neutral=neutral, runs=[r for r in runs if r != "ticker"])


MODELS = ("ols1", "linear", "gbt")


def model_backtests(feat: DataFrame, feats: Sequence[str], horizons: Sequence[int], models: Sequence[str] = MODELS,
                    runs: Sequence[str] = ("ticker",), test_size: float = 0.2, neutral: str = "",
                    rounds: int = 100, max_depth: int = 6) -> DataFrame:
    """Model x horizon x run grid as one backtest table.

    ``ols1`` regresses on the current close, ``linear`` on all of ``feats`` with
    G3 scaling, ``gbt`` boosts trees on them with G4 scaling. The run columns
    and the horizon are keys of each model's fit, so a plan is the same for any
    number of tickers, experiments and horizons. A feature that is constant for
    a run takes no part in it.
    """
    from panelcast.operators import trees

    unknown = set(models) - set(MODELS)
    if unknown:
        raise ValueError(f"unknown models: {sorted(unknown)}")
    keys = [*runs, "horizon"]
    sup = cut_lineage(split.chrono_split(split.add_targets(feat, horizons, "close", list(runs)), test_size, key=keys))
    parts = []
    if "ols1" in models:
        parts.append(("OLS", forecast.predict_single(sup, forecast.fit_ols_single(sup, "close", key=keys), "close", key=keys)))
    if "linear" in models:
        coef, stats = forecast.fit_ols(sup, feats, key=keys)
        parts.append(("LinearRegression", forecast.predict_ols(sup, coef, stats, feats, key=keys)))
    if "gbt" in models:
        parts.append(("GBT", trees.fit_boosted(sup, feats, key=keys, rounds=rounds, max_depth=max_depth)[0]))
    out = None
    for name, scored in parts:  # a short config list
        bt = forecast.backtest(scored, name, "horizon", neutral=neutral, runs=[r for r in runs if r != "ticker"])
        out = bt if out is None else out.unionByName(bt)
    return out


def experiment_features(prices: DataFrame, indicators: DataFrame, experiments: Sequence[Experiment]) -> DataFrame:
    """Feature rows of several experiments (inner-aligned, same lags and
    windows) in one plan, keyed by (experiment, ticker).

    The config rows are literals: each price row is kept for the experiments
    of its ticker, indicators that an experiment doesn't use are a constant
    for it, and one window pass partitioned by (experiment, ticker) builds all
    features. The plan doesn't grow with the number of experiments.
    """
    first = experiments[0]
    if any((e.lags, e.mas, e.align, e.warmup, e.lag_target, e.lag_volume, e.volatility)
           != (first.lags, first.mas, "inner", "drop", first.lag_target, first.lag_volume, first.volatility)
           or e.start or e.end or max(e.lags) >= max(e.mas) for e in experiments):
        raise ValueError("these experiments don't share their options; run them one by one")
    ids = sorted({s for e in experiments for s in e.indicators})
    config = F.array(*[F.struct(
        F.lit(e.name).alias("experiment"),
        (F.array(*map(F.lit, e.tickers)) if e.tickers else F.lit(None).cast("array<string>")).alias("tickers"),
        F.array(*map(F.lit, e.indicators)).alias("ids")) for e in experiments])
    mine = F.filter(config, lambda c: c["tickers"].isNull() | F.array_contains(c["tickers"], F.col("ticker")))
    rows = prices.select("*", F.explode(mine).alias("_c"))
    wide = align.pivot_series(indicators, ids)
    cols = [safe_name(s) for s in ids]
    panel = rows.join(wide, on="month", how="left").select(
        "month", "ticker", "close", "volume", F.col("_c.experiment").alias("experiment"),
        *[F.when(F.array_contains("_c.ids", s), F.col(c)).otherwise(F.lit(0.0)).alias(c) for s, c in zip(ids, cols)])
    return features.build_features(
        clean.drop_missing(panel, cols), target="close", lag_cols=(["volume"] if first.lag_volume else []) + cols,
        lags=first.lags, mas=first.mas, volatility=first.volatility, lag_target=first.lag_target, warmup="drop",
        key=["experiment", "ticker"])
