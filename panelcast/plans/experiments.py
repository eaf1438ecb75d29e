"""Named experiments as config rows, run by one generic pipeline.

Each experiment is (name, indicators, tickers); the pipeline reads landed
series (CSV / JSON / parquet) or any long frames, aligns them, builds the
feature table, fits the per-ticker models for each horizon, and returns the
backtest and metrics tables. Many experiments are one union of plans, not a
driver loop over data.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcast.operators import clean, forecast, metrics, split, trees
from panelcast.plans import pipeline
from panelcast.plans.pipeline import Experiment
from panelcast.session import cut_lineage

# Reference date window of the landed series (fixed values).
DEFAULT_START, DEFAULT_END = "2010-01-01", "2025-04-30"

# Experiment configurations (fixed values: indicator ids and tickers).
_W = {"start": DEFAULT_START, "end": DEFAULT_END}
REFERENCE_EXPERIMENTS = (
    Experiment("sp500_leading_indicators",
               ("USSLIND", "WTISPLC", "PERMIT", "UMCSENT", "M2SL"), ("SPY",), **_W),
    Experiment("m2_crypto_metals", ("M2SL",), ("BTC-USD", "GLD", "SLV"), **_W),
    Experiment("oil", ("WTISPLC",), ("XOM",), **_W),
    Experiment("unemployment_discretionary", ("UNRATE",), ("XLY",), **_W),
    Experiment("orders_industrials", ("UMDMNO",), ("CAT", "EMR", "FDX", "UPS"), **_W),
    Experiment("yield_curve_banks", ("T10Y3M", "T10Y2Y", "T10Y10Y", "T5Y10Y", "T5Y3M"),
               ("JPM", "BAC", "WFC", "GS"), **_W),
    Experiment("cpi_real_estate", ("CPIAUCSL",), ("VNQ",), **_W),
    Experiment("jobless_claims_staffing_retail", ("ICSA",), ("RHI", "MAN", "TGT", "AMZN"), **_W),
    Experiment("housing_permits_homebuilders", ("PERMIT1",), ("EXB",), **_W),
)


def run_experiment(prices: DataFrame, indicators: DataFrame, exp: Experiment,
                   model: str = "linear") -> tuple[DataFrame, DataFrame]:
    """One experiment -> (backtest, metrics) over all its tickers and horizons.

    ``model='linear'``: per-ticker OLS on the experiment's feature list;
    ``'ols1'``: the closed-form one-feature OLS on the current price.
    Absent indicators are skipped (see ``missing_series``).
    """
    feat = pipeline.features_from(prices, indicators, exp)
    present = [c for c in exp.feature_list() if c in feat.columns]
    bts = []
    for h in exp.horizons:  # a short config list
        feat = split.min_rows(feat, h + 2)  # P16: a target, a train and a test row at least
        if model == "linear":
            bt = pipeline.ols_multi_backtest(feat, present, h, test_size=exp.test_size,
                                             neutral=exp.neutral)
        else:
            bt = pipeline.ols_single_backtest(feat, h, test_size=exp.test_size,
                                              neutral=exp.neutral)
        bts.append(bt)
    bt = bts[0]
    for b in bts[1:]:
        bt = bt.unionByName(b)
    bt = bt.select(F.lit(exp.name).alias("experiment"), "*")
    m = metrics.regression_metrics(bt, keys=("experiment", "ticker", "model", "horizon"))
    return bt, m


def run_experiments(prices: DataFrame, indicators: DataFrame,
                    experiments: Sequence[Experiment] = REFERENCE_EXPERIMENTS,
                    model: str = "linear", materialize: bool = True) -> tuple[DataFrame, DataFrame]:
    """All experiments' backtests and metrics as two tables.

    With ``materialize`` the monthly inputs are checkpointed once, so the
    experiments share one read of the raw sources.
    """
    if materialize:
        prices, indicators = cut_lineage(prices), cut_lineage(indicators)
    out_bt = out_m = None
    for exp in experiments:
        bt, m = run_experiment(prices, indicators, exp, model)
        out_bt = bt if out_bt is None else out_bt.unionByName(bt)
        out_m = m if out_m is None else out_m.unionByName(m)
    return out_bt, out_m


def universe_sweep(feat: DataFrame, candidates: Sequence[str], horizons: Sequence[int] = (1, 3),
                   n_features: int = 10, n_models: int = 10) -> tuple[DataFrame, DataFrame]:
    """Per ticker, keep its own ``n_features`` best candidates, fit on them
    for each horizon, and report the best ``n_models`` runs by R2.

    The ranking is that of each ticker's linear model (standardised
    coefficients on train rows); nothing is collected. Returns (results with
    the ticker's ``top_features`` array, top runs).
    """
    feat = cut_lineage(feat)
    names = F.array(*[F.lit(c) for c in candidates])
    res = None
    for h in horizons:  # a short config list
        sup = cut_lineage(pipeline.supervised(feat, h))
        coef, stats = forecast.fit_ols(sup, candidates, top=n_features)
        coef = cut_lineage(coef)
        bt = forecast.backtest(forecast.predict_ols(sup, coef, stats, candidates), "LinearRegression", h, neutral="")
        chosen = F.filter(F.arrays_zip(names.alias("name"), F.col("coef").alias("b")), lambda x: x["b"] != 0)
        best = F.transform(F.array_sort(F.transform(chosen, lambda x: F.struct((-F.abs(x["b"])).alias("w"), x["name"].alias("name")))),
                           lambda x: x["name"])
        m = metrics.regression_metrics(bt, digits=None).join(coef.select("ticker", best.alias("top_features")), "ticker")
        res = m if res is None else res.unionByName(m)
    return res, metrics.top_k(res, n_models, "r2", ["ticker", "horizon"])


def forest_features(feat: DataFrame, candidates: Sequence[str], n_features: int = 10, target: str = "close",
                    test_size: float = 0.2, num_trees: int = 50, max_depth: int = 5) -> DataFrame:
    """(ticker, top_features): the names of each ticker's ``n_features``
    most important candidates, best first, by a forest on its train rows.

    Rows that miss a candidate or the target are left out before the split;
    equal importances are ordered by name. All tickers' forests grow at once.
    """
    rows = split.chrono_split(clean.drop_missing(feat, [*candidates, target]), test_size)
    nodes, _ = trees.fit_forest(rows, candidates, target, num_trees=num_trees, max_depth=max_depth)
    best = metrics.top_k_per_group(trees.importances(nodes, candidates), n_features, ["ticker"], "importance", ["feature"])
    in_order = F.array_sort(F.collect_list(F.struct("rank", "feature")))
    return best.groupBy("ticker").agg(F.transform(in_order, lambda x: x["feature"]).alias("top_features"))


def forest_sweep(feat: DataFrame, candidates: Sequence[str], horizons: Sequence[int] = (1, 3), n_features: int = 10,
                 n_models: int = 10, models: Sequence[str] = ("linear",), num_trees: int = 50, max_depth: int = 5,
                 rounds: int = 100) -> tuple[DataFrame, DataFrame]:
    """Each ticker's own best features by its forest, a model on them for
    each horizon, and the ``n_models`` best runs by R2.

    Ticker and horizon are keys of one plan. A ticker's other candidates are
    constant for it, so that they take no part in its models. Returns (results
    with the ticker's ``top_features``, top runs).
    """
    feat = cut_lineage(feat)
    own = cut_lineage(forest_features(feat, candidates, n_features, num_trees=num_trees, max_depth=max_depth))
    cols = [f"_own_{i}" for i in range(len(candidates))]
    masked = feat.join(own, "ticker").select(
        "ticker", "month", "close",
        *[F.when(F.array_contains("top_features", f), F.col(f"`{f}`").cast("double")).otherwise(F.lit(0.0)).alias(c)
          for f, c in zip(candidates, cols)])
    bt = pipeline.model_backtests(masked, cols, horizons, models, rounds=rounds)
    res = metrics.regression_metrics(bt, digits=None).join(own, "ticker")
    return res, metrics.top_k(res, n_models, "r2", ["ticker", "model", "horizon"])
