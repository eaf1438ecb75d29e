"""Registered queries: one per operator family, each over the whole tables.

Every callable takes (spark, sf_dir) and returns a lazy DataFrame. Output
columns are aliased to the names used by the SQL oracle (plans/oracle.py).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelcast.functions.numeric import order_key, round_half_even, safe_name, to_double
from panelcast.operators import align, clean, drift, features, forecast, metrics, split, trees
from panelcast.plans import pipeline
from panelcast.plans.pipeline import TEST_EXPERIMENTS, TEST_SERIES, Experiment
from panelcast.sources import files, testdata

Query = Callable[[SparkSession, str], DataFrame]

E1 = TEST_EXPERIMENTS[0]
# generation-A options: as-of alignment, lags of the target too, back-filled
# warm-up, no volume / volatility columns
GOLDEN = Experiment("golden_layout", TEST_SERIES, align="asof", warmup="backfill",
                    lag_target=True, lag_volume=False, volatility=False)
REQUESTED = ("1-URGENT", "2-HIGH", "M2SL", "WTISPLC", "5-LOW")
SLICE = ("1996-01-01", "2000-12-31")
DRIFT_REF_END = "2024-01-20"
DRIFT_DAYS = 7


# --- sources, canonicalisation ------------------------------------------------

def monthly_price_bars(spark, sf):
    return testdata.prices(spark, sf)


def monthly_indicator_mean(spark, sf):
    return testdata.resample_mean(testdata.indicator_obs(spark, sf))


def observations_json_flatten(spark, sf):
    obs = files.flatten_json_object(testdata.props(spark, sf), "props")
    return obs.select("obs_id", "series_id", F.to_date("ts").alias("day"), "field", "value")


def numeric_coercion(spark, sf):
    ev = testdata.props(spark, sf)
    raw = F.get_json_object("props", "$.k")
    return ev.select("obs_id", raw.alias("raw"), to_double(raw).alias("value"),
                     to_double("series_id").alias("series_as_number"))


def first_per_month(spark, sf):
    ticks = testdata.price_ticks(spark, sf)
    return clean.first_per_period(ticks, ["ticker"], F.trunc(F.to_date("ts"), "month"),
                                  order_key("ts", "seq"), ["ts", "price", "qty"])


def duplicate_month_check(spark, sf):
    ticks = testdata.price_ticks(spark, sf)
    return clean.duplicate_periods(ticks, ["ticker"], F.trunc(F.to_date("ts"), "month"))


def missing_series_report(spark, sf):
    return align.missing_series(testdata.indicators(spark, sf), REQUESTED)


def _grid(spark, sf):
    return clean.reindex_months(testdata.prices(spark, sf), ["ticker"])


def forward_fill(spark, sf):
    g = _grid(spark, sf)
    filled = clean.forward_fill(g.withColumn("close_ffill", F.col("close")),
                                ["ticker"], "month", ["close_ffill"])
    return filled.select("ticker", "month", "close", "close_ffill")


def back_fill(spark, sf):
    g = _grid(spark, sf)
    filled = clean.back_fill(g.withColumn("close_bfill", F.col("close")),
                             ["ticker"], "month", ["close_bfill"])
    return filled.select("ticker", "month", "close", "close_bfill")


def null_counts(spark, sf):
    return clean.null_counts(_grid(spark, sf), ["ticker"], ["close", "volume"])


# --- alignment ----------------------------------------------------------------

def align_inner(spark, sf):
    return align.align_inner(testdata.prices(spark, sf), testdata.indicators(spark, sf),
                             list(TEST_SERIES))


def align_asof(spark, sf):
    return align.align_asof(testdata.prices(spark, sf), testdata.quarterly(spark, sf),
                            list(TEST_SERIES))


def wide_pivot(spark, sf):
    """J1 over the whole ticker universe, in long form: the rows of the months
    in which every ticker traded (a column a ticker is left to report edges)."""
    return align.shared_periods(testdata.prices(spark, sf)).select("month", "ticker", "close")


def wide_unpivot(spark, sf):
    """The wide indicator table back in long rows."""
    wide = align.pivot_series(testdata.indicators(spark, sf), list(TEST_SERIES))
    return align.wide_to_long(wide, ["month"], [safe_name(s) for s in TEST_SERIES])


def range_slice(spark, sf):
    return testdata.prices(spark, sf, *SLICE)


def drop_missing(spark, sf):
    grid = _grid(spark, sf)
    wide = align.pivot_series(testdata.indicators(spark, sf), list(TEST_SERIES))
    return clean.drop_missing(grid.join(wide, on="month", how="left"))


def prefix_split(spark, sf):
    m = metrics.regression_metrics(_ols_backtests(spark, sf))
    runs = m.select(F.concat_ws("_", "ticker", "model").alias("run_name"), "horizon")
    return clean.split_run_name(runs, "run_name")


# --- features -------------------------------------------------------------------

def _panel(spark, sf):
    return align_inner(spark, sf)


def lag_features(spark, sf):
    p = _panel(spark, sf)
    w = features.panel_window()
    cols = ["volume"] + [safe_name(s) for s in TEST_SERIES]
    return p.select("ticker", "month", *features.lag_exprs(cols, (1, 3, 6), w))


def lead_target(spark, sf):
    p = testdata.prices(spark, sf)
    return split.add_target(p, "close", 1).select("ticker", "month", "close", "y")


def moving_average(spark, sf):
    p = testdata.prices(spark, sf)
    w = features.panel_window()
    return p.select("ticker", "month", "close",
                    features.moving_average_expr("close", 3, w),
                    features.moving_average_expr("close", 12, w))


def rolling_volatility(spark, sf):
    p = testdata.prices(spark, sf)
    w = features.panel_window()
    return p.select("ticker", "month", "close", features.volatility_expr("close", 3, w))


def feature_table(spark, sf):
    return pipeline.feature_table(spark, sf, E1, check_present=False)


def feature_table_backfilled(spark, sf):
    return pipeline.feature_table(spark, sf, GOLDEN, check_present=False)


def lagged_comparison(spark, sf):
    return features.lagged_comparison(_panel(spark, sf), "close",
                                      [safe_name(s) for s in TEST_SERIES], 3)


def correlation_matrix(spark, sf):
    """Every numeric column of the feature table against every other."""
    ft = feature_table(spark, sf)
    return metrics.correlation_matrix(ft, [c for c, t in ft.dtypes if t == "double"])


# --- supervised frame ---------------------------------------------------------

def _supervised(spark, sf, horizon=1):
    return pipeline.supervised(feature_table(spark, sf), horizon)


def chrono_split(spark, sf):
    return _supervised(spark, sf).select("ticker", "month", "rn", "n", "is_test")


def train_scaler(spark, sf):
    cols = ("close", "volume", "y")
    stats = split.scaler_table(_supervised(spark, sf), cols, exact_scale=4)
    return stats.select("ticker", *[F.col(f"{c}__{k}").alias(f"{c}_{k}") for c in cols for k in ("mean", "std")])


def target_scaling_roundtrip(spark, sf):
    out = split.target_scaling(_supervised(spark, sf), exact_scale=4)
    return out.select("ticker", "month", "y", "y_scaled",
                      round_half_even("y_back", 4).alias("y_back"))


# --- forecasting, signals, metrics -----------------------------------------------

def _ols_backtests(spark, sf):
    return pipeline.ols_single_backtest(feature_table(spark, sf), 1)


def ols_forecast(spark, sf):
    sup = _supervised(spark, sf)
    coef = forecast.fit_ols_single(sup, "close")
    scored = forecast.predict_single(sup, coef, "close")
    return scored.where("is_test").select("ticker", "month", "close", "y", "predicted")


def backtest_signals(spark, sf):
    return _ols_backtests(spark, sf)


def signal_counts(spark, sf):
    return metrics.signal_counts(_ols_backtests(spark, sf))


def buy_sell_markers(spark, sf):
    return metrics.markers(_ols_backtests(spark, sf))


def metrics_summary(spark, sf):
    return metrics.regression_metrics(_ols_backtests(spark, sf))


def top_models(spark, sf):
    return metrics.top_k(metrics_summary(spark, sf), 10, "r2", ["ticker", "horizon"])


def bias_directional(spark, sf):
    return metrics.bias_directional(_ols_backtests(spark, sf))


def bias_correction(spark, sf):
    # the 3-month average as a baseline forecast of next month's price
    sup = _supervised(spark, sf).withColumn("predicted", F.col("close_ma3"))
    fixed = forecast.bias_correct(sup, "predicted", "y")
    return fixed.where("is_test").select(
        "ticker", "month", "y", round_half_even("train_bias", 4).alias("train_bias"),
        round_half_even("predicted", 4).alias("predicted"))


def horizon_grid(spark, sf):
    bt = pipeline.horizon_backtests(feature_table(spark, sf), (1, 3))
    return metrics.regression_metrics(bt)


def experiment_suite(spark, sf):
    feat = pipeline.experiment_features(testdata.prices(spark, sf), testdata.indicators(spark, sf), TEST_EXPERIMENTS)
    bt = pipeline.horizon_backtests(feat, (1,), runs=("experiment", "ticker"))
    return metrics.regression_metrics(bt, ("experiment", *metrics.RUN_KEYS))


# --- drift, stationarity --------------------------------------------------------

def ks_drift_statistic(spark, sf):
    d = drift.ks_statistic(testdata.daily(spark, sf), "series_id", "day", "value",
                           DRIFT_REF_END, window_days=DRIFT_DAYS)
    return d.select("series_id", "n_ref", "n_cur", "ks_statistic")


def ks_drift_statistic_monthly(spark, sf):
    """KS statistic with the default monthly current window (last 12 months
    up to each series' latest date, overlapping the reference window)."""
    d = drift.ks_statistic(testdata.daily(spark, sf), "series_id", "day", "value",
                           DRIFT_REF_END, window_months=12)
    return d.select("series_id", "n_ref", "n_cur", "ks_statistic")


def ks_drift_test(spark, sf):
    res = drift.ks_drift(testdata.daily(spark, sf), "series_id", "day", "value",
                         DRIFT_REF_END, window_days=DRIFT_DAYS, method="asymp")
    return res.withColumn("p_value", F.round("p_value", 10))


def ks_drift_flag(spark, sf):
    """Drift verdict with the default monthly windows: the current window is
    the last 12 months up to each series' latest date (it may overlap the
    reference window); drift when p < 0.05."""
    res = drift.ks_drift(testdata.daily(spark, sf), "series_id", "day", "value",
                         DRIFT_REF_END, window_months=12, method="asymp")
    return res.select("series_id", "n_ref", "n_cur", "ks_statistic", "drift_detected")


def adf_lag0(spark, sf):
    return drift.adf_lag0(testdata.prices(spark, sf))


def adf_test(spark, sf):
    return drift.adf_test(testdata.prices(spark, sf)).withColumn("p_value", F.round("p_value", 8))


def adf_short_lags(spark, sf):
    """The lag search over 0 and 1, and the statistic of the chosen lag."""
    found = drift.adf(testdata.prices(spark, sf), max_lag=1)
    return found.select("ticker", "nobs", "used_lag", F.round("ic_best", 6).alias("ic_best"),
                        F.round("adf_stat", 6).alias("adf_stat"))


def adf_autolag(spark, sf):
    return drift.adf(testdata.prices(spark, sf))


# --- pooled / per-key ML models (rows-only checks) --------------------------------

def multi_linear_forecast(spark, sf):
    return pipeline.ols_multi_backtest(feature_table(spark, sf), E1.feature_list(), 1)


def gbt_forecast(spark, sf):
    sup = _supervised(spark, sf)
    scored = forecast.gbt_forecast(sup, E1.feature_list())
    return forecast.backtest(scored, "GBT", 1, neutral="")


def rf_feature_importance(spark, sf):
    ft = pipeline.supervised(feature_table(spark, sf), 1)
    feats = [c for c in ft.columns
             if c not in ("ticker", "month", "close", "y", "rn", "n", "is_test")]
    imp = forecast.rf_importance(ft, feats, label="close")
    return metrics.top_k(imp, 10, "importance", ["feature"])


def cv_folds(spark, sf):
    """The contiguous fold of every training row."""
    sup = _supervised(spark, sf).where(~F.col("is_test"))
    return forecast.fold_ids(sup, 5).select("ticker", "month", "fold")


def cv_r2(spark, sf):
    ft = pipeline.supervised(feature_table(spark, sf), 1).where(~F.col("is_test"))
    return forecast.cv_r2(ft, E1.feature_list(), label="close")


def ticker_top_features(spark, sf):
    """T2 per ticker: the 10 most important inputs of each ticker's linear model."""
    sup = pipeline.supervised(feature_table(spark, sf), 1)
    coef, _ = forecast.fit_ols(sup, E1.feature_list())
    imp = forecast.linear_importance(coef, E1.feature_list())
    return metrics.top_k_per_group(imp, 10, ["ticker"], "importance", ["feature"])


def cv_ols_r2(spark, sf):
    """Per-ticker 5-fold CV R2 (mean, population std) of the linear model."""
    sup = pipeline.supervised(feature_table(spark, sf), 1)
    return forecast.cv_ols_r2(sup, E1.feature_list())


def universe_sweep(spark, sf):
    from panelcast.plans import experiments
    feat = feature_table(spark, sf)
    cands = clean.columns_except(feat, "close", ("ticker", "month"))
    _, best = experiments.universe_sweep(feat, cands)
    return best


def streaming_monthly_bars(spark, sf):
    """Trades landed as files in two batches, the second with late ones, and
    read by a stream; every month, the newest too."""
    import uuid

    from panelcast.session import ensure_checkpoint_dir
    from panelcast.streaming import bars
    root = f"{ensure_checkpoint_dir(spark).rstrip('/')}/streams/q-{uuid.uuid4().hex[:8]}"
    ticks = testdata.price_ticks(spark, sf)
    late = F.pmod(F.col("seq"), F.lit(16)) == 9  # some trades of every month come in the second batch
    for part, rows in (("a", ticks.where(~late)), ("b", ticks.where(late))):
        bars.stage_ticks(rows, f"{root}/feed/{part}")
        bars.run_bars(spark, f"{root}/feed/*", f"{root}/bars", checkpoint=f"{root}/ck")
    return bars.read_bars(spark, f"{root}/bars")


def streaming_drift_updates(spark, sf):
    """Events landed in two batches and streamed; drift re-checked per batch
    for the touched series. The final statistics equal the batch ones."""
    import uuid

    from panelcast.session import ensure_checkpoint_dir
    from panelcast.streaming import drift_updates
    root = f"{ensure_checkpoint_dir(spark).rstrip('/')}/streams/d-{uuid.uuid4().hex[:8]}"
    obs = testdata.daily(spark, sf).select("series_id", F.col("day").alias("date"), "value")
    cut = F.lit(DRIFT_REF_END).cast("date")
    for part, cond in (("a", F.col("date") <= cut), ("b", F.col("date") > cut)):
        obs.where(cond).write.parquet(f"{root}/feed/{part}")
        drift_updates.run_drift_updates(spark, f"{root}/feed/*", f"{root}/history", f"{root}/results",
                                        reference_end=DRIFT_REF_END, window_days=DRIFT_DAYS,
                                        checkpoint=f"{root}/ck")
    res = spark.read.parquet(f"{root}/results").drop("batch_id")
    return res.withColumn("p_value", F.round("p_value", 10))


def score_saved_model(spark, sf):
    from panelcast.plans import monitoring
    return monitoring.score_saved_model(spark, sf)


# --- smaller operators on the same tables ------------------------------------------

WIDE_TICKERS = tuple(f"Brand#{k}" for k in range(1, 26))


def provider_json_flatten(spark, sf):
    """S3: one observation document per series, as a provider sends it, back in rows."""
    ind = testdata.indicators(spark, sf)
    obs = F.array_sort(F.collect_list(F.struct(F.date_format("month", "yyyy-MM-dd").alias("date"),
                                               F.col("value").cast("string").alias("value"))))
    docs = ind.groupBy("series_id").agg(F.to_json(F.struct(obs.alias("observations"))).alias("doc"))
    return files.flatten_observations(docs, "doc").select("series_id", F.col("date").alias("month"), "value")


def traded_universe(spark, sf):
    """The tickers with at least one bar."""
    return testdata.prices(spark, sf).select("ticker").distinct()


def wide_prices(spark, sf):
    """Close and volume columns of every ticker, in months all share."""
    wide = align.wide_prices(testdata.prices(spark, sf), list(WIDE_TICKERS)).dropna(how="any")
    return wide.select("month", *[F.col(f"`{t}_{c}`").alias(f"{safe_name(t)}_{c}")
                                  for t in WIDE_TICKERS for c in ("Close", "Volume")])


def feature_inputs(spark, sf):
    """P10: every feature column but the target and the keys."""
    ft = feature_table(spark, sf)
    return ft.select("ticker", "month", *clean.columns_except(ft, "close", ("ticker", "month")))


def preview_bars(spark, sf):
    """The first rows of the panel."""
    return clean.preview(testdata.prices(spark, sf))


def long_histories(spark, sf):
    """Tickers with at least 83 months of bars."""
    return split.min_rows(testdata.prices(spark, sf), 83)


def latest_runs(spark, sf):
    """Of two runs of a ticker's model, the later one."""
    ft = feature_table(spark, sf)
    runs = [metrics.regression_metrics(pipeline.ols_single_backtest(ft, h)).withColumn("run_seq", F.lit(k))
            for k, h in enumerate((1, 3))]
    return metrics.latest_per_run(runs[0].unionByName(runs[1]))


def sorted_metrics(spark, sf):
    """The metrics by a user's choice of columns."""
    return metrics.sort_table(metrics_summary(spark, sf), ["rmse", "ticker"], [False, True])


def feature_names(spark, sf):
    """The model's inputs as one string per run."""
    runs = metrics_summary(spark, sf).select("ticker", "model")
    return runs.withColumn("features", F.concat_ws(", ", *[F.lit(f) for f in E1.feature_list()]))


def ticker_ranges(spark, sf):
    """H1: a pandas function on each ticker's monthly rows."""
    def ranges(pdf):
        return pdf.groupby("ticker", as_index=False).agg(low=("close", "min"), high=("close", "max"), n=("close", "count"))

    return forecast.apply_per_ticker(testdata.prices(spark, sf), ranges, "ticker string, low double, high double, n long")


def linear_residuals(spark, sf):
    """Residuals of the many-feature fit on its train rows: their mean and
    their largest correlation with a feature are 0 for least squares."""
    from panelcast.session import cut_lineage
    feats = E1.feature_list()
    sup = cut_lineage(_supervised(spark, sf))
    coef, stats = forecast.fit_ols(sup, feats)
    train = forecast.predict_ols(sup, coef, stats, feats).where(~F.col("is_test"))
    resid = F.col("y") - F.col("predicted")
    # against the spread of y, so that rounding of a perfect fit is 0 as well
    products = [F.abs(F.covar_pop(resid, F.col(f"`{f}`"))) / F.nullif(F.stddev_pop(f"`{f}`") * F.stddev_pop("y"), F.lit(0.0))
                for f in feats]
    out = train.groupBy("ticker").agg(F.count(F.lit(1)).alias("n_train"), (F.abs(F.avg(resid)) / F.stddev_pop("y")).alias("mean"),
                                      F.coalesce(F.greatest(*products), F.lit(0.0)).alias("worst"))
    return out.select("ticker", "n_train", round_half_even("mean", 6).alias("mean_residual"),
                      round_half_even("worst", 6).alias("worst_correlation"))


# --- trees, models as a run axis ------------------------------------------------

def _named(feature: str = "feature"):
    return F.element_at(F.array(*[F.lit(f) for f in E1.feature_list()]), F.col(feature) + 1)


def tree_root_split(spark, sf):
    """Each ticker's best first cut over all features, train rows."""
    nodes, _ = trees.fit_forest(_supervised(spark, sf), E1.feature_list(), num_trees=1, max_depth=1, bootstrap=False)
    return nodes.select("ticker", _named().alias("feature"), F.col("bin").cast("long").alias("bin"), "n", "gain", "value",
                        "left_value", "right_value")


def boosted_first_round(spark, sf):
    """Predictions after one round of depth-1 trees, all rows."""
    scored, _ = trees.fit_boosted(_supervised(spark, sf), E1.feature_list(), rounds=1, max_depth=1)
    return scored.select("ticker", "month", "y", "predicted")


def ticker_forest_importance(spark, sf):
    """The ten most important features of each ticker's forest, train rows."""
    sup = _supervised(spark, sf)
    feats = clean.columns_except(sup, "close", ("ticker", "month", "y", "rn", "n", "is_test"))
    nodes, _ = trees.fit_forest(sup, feats, "close")
    return metrics.top_k_per_group(trees.importances(nodes, feats), 10, ["ticker"], "importance", ["feature"])


def ticker_forest_cv(spark, sf):
    """Five-fold R2 of each ticker's forest on its train rows."""
    return trees.cross_validate(_supervised(spark, sf).where(~F.col("is_test")), E1.feature_list(), "close", num_trees=20)


def ticker_gbt_forecast(spark, sf):
    """Backtest of each ticker's boosted trees."""
    scored, _ = trees.fit_boosted(_supervised(spark, sf), E1.feature_list(), rounds=20, max_depth=3)
    return forecast.backtest(scored, "GBT", 1, neutral="")


def forest_sweep(spark, sf):
    """Metrics of every ticker and horizon on the ticker's own ten features by its forest."""
    from panelcast.plans import experiments
    feat = feature_table(spark, sf)
    res, _ = experiments.forest_sweep(feat, clean.columns_except(feat, "close", ("ticker", "month")))
    return res


def _experiment_panel(spark, sf):
    feat = pipeline.experiment_features(testdata.prices(spark, sf), testdata.indicators(spark, sf), TEST_EXPERIMENTS)
    return feat, list(dict.fromkeys(f for e in TEST_EXPERIMENTS for f in e.feature_list()))


def experiment_models(spark, sf):
    """Metrics of every experiment, ticker, model and horizon."""
    feat, feats = _experiment_panel(spark, sf)
    bt = pipeline.model_backtests(feat, feats, (1, 3), runs=("experiment", "ticker"), rounds=10, max_depth=3)
    return metrics.regression_metrics(bt, ("experiment", *metrics.RUN_KEYS))


def asof_trades(spark, sf):
    """J3 on raw timestamps: every trade with the price of the last order at or
    before it, all orders being one series."""
    orders = testdata.table(spark, sf, "orders").select(F.col("o_orderdate").alias("ts"), F.col("o_orderkey").alias("last_order"),
                                                        F.col("o_totalprice").alias("last_price"))
    return align.asof_join(testdata.price_ticks(spark, sf), orders, "ts", ["last_order", "last_price"], tie=["last_order"])


def score_model_versions(spark, sf):
    """Each ticker's stored one-feature models of two versions, fitted on the
    first 60 % and 80 % of its rows, scored on the rows since."""
    import uuid

    from panelcast.plans import monitoring
    from panelcast.session import ensure_checkpoint_dir
    from panelcast.sources import sinks
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/model-versions-{uuid.uuid4().hex}"
    feat = feature_table(spark, sf)
    for version, test_size in ((1, 0.4), (2, 0.2)):
        sup = pipeline.supervised(feat, 1, test_size)
        starts = sup.where("is_test").groupBy("ticker").agg(F.min("month").alias("valid_from"))
        coef = forecast.fit_ols_single(sup, "close")
        monitoring.save_versions(monitoring.single_version(coef, "close", starts, "OLS", version), path)
    sup = pipeline.supervised(feat, 1)
    scored = monitoring.score_versions(sup, sinks.read_table(spark, path), ["close"])
    return scored.select("ticker", "month", "model", F.col("version").cast("int").alias("version"), "y", "predicted")


def experiment_linear_residuals(spark, sf):
    """G5 over all experiments and horizons: train residuals of the full feature
    lists have mean 0 and no correlation with a feature."""
    from panelcast.session import cut_lineage
    feat, feats = _experiment_panel(spark, sf)
    keys = ["experiment", "ticker", "horizon"]
    sup = cut_lineage(split.chrono_split(split.add_targets(feat, (1, 3), "close", keys[:2]), 0.2, key=keys))
    coef, stats = forecast.fit_ols(sup, feats, key=keys)
    train = forecast.predict_ols(sup, coef, stats, feats, key=keys).where(~F.col("is_test"))
    resid = F.col("y") - F.col("predicted")
    products = [F.abs(F.covar_pop(resid, F.col(f"`{f}`"))) / F.nullif(F.stddev_pop(f"`{f}`") * F.stddev_pop("y"), F.lit(0.0))
                for f in feats]
    out = train.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_train"), (F.abs(F.avg(resid)) / F.stddev_pop("y")).alias("mean"),
                                   F.coalesce(F.greatest(*products), F.lit(0.0)).alias("worst"))
    return out.select("experiment", "ticker", F.col("horizon").cast("int").alias("horizon"), "n_train",
                      round_half_even("mean", 6).alias("mean_residual"), round_half_even("worst", 6).alias("worst_correlation"))


QUERIES: dict[str, Query] = {f.__name__: f for f in (
    monthly_price_bars, monthly_indicator_mean, observations_json_flatten, numeric_coercion,
    first_per_month, duplicate_month_check, missing_series_report,
    forward_fill, back_fill, null_counts,
    align_inner, align_asof, wide_pivot, wide_unpivot,
    range_slice, drop_missing, prefix_split,
    lag_features, lead_target, moving_average, rolling_volatility,
    feature_table, feature_table_backfilled, lagged_comparison, correlation_matrix,
    chrono_split, train_scaler, target_scaling_roundtrip,
    ols_forecast, backtest_signals, signal_counts, buy_sell_markers,
    metrics_summary, top_models, bias_directional, bias_correction,
    horizon_grid, experiment_suite,
    ks_drift_statistic, ks_drift_statistic_monthly, ks_drift_test, ks_drift_flag, adf_lag0, adf_test, adf_short_lags, adf_autolag,
    multi_linear_forecast, gbt_forecast, rf_feature_importance, cv_folds, cv_r2, cv_ols_r2, ticker_top_features,
    universe_sweep,
    score_saved_model, streaming_monthly_bars, streaming_drift_updates,
    provider_json_flatten, traded_universe, wide_prices, feature_inputs, preview_bars, long_histories,
    latest_runs, sorted_metrics, feature_names, ticker_ranges, linear_residuals,
    tree_root_split, boosted_first_round, ticker_forest_importance, ticker_forest_cv, ticker_gbt_forecast, forest_sweep,
    experiment_models, experiment_linear_residuals, asof_trades, score_model_versions,
)}
