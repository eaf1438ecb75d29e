import datetime as dt
import json

import pandas as pd

from panelcast.operators import align, forecast, metrics, split
from panelcast.sources import files, sinks
from conftest import rows

D = dt.date


def test_wide_prices_prefix_names(spark):
    p = spark.createDataFrame([("BTC-USD", D(2024, 1, 1), 1.5, 10.0), ("GLD", D(2024, 1, 1), 2.5, 20.0)],
                              "ticker string, month date, close double, volume double")
    w = align.wide_prices(p, ["BTC-USD", "GLD"])
    assert set(w.columns) == {"month", "BTC-USD_Close", "BTC-USD_Volume", "GLD_Close", "GLD_Volume"}
    r = w.first()
    assert r["BTC-USD_Close"] == 1.5 and r["GLD_Volume"] == 20.0


def test_latest_per_run_last_wins(spark):
    res = spark.createDataFrame([("A", "XGB", 1, 0.5), ("A", "XGB", 2, 0.7), ("A", "LR", 1, 0.1)],
                                "ticker string, model string, run_seq int, r2 double")
    assert rows(metrics.latest_per_run(res), "ticker", "model", "r2") == [("A", "LR", 0.1), ("A", "XGB", 0.7)]


def test_top_k_per_group_and_sort_table(spark):
    imp = spark.createDataFrame([("A", "f1", 0.1), ("A", "f2", 0.5), ("A", "f3", 0.5), ("B", "f1", 0.9)],
                                "ticker string, feature string, importance double")
    top = metrics.top_k_per_group(imp, 2, ["ticker"], "importance", ["feature"])
    assert rows(top, "ticker", "feature") == [("A", "f2"), ("A", "f3"), ("B", "f1")]
    srt = metrics.sort_table(imp, ["ticker", "importance", "feature"], [True, False, True]).collect()
    assert [(r.ticker, r.feature) for r in srt] == [("A", "f2"), ("A", "f3"), ("A", "f1"), ("B", "f1")]


def test_apply_per_ticker_and_min_rows(spark):
    df = spark.createDataFrame([("A", 1.0), ("A", 3.0), ("B", 5.0)], "ticker string, v double")

    def demean(pdf: pd.DataFrame) -> pd.DataFrame:
        return pdf.assign(v=pdf.v - pdf.v.mean())

    out = forecast.apply_per_ticker(df, demean, "ticker string, v double")
    assert rows(out) == [("A", -1.0), ("A", 1.0), ("B", 0.0)]
    assert rows(split.min_rows(df, 2), "ticker") == [("A",), ("A",)]


def test_flatten_observations_text_column(spark):
    doc = json.dumps({"observations": [{"date": "2020-01-01", "value": "3.5"},
                                       {"date": "2020-02-01", "value": "."}]})
    df = spark.createDataFrame([("M2SL", doc)], "series_id string, body string")
    out = files.flatten_observations(df, "body")
    assert rows(out) == [("M2SL", D(2020, 1, 1), 3.5), ("M2SL", D(2020, 2, 1), None)]


def test_log_metrics_table(spark, tmp_path):
    m = spark.createDataFrame([("A_OLS", 1.25, 0.5)], "run_name string, rmse double, r2 double")
    path = sinks.log_metrics_table(m, str(tmp_path))
    got = rows(spark.read.parquet(path), "run_name", "kind", "key", "value")
    assert got == [("A_OLS", "metric", "r2", "0.5"), ("A_OLS", "metric", "rmse", "1.25")]


def test_backtest_sink_rerun_replaces_only_its_partitions(spark, tmp_path):
    def bt(model, v):
        return spark.createDataFrame([("A", model, 1, D(2020, 1, 1), v, v, v, "Hold")],
                                     "ticker string, model string, horizon int, date date, actual double, "
                                     "predicted double, current_price double, signal string")
    root = str(tmp_path)
    sinks.save_backtest(bt("OLS", 1.0), root)
    sinks.save_backtest(bt("GBT", 2.0), root)
    sinks.save_backtest(bt("OLS", 3.0), root)      # re-run of OLS
    got = rows(spark.read.parquet(f"{root}/backtest"), "model", "actual")
    assert got == [("GBT", 2.0), ("OLS", 3.0)]


def test_experiment_feature_list_layout():
    from panelcast.plans.experiments import REFERENCE_EXPERIMENTS
    from panelcast.plans.pipeline import Experiment
    e = Experiment("x", ("USSLIND", "M2SL"))
    assert e.feature_list() == ["close_ma3", "close_ma12", "volume_lag1", "close_volatility",
                                "USSLIND", "USSLIND_lag1", "USSLIND_lag3", "USSLIND_lag6",
                                "M2SL", "M2SL_lag1", "M2SL_lag3", "M2SL_lag6"]
    g = Experiment("g", ("GDP",), lag_volume=False, volatility=False)
    assert g.feature_list() == ["close_ma3", "close_ma12", "GDP", "GDP_lag1", "GDP_lag3", "GDP_lag6"]
    assert all(x.start == "2010-01-01" and x.end == "2025-04-30" for x in REFERENCE_EXPERIMENTS)
    assert len({x.name for x in REFERENCE_EXPERIMENTS}) == len(REFERENCE_EXPERIMENTS)
