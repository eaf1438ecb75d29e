"""Property tests: partition/order invariance, lag-lead identity, R2 <= 1,
exact recovery on noise-free data."""

import datetime as dt

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from panelcast.operators import features, forecast, metrics, split

D = dt.date

panels = st.lists(
    st.tuples(st.sampled_from(["A", "B", "C"]), st.integers(0, 30),
              st.integers(1, 10_000_000)),
    min_size=3, max_size=60, unique_by=lambda t: (t[0], t[1]))


def _df(spark, recs):
    return spark.createDataFrame(
        [(t, D(2000 + m // 12, m % 12 + 1, 1), c / 100.0, float(c % 97)) for t, m, c in recs],
        "ticker string, month date, close double, volume double")


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(panels, st.integers(1, 7))
def test_features_invariant_to_partitioning_and_order(spark, recs, nparts):
    df = _df(spark, recs)
    a = features.build_features(df, lag_cols=["volume"], mas=(3, 12), warmup="backfill")
    b = features.build_features(df.repartition(nparts).orderBy(F.rand(nparts)), lag_cols=["volume"],
                                mas=(3, 12), warmup="backfill")
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(panels, st.integers(1, 4))
def test_lag_of_lead_is_identity(spark, recs, h):
    df = _df(spark, recs)
    w = features.panel_window()
    led = df.select("ticker", "month", "close", F.lead("close", h).over(w).alias("ld"))
    back = led.select("ticker", "month", "close", F.lag("ld", h).over(w).alias("x"))
    for r in back.collect():
        assert r.x is None or r.x == r.close


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.floats(-1e3, 1e3), st.floats(-1e3, 1e3)), min_size=2, max_size=30))
def test_r2_at_most_one(spark, pairs):
    bt = spark.createDataFrame([("A", "M", 1, D(2020, 1, 1) + dt.timedelta(days=i), a, p)
                                for i, (a, p) in enumerate(pairs)],
                               "ticker string, model string, horizon int, date date, "
                               "actual double, predicted double")
    r2 = metrics.regression_metrics(bt, digits=None).first().r2
    assert r2 <= 1.0 + 1e-12


def test_noise_free_recovery_and_beats_mean(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(60, 3))
    y_exact = 2.0 + x @ np.array([1.0, -3.0, 0.5])
    y_noisy = y_exact + rng.normal(scale=0.5, size=60)
    for y, tol in ((y_exact, 1e-8), (y_noisy, None)):
        df = spark.createDataFrame([("A", i, *map(float, x[i]), float(y[i]), i >= 48) for i in range(60)],
                                   "ticker string, i int, a double, b double, c double, y double, "
                                   "is_test boolean")
        coef, stats = forecast.fit_ols(df, ["a", "b", "c"])
        pred = forecast.predict_ols(df, coef, stats, ["a", "b", "c"]).where("is_test")
        got = np.array([r.predicted for r in pred.orderBy("i").collect()])
        if tol:
            assert got == pytest.approx(y[48:], abs=tol)
        else:
            mse_model = np.mean((got - y[48:]) ** 2)
            mse_mean = np.mean((y[:48].mean() - y[48:]) ** 2)
            assert mse_model < mse_mean


def test_ticker_too_short_to_split_is_skipped(spark):
    df = spark.createDataFrame([("A", D(2000, m, 1), float(m), float(m + 1)) for m in range(1, 11)] +
                               [("B", D(2000, 1, 1), 5.0, 6.0)],
                               "ticker string, month date, close double, y double")
    sup = split.chrono_split(df)
    coef = forecast.fit_ols_single(sup, "close")
    assert [r.ticker for r in forecast.predict_single(sup, coef, "close").select("ticker").distinct().collect()] == ["A"]


months_st = st.sets(st.integers(0, 40), min_size=1, max_size=25)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(months_st, months_st, st.integers(0, 1000))
def test_asof_alignment_matches_brute_force(spark, price_months, obs_months, seed):
    from panelcast.operators import align
    to_d = lambda m: D(2000 + m // 12, m % 12 + 1, 1)
    obs = {m: float(seed + m) for m in obs_months}
    prices = spark.createDataFrame([("T", to_d(m), 1.0, 1.0) for m in sorted(price_months)],
                                   "ticker string, month date, close double, volume double")
    ind = spark.createDataFrame([("X", to_d(m), v) for m, v in obs.items()],
                                "series_id string, month date, value double")
    got = {r.month: r.X for r in align.align_asof(prices, ind, ["X"]).collect()}
    for m in price_months:
        earlier = [o for o in obs if o <= m]
        assert got[to_d(m)] == (obs[max(earlier)] if earlier else None)


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.one_of(st.none(), st.integers(1, 99)), min_size=1, max_size=30))
def test_fills_match_pandas(spark, vals):
    import pandas as pd
    from panelcast.operators import clean
    recs = [("T", D(2000 + i // 12, i % 12 + 1, 1), None if v is None else float(v)) for i, v in enumerate(vals)]
    df = spark.createDataFrame(recs, "ticker string, month date, v double")
    ff = [r.v for r in clean.forward_fill(df, ["ticker"], "month", ["v"]).orderBy("month").collect()]
    bf = [r.v for r in clean.back_fill(df, ["ticker"], "month", ["v"]).orderBy("month").collect()]
    s = pd.Series([None if v is None else float(v) for v in vals], dtype="float64")
    want_f = [None if pd.isna(x) else x for x in s.ffill()]
    want_b = [None if pd.isna(x) else x for x in s.bfill()]
    assert ff == want_f and bf == want_b
