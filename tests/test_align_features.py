"""Alignment and window features, incl. a golden replay of the as-of +
back-filled lag / moving-average layout."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from panelcast.operators import align, features
from conftest import rows

D = dt.date


def _prices(spark, closes, ticker="T", start=(2024, 4)):
    y, m = start
    out = []
    for c in closes:
        out.append((ticker, D(y, m, 1), float(c), 100.0))
        y, m = (y + 1, 1) if m == 12 else (y, m + 1)
    return spark.createDataFrame(out, "ticker string, month date, close double, volume double")


# Golden fixture (small literal): a quarterly series and a monthly close.
# Raw quarterly observations and 14 month-end closes.
GDP_RAW = [("2023-07-01", 27711.45775), ("2023-10-01", 28034.355750000002),
           ("2024-01-01", 28358.41725), ("2024-04-01", 28766.068),
           ("2024-07-01", 29359.719666666668), ("2024-10-01", 29714.697),
           ("2025-01-01", 29977.632)]
CLOSE = [153.4775, 175.634, 171.2506, 177.9704, 200.696, 254.5943, 301.2038, 333.6147,
         328.4325, 372.5959, 334.9247, 305.0474, 370.5375, 474.583]
GOLDEN_GDP = [28766.068] * 3 + [29359.719666666668] * 3 + [29714.697] * 3 + [29977.632] * 5
GOLDEN_CLOSE_LAG1 = [153.4775] + CLOSE[:13]
GOLDEN_CLOSE_LAG3 = [153.4775] * 3 + CLOSE[:11]
GOLDEN_GDP_LAG6 = [28766.068] * 9 + [29359.719666666668] * 3 + [29714.697] * 2
GOLDEN_MA3_HEAD = [166.78736666666666, 166.78736666666666, 166.78736666666666, 174.95166666666668]
GOLDEN_MA12 = [259.12015] * 12 + [277.20848333333333, 302.1209]


def _gdp(spark):
    return spark.createDataFrame([("GDP", D.fromisoformat(d), v) for d, v in GDP_RAW],
                                 "series_id string, month date, value double")


def test_golden_asof_lags_and_backfilled_moving_averages(spark):
    p = _prices(spark, CLOSE).drop("volume")
    panel = align.align_asof(p, _gdp(spark), ["GDP"])
    ft = features.build_features(panel, "close", lag_cols=["GDP"], lags=(1, 3, 6), mas=(3, 12),
                                 volatility=False, lag_target=True, warmup="backfill")
    got = ft.orderBy("month").collect()
    assert len(got) == 14
    assert [r.GDP for r in got] == GOLDEN_GDP
    assert [r.close_lag1 for r in got] == GOLDEN_CLOSE_LAG1
    assert [r.close_lag3 for r in got] == GOLDEN_CLOSE_LAG3
    assert [r.GDP_lag6 for r in got] == GOLDEN_GDP_LAG6
    assert [r.close_ma3 for r in got[:4]] == pytest.approx(GOLDEN_MA3_HEAD, rel=1e-12)
    assert [r.close_ma12 for r in got] == pytest.approx(GOLDEN_MA12, rel=1e-12)


def test_short_series_has_all_null_ma12_after_backfill(spark):
    p = _prices(spark, CLOSE[:11])
    ft = features.build_features(p, "close", lag_cols=[], mas=(3, 12), volatility=False,
                                 warmup="backfill")
    assert all(r.close_ma12 is None for r in ft.collect())


def test_inner_alignment_drops_months_missing_an_indicator(spark):
    p = _prices(spark, [1, 2, 3, 4])
    ind = spark.createDataFrame([("X", D(2024, 4, 1), 10.0), ("X", D(2024, 5, 1), 11.0),
                                 ("X", D(2024, 6, 1), 12.0), ("Y", D(2024, 5, 1), 5.0),
                                 ("Y", D(2024, 6, 1), 6.0), ("Y", D(2024, 7, 1), 7.0)],
                                "series_id string, month date, value double")
    out = align.align_inner(p, ind, ["X", "Y"])
    assert rows(out, "month", "X", "Y") == [(D(2024, 5, 1), 11.0, 5.0), (D(2024, 6, 1), 12.0, 6.0)]


def test_absent_series_is_skipped_and_reported(spark):
    ind = spark.createDataFrame([("X", D(2024, 4, 1), 10.0)], "series_id string, month date, value double")
    assert align.present_series(ind, ["M2SL", "X"]) == ["X"]
    assert rows(align.missing_series(ind, ["M2SL", "X", "WTISPLC"])) == [("M2SL",), ("WTISPLC",)]


def test_wide_pivot_inner_and_unpivot(spark):
    p = _prices(spark, [1, 2, 3], "A").unionByName(_prices(spark, [5, 6], "B", (2024, 5)))
    wide = align.wide_by_entity(p, ["A", "B"])
    assert rows(wide) == [(D(2024, 5, 1), 2.0, 5.0), (D(2024, 6, 1), 3.0, 6.0)]
    long = align.wide_to_long(wide, ["month"], ["A", "B"], "ticker", "close")
    assert long.count() == 4


def test_lags_are_row_based_across_a_missing_month(spark):
    p = spark.createDataFrame([("T", D(2024, 1, 1), 1.0), ("T", D(2024, 2, 1), 2.0),
                               ("T", D(2024, 4, 1), 4.0)], "ticker string, month date, close double")
    w = features.panel_window()
    out = p.select("month", *features.lag_exprs(["close"], [1], w)).orderBy("month").collect()
    assert [r.close_lag1 for r in out] == [None, 1.0, 2.0]


def test_moving_average_needs_full_window_and_volatility(spark):
    p = _prices(spark, [3, 4, 5, 10])
    w = features.panel_window()
    out = p.select("month", features.moving_average_expr("close", 3, w),
                   features.volatility_expr("close", 3, w)).orderBy("month").collect()
    assert [r.close_ma3 for r in out] == [None, None, 4.0, pytest.approx(19 / 3)]
    assert out[2].close_volatility == 1.0
    assert out[3].close_volatility == pytest.approx(3.2145502536643185)
    assert out[0].close_volatility is None


def test_exact_mean_ignores_partitioning(spark):
    vals = [0.1, 0.2, 0.3, 1e6 + 0.01, 7.77, 0.05] * 50
    df = spark.createDataFrame([(i % 3, v) for i, v in enumerate(vals)], "g int, v double")
    from panelcast.functions.exact import exact_mean
    a = rows(df.groupBy("g").agg(exact_mean("v").alias("m")))
    b = rows(df.repartition(7).groupBy("g").agg(exact_mean("v").alias("m")))
    c = rows(df.coalesce(1).orderBy(F.desc("v")).groupBy("g").agg(exact_mean("v").alias("m")))
    assert a == b == c


def test_feature_table_drop_warmup(spark):
    p = _prices(spark, range(1, 21))
    ft = features.build_features(p, "close", lag_cols=["volume"], mas=(3, 12))
    assert ft.count() == 20 - 11
    assert {"close_ma3", "close_ma12", "close_volatility", "volume_lag6"} <= set(ft.columns)


def test_experiment_window_keeps_earlier_asof_value(spark):
    from panelcast.plans.pipeline import Experiment, align_frames
    p = _prices(spark, [1, 2, 3, 4, 5], start=(2024, 2))
    exp = Experiment("w", ("GDP",), align="asof", start="2024-04-01", end="2024-05-31")
    panel, ids = align_frames(p, _gdp(spark), exp)
    got = [(r.month, r.GDP) for r in panel.orderBy("month").collect()]
    assert ids == ["GDP"]
    assert got == [(D(2024, 4, 1), 28766.068), (D(2024, 5, 1), 28766.068)]
    inner = Experiment("w", ("GDP",), start="2024-04-01", end="2024-08-31")
    panel, _ = align_frames(p, _gdp(spark), inner)
    assert [r.month for r in panel.orderBy("month").collect()] == [D(2024, 4, 1)]


def test_exact_moments_treat_nan_as_missing(spark):
    from panelcast.functions.exact import exact_mean, exact_variance
    df = spark.createDataFrame([(1.0,), (float("nan"),), (3.0,), (None,)], "v double")
    r = df.agg(exact_mean("v").alias("m"), exact_variance("v").alias("s2")).first()
    assert r.m == 2.0 and r.s2 == 2.0


def test_exact_mean_keeps_small_and_large_values(spark):
    from panelcast.functions.exact import exact_mean
    df = spark.createDataFrame([("s", 0.00004), ("s", 0.00003), ("l", 2e14), ("l", 4e14)], "g string, v double")
    assert rows(df.groupBy("g").agg(exact_mean("v").alias("m"))) == [("l", 3e14), ("s", 0.000035)]


def test_shared_periods_equal_the_wide_inner_join(spark):
    p = spark.createDataFrame([("A", D(2020, 1, 1), 1.0), ("B", D(2020, 1, 1), 2.0), ("A", D(2020, 2, 1), 3.0),
                               ("A", D(2020, 3, 1), 4.0), ("B", D(2020, 3, 1), None)], "ticker string, month date, close double")
    assert rows(align.shared_periods(p), "ticker", "month", "close") == [("A", D(2020, 1, 1), 1.0), ("B", D(2020, 1, 1), 2.0)]
