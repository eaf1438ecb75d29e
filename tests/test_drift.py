import datetime as dt
import itertools
import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pyspark.sql import functions as F

from panelcast.functions import stats
from panelcast.operators import drift

D = dt.date


def ks_d(a, b):
    a, b = np.sort(a), np.sort(b)
    vals = np.concatenate([a, b])
    fa = np.searchsorted(a, vals, side="right") / len(a)
    fb = np.searchsorted(b, vals, side="right") / len(b)
    return float(np.max(np.abs(fa - fb)))


def brute_p(d, m, n):
    """P(D >= d) by enumerating every interleaving of m + n distinct values."""
    hits = total = 0
    for pos in itertools.combinations(range(m + n), m):
        s = set(pos)
        i = j = 0
        worst = 0.0
        for k in range(m + n):
            if k in s:
                i += 1
            else:
                j += 1
            worst = max(worst, abs(i / m - j / n))
        total += 1
        hits += worst >= d - 1e-12
    return hits / total


@pytest.mark.parametrize("m,n", [(1, 1), (2, 3), (3, 3), (4, 6), (5, 4), (6, 6)])
def test_exact_p_matches_enumeration(m, n):
    ds = sorted({abs(i / m - j / n) for i in range(m + 1) for j in range(n + 1)} - {0.0})
    for d in ds:
        p = stats.ks_exact_pvalue(d, m, n)
        assert p == pytest.approx(brute_p(d, m, n), abs=1e-12)


def _p(spark, x):
    return spark.range(1).select(drift.kolmogorov_p(F.lit(float(x))).alias("p")).first().p


def test_asymptotic_p_is_the_kolmogorov_law(spark):
    assert _p(spark, 0.0) == 1.0 and _p(spark, 0.05) == 1.0
    # published critical values
    for x, alpha in ((1.2238478702, 0.10), (1.3580986393, 0.05), (1.6276236115, 0.01), (0.8275735552, 0.5)):
        assert _p(spark, x) == pytest.approx(alpha, abs=1e-9)
    assert _p(spark, 0.9999999) == pytest.approx(_p(spark, 1.0000001), abs=1e-6)
    assert 0.0 <= _p(spark, 12.0) < 1e-100


def test_method_is_the_callers_choice(spark):
    obs = {"S": [(D(2024, 1, 1 + k % 28), float(k % 17)) for k in range(400)]}
    df = _daily(spark, obs)
    got = {m: drift.ks_drift(df, "series_id", "day", "value", "2024-01-20", window_days=9, method=m).first()
           for m in ("exact", "asymp")}
    assert [got[m].method for m in got] == ["exact", "asymp"]
    assert got["exact"].p_value == pytest.approx(got["asymp"].p_value, abs=0.05)
    with pytest.raises(ValueError):
        drift.ks_drift(df, "series_id", "day", "value", "2024-01-20", window_days=9, method="auto")


def test_current_window_ends_at_the_latest_date_even_if_missing(spark):
    rows = [(D(2023, m, 1), float(m)) for m in range(1, 13)] + [(D(2024, m, 1), None) for m in range(1, 7)]
    r = drift.ks_statistic(_daily(spark, {"S": rows}), "series_id", "day", "value", "2023-06-30", window_months=12).first()
    assert (r.n_ref, r.n_cur) == (6, 6)


@pytest.mark.parametrize("level", [1e6, 1e8])
def test_adf_is_the_same_at_any_level(spark, level):
    rng = np.random.default_rng(3)
    y = np.cumsum(rng.normal(size=60)) * 0.5
    def run(shift):
        df = spark.createDataFrame([("A", D(2015 + k // 12, k % 12 + 1, 1), float(v + shift)) for k, v in enumerate(y)],
                                   "ticker string, month date, close double")
        return drift.adf(df).first()
    base, far = run(0.0), run(level)
    assert far.used_lag == base.used_lag and far.stationary == base.stationary
    assert far.adf_stat == pytest.approx(base.adf_stat, rel=1e-6)


def _daily(spark, series):
    recs = []
    for sid, pairs in series.items():
        for day, v in pairs:
            recs.append((sid, day, v))
    return spark.createDataFrame(recs, "series_id string, day date, value double")


def _run(spark, series, ref_end, days=None, months=12, min_current=6):
    df = _daily(spark, series)
    return {r.series_id: r for r in drift.ks_drift(df, "series_id", "day", "value", ref_end,
                                                   window_months=months, window_days=days,
                                                   min_current=min_current, buckets=4).collect()}


def test_ks_statistic_matches_direct_ecdf_with_ties_and_overlap(spark):
    rng = np.random.default_rng(3)
    vals = np.round(rng.normal(size=60), 1)  # many ties
    pairs = [(D(2024, 1, 1) + dt.timedelta(days=i // 2), float(v)) for i, v in enumerate(vals)]
    out = _run(spark, {"S": pairs}, "2024-01-20", days=15)
    last = max(d for d, _ in pairs)
    ref = [v for d, v in pairs if d <= D(2024, 1, 20)]
    cur = [v for d, v in pairs if d >= last - dt.timedelta(days=14)]
    assert out["S"].n_ref == len(ref) and out["S"].n_cur == len(cur)
    assert out["S"].ks_statistic == pytest.approx(ks_d(np.array(ref), np.array(cur)), abs=1e-15)


def test_identical_and_disjoint_samples(spark):
    same = [(D(2024, 1, d), float(d % 5)) for d in range(1, 31)]
    out = _run(spark, {"S": same}, "2024-01-31", days=30)
    assert out["S"].ks_statistic == 0.0 and out["S"].p_value == 1.0 and not out["S"].drift_detected
    disjoint = [(D(2024, 1, d), float(d)) for d in range(1, 31)]
    out = _run(spark, {"S": disjoint}, "2024-01-20", days=10)
    assert out["S"].ks_statistic == 1.0 and out["S"].drift_detected


def test_too_few_current_rows_gives_null(spark):
    five = [(D(2024, 1, d), float(d)) for d in range(1, 26)]
    out = _run(spark, {"S": five}, "2024-01-20", days=5)
    assert out["S"].n_cur == 5 and out["S"].ks_statistic is None
    assert out["S"].p_value is None and out["S"].drift_detected is False
    six = _run(spark, {"S": five}, "2024-01-20", days=6)
    assert six["S"].ks_statistic is not None


@settings(max_examples=25, deadline=None)
@given(st.lists(st.integers(-5, 5), min_size=1, max_size=30),
       st.lists(st.integers(-5, 5), min_size=1, max_size=30))
def test_ks_d_properties(a, b):
    d1, d2 = ks_d(np.array(a), np.array(b)), ks_d(np.array(b), np.array(a))
    assert d1 == d2 and 0.0 <= d1 <= 1.0
    p = stats.ks_exact_pvalue(d1, len(a), len(b))
    assert 0.0 <= p <= 1.0


def test_adf_lag0_matches_numpy_ols(spark):
    rng = np.random.default_rng(11)
    y = np.round(100 + np.cumsum(rng.normal(size=40)), 2)
    df = spark.createDataFrame([("A", D(2000 + i // 12, i % 12 + 1, 1), float(v)) for i, v in enumerate(y)],
                               "ticker string, month date, close double")
    r = drift.adf_test(df).first()
    x, dy = y[:-1], np.diff(y)
    X = np.column_stack([x, np.ones_like(x)])
    beta, res, *_ = np.linalg.lstsq(X, dy, rcond=None)
    resid = dy - X @ beta
    s2 = resid @ resid / (len(dy) - 2)
    se = math.sqrt(s2 * np.linalg.inv(X.T @ X)[0, 0])
    assert r.adf_stat == pytest.approx(beta[0] / se, rel=1e-7)
    assert 0.0 <= r.p_value <= 1.0


def test_mackinnon_p_is_monotone_and_near_known_quantiles():
    # asymptotic 5% critical value for the constant-only case is about -2.86
    assert stats.adf_pvalue(-2.86) == pytest.approx(0.05, abs=0.01)
    assert stats.adf_pvalue(-3.43) == pytest.approx(0.01, abs=0.005)
    ps = [stats.adf_pvalue(t) for t in np.linspace(-6, 2, 50)]
    assert all(a <= b + 1e-12 for a, b in zip(ps, ps[1:]))


def _adf_reference(x, maxlag=None):
    """The documented ADF procedure (constant, AIC lag choice on a common
    sample, refit on the chosen lag's own sample) written with numpy."""
    x = np.asarray(x, dtype=float)
    n_all = len(x)
    if maxlag is None:
        maxlag = max(0, min(n_all // 2 - 2, int(math.ceil(12 * (n_all / 100) ** 0.25))))
    dx = np.diff(x)

    def fit(p, start):
        i = np.arange(start, len(dx))
        X = np.column_stack([x[i]] + [dx[i - j] for j in range(1, p + 1)] + [np.ones(len(i))])
        y = dx[i]
        beta = np.linalg.lstsq(X, y, rcond=None)[0]
        ssr = float(((y - X @ beta) ** 2).sum())
        n, k = len(i), X.shape[1]
        aic = -2 * (-n / 2 * (np.log(2 * np.pi) + np.log(ssr / n) + 1)) + 2 * k
        t = beta[0] / math.sqrt(ssr / (n - k) * np.linalg.inv(X.T @ X)[0, 0])
        return aic, t, n

    best = min((fit(p, maxlag)[0], p) for p in range(maxlag + 1))[1]
    _, t, n = fit(best, best)
    return t, best, n


@pytest.mark.parametrize("seed,phi", [(1, 0.5), (2, 0.95), (5, 0.2)])
def test_adf_autolag_matches_reference_procedure(spark, seed, phi):
    rng = np.random.default_rng(seed)
    e = rng.normal(size=90)
    y = np.zeros(90)
    for i in range(1, 90):
        y[i] = phi * y[i - 1] + e[i] + 0.4 * e[i - 1]
    y = np.round(50 + y, 4)
    recs = [("A", D(2000 + i // 12, i % 12 + 1, 1), float(v)) for i, v in enumerate(y)]
    recs += [("B", D(2000 + i // 12, i % 12 + 1, 1), float(v)) for i, v in enumerate(y[:40])]
    df = spark.createDataFrame(recs, "ticker string, month date, close double")
    got = {r.ticker: r for r in drift.adf(df).collect()}
    for tk, series in (("A", y), ("B", y[:40])):
        t, lag, n = _adf_reference(series)
        assert got[tk].used_lag == lag
        assert got[tk].nobs == n
        assert got[tk].adf_stat == pytest.approx(t, rel=1e-6)
        assert got[tk].crit_5pct < got[tk].crit_10pct


def test_adf_fixed_lag_without_autolag(spark):
    rng = np.random.default_rng(9)
    y = np.round(100 + np.cumsum(rng.normal(size=60)), 3)
    df = spark.createDataFrame([("A", D(2000 + i // 12, i % 12 + 1, 1), float(v)) for i, v in enumerate(y)],
                               "ticker string, month date, close double")
    r = drift.adf(df, max_lag=2, autolag=None).first()
    x, dx = y, np.diff(y)
    i = np.arange(2, len(dx))
    X = np.column_stack([x[i], dx[i - 1], dx[i - 2], np.ones(len(i))])
    beta = np.linalg.lstsq(X, dx[i], rcond=None)[0]
    ssr = ((dx[i] - X @ beta) ** 2).sum()
    t = beta[0] / math.sqrt(ssr / (len(i) - 4) * np.linalg.inv(X.T @ X)[0, 0])
    assert r.used_lag == 2 and r.adf_stat == pytest.approx(t, rel=1e-6)


@pytest.mark.parametrize("buckets", [1, 4, (3, 3), (5, 7)])
def test_ks_statistic_bucketing_never_changes_d(spark, buckets):
    rng = np.random.default_rng(21)
    vals = np.round(rng.gamma(2.0, size=200), 2)
    pairs = [(D(2024, 1, 1) + dt.timedelta(days=i // 7), float(v)) for i, v in enumerate(vals)]
    df = _daily(spark, {"S": pairs, "T": pairs[:50]})
    got = {r.series_id: r.ks_statistic for r in drift.ks_statistic(
        df, "series_id", "day", "value", "2024-01-15", window_days=10, buckets=buckets).collect()}
    for sid, ps in (("S", pairs), ("T", pairs[:50])):
        last = max(d for d, _ in ps)
        ref = np.array([v for d, v in ps if d <= D(2024, 1, 15)])
        cur = np.array([v for d, v in ps if d >= last - dt.timedelta(days=9)])
        assert got[sid] == pytest.approx(ks_d(ref, cur), abs=1e-15)


def test_nan_values_are_dropped_like_missing(spark):
    base = [(D(2024, 1, d), float(d % 4)) for d in range(1, 31)]
    with_nan = base + [(D(2024, 1, 30), float("nan")), (D(2024, 1, 5), float("nan"))]
    a = _run(spark, {"S": base}, "2024-01-20", days=10)["S"]
    b = _run(spark, {"S": with_nan}, "2024-01-20", days=10)["S"]
    assert (a.n_ref, a.n_cur, a.ks_statistic) == (b.n_ref, b.n_cur, b.ks_statistic)


def test_adf_p_value_equals_the_python_form(spark):
    xs = [-20.0, -11.3, -4.2, -2.9, -1.61, -1.6, 0.0, 1.5, 2.8]
    df = spark.createDataFrame([(x,) for x in xs] + [(None,)], "x double")
    got = [r.p for r in df.select(drift.adf_p_value(F.col("x")).alias("p")).collect()]
    assert got[-1] is None
    assert got[:-1] == [pytest.approx(stats.adf_pvalue(x), abs=1e-12) for x in xs]
