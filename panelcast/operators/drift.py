"""Distribution drift (two-sample KS) and unit-root (ADF) tests, per series.

KS statistic, fully distributed:

1. tag each observation as reference and/or current window (the windows may
   overlap; an overlapping row counts in both samples);
2. count rows per (series, distinct value) -> ties are grouped first;
3. cumulative counts over values via a two-level prefix sum: values are cut
   into quantile buckets per series, bucket totals get a prefix offset (a
   window over a handful of rows per series), and running sums inside each
   (series, bucket) partition add that offset. No task ever holds a whole
   series, so a series with a third of all rows is spread over many tasks;
4. D = max |F_ref - F_cur| per series.

The p-value is a short series on the JVM for ``method="asymp"``; only
``method="exact"``, meant for monthly calendars, computes it in Python, from
the per-series result row (D, n1, n2). The caller chooses; size doesn't.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, LongType, StructField, StructType

from panelcast.functions import stats
from panelcast.functions.exact import exact_comoment
from panelcast.functions.numeric import nan_to_null
from panelcast.operators.matrices import key_matrices
from panelcast.session import cut_lineage


def _latest_join(df: DataFrame, key: str, date: str) -> DataFrame:
    # per-series max date as a grouped aggregate joined back: avoids a window
    # over the raw (unbounded) series partition
    latest = df.groupBy(key).agg(F.max(date).alias("_latest"))
    return df.join(latest, on=key, how="inner")


def tag_samples(df: DataFrame, key: str, date: str, value: str, reference_end,
                window_months: int | None = 12, window_days: int | None = None) -> DataFrame:
    """(key, value, c_ref, c_cur) per observation; NULL and NaN are dropped.

    The current window ends at the series' latest date, also where the value
    there is missing.
    """
    d = _latest_join(df, key, date).withColumn(value, nan_to_null(value)).where(F.col(value).isNotNull())
    if window_days is not None:
        start = F.date_sub(F.col("_latest"), window_days - 1)
    else:
        start = F.add_months(F.col("_latest"), -(window_months - 1))
    in_ref = F.col(date) <= F.lit(reference_end).cast("date")
    in_cur = (F.col(date) >= start) & (F.col(date) <= F.col("_latest"))
    return d.select(key, F.col(value).alias("v"),
                    in_ref.cast("long").alias("c_ref"), in_cur.cast("long").alias("c_cur"))


def _quantile_bucket(df: DataFrame, keys: list[str], value: str, n: int, out: str) -> DataFrame:
    """Attach ``out`` = index of the value among n-quantile cut points of its
    ``keys`` group (cut points from a mergeable sketch, joined back)."""
    if n <= 1:
        return df.withColumn(out, F.lit(0))
    probs = [i / n for i in range(1, n)]
    cuts = df.groupBy(*keys).agg(F.percentile_approx(value, probs, 10000).alias(f"_c_{out}"))
    return (df.join(cuts, on=keys, how="inner")
              .withColumn(out, F.size(F.filter(f"_c_{out}", lambda c: c < F.col(value))))
              .drop(f"_c_{out}"))


def ks_statistic(df: DataFrame, key: str, date: str, value: str, reference_end,
                 window_months: int | None = 12, window_days: int | None = None,
                 buckets: int | tuple[int, int] = (64, 64)) -> DataFrame:
    """(key, n_ref, n_cur, ks_statistic) per series.

    ``buckets`` = (coarse, fine): values are cut into coarse quantile buckets
    per series, and each coarse bucket again into fine ones (64 x 64 = 4096
    buckets per series by default, ~128 comparisons per row). Running sums
    then run per (series, bucket), so even a series holding a large share of
    all rows spreads over thousands of window partitions.
    """
    coarse, fine = (buckets, 1) if isinstance(buckets, int) else buckets
    tagged = tag_samples(df, key, date, value, reference_end, window_months, window_days)
    # read by both levels of cut points, the totals and the running sums
    counts = cut_lineage(tagged.groupBy(key, "v")
                         .agg(F.sum("c_ref").alias("c_ref"), F.sum("c_cur").alias("c_cur"))
                         .where((F.col("c_ref") > 0) | (F.col("c_cur") > 0)))
    totals = counts.groupBy(key).agg(F.sum("c_ref").alias("n_ref"), F.sum("c_cur").alias("n_cur"))
    b = _quantile_bucket(counts, [key], "v", coarse, "_b1")
    if fine > 1:
        b = _quantile_bucket(b, [key, "_b1"], "v", fine, "_b2")
        b = b.withColumn("bucket", F.col("_b1") * fine + F.col("_b2")).drop("_b1", "_b2")
    else:
        b = b.withColumnRenamed("_b1", "bucket")
    tot = b.groupBy(key, "bucket").agg(F.sum("c_ref").alias("t_ref"),
                                       F.sum("c_cur").alias("t_cur"))
    wb = Window.partitionBy(key).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offs = tot.select(key, "bucket",
                      F.coalesce(F.sum("t_ref").over(wb), F.lit(0)).alias("o_ref"),
                      F.coalesce(F.sum("t_cur").over(wb), F.lit(0)).alias("o_cur"))
    wv = (Window.partitionBy(key, "bucket").orderBy("v")
                .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    cum = b.join(offs, on=[key, "bucket"], how="inner").select(
        key,
        (F.sum("c_ref").over(wv) + F.col("o_ref")).alias("cum_ref"),
        (F.sum("c_cur").over(wv) + F.col("o_cur")).alias("cum_cur"))
    cum = cum.join(totals, on=key, how="inner")
    gap = F.abs(F.try_divide(F.col("cum_ref").cast("double"), F.col("n_ref").cast("double"))
                - F.try_divide(F.col("cum_cur").cast("double"), F.col("n_cur").cast("double")))
    return cum.groupBy(key).agg(F.first("n_ref").alias("n_ref"), F.first("n_cur").alias("n_cur"),
                                F.max(gap).alias("ks_statistic"))


@F.pandas_udf(DoubleType())
def _ks_exact_p(d: pd.Series, n1: pd.Series, n2: pd.Series) -> pd.Series:
    return pd.Series([stats.ks_exact_pvalue(float(a), int(b), int(c)) if pd.notna(a) else None
                      for a, b, c in zip(d, n1, n2)], dtype="float64")


def kolmogorov_p(x: Column, terms: int = 20) -> Column:
    """P(K > x) of the Kolmogorov distribution, JVM-side: the theta form below
    1, the alternating series from 1 on (20 terms are exact to double)."""
    ks = F.sequence(F.lit(1), F.lit(terms))
    low = F.aggregate(ks, F.lit(0.0), lambda acc, k: acc + F.exp(
        -((2 * k - 1) * (2 * k - 1)) * F.pi() * F.pi() / (8 * x * x)))
    high = F.aggregate(ks, F.lit(0.0), lambda acc, k: acc + F.when(k % 2 == 1, 1.0).otherwise(-1.0)
                       * F.exp(-2.0 * k * k * x * x))
    p = F.when(x <= 0, F.lit(1.0)).when(x < 1, 1 - F.sqrt(2 * F.pi()) / x * low).otherwise(2 * high)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), p))


def ks_p_value(d: Column, n1: Column, n2: Column, method: str) -> Column:
    """Two-sided p-value of the two-sample statistic: ``asymp`` by the limiting
    distribution at sqrt(n1 n2 / (n1 + n2)) d, ``exact`` by lattice paths."""
    if method == "exact":
        return _ks_exact_p(d, n1, n2)
    if method != "asymp":
        raise ValueError(f"method is 'exact' or 'asymp', not {method!r}")
    return kolmogorov_p(F.sqrt(F.try_divide(n1.cast("double") * n2, n1 + n2)) * d)


def ks_drift(df: DataFrame, key: str, date: str, value: str, reference_end="2024-12-31",
             window_months: int | None = 12, window_days: int | None = None,
             threshold: float = 0.05, min_current: int = 6, method: str = "exact",
             buckets: int | tuple[int, int] = (64, 64)) -> DataFrame:
    """(key, n_ref, n_cur, ks_statistic, p_value, method, drift_detected).

    Fewer than ``min_current`` current rows (or an empty reference sample)
    -> NULL statistic and p-value, drift_detected = false. Drift is p < threshold.
    ``method`` is ``exact`` for monthly series and ``asymp`` for raw events,
    whose sample sizes the lattice of the exact form (n1 x n2) doesn't suit.
    """
    d = ks_statistic(df, key, date, value, reference_end, window_months, window_days, buckets)
    valid = (F.col("n_cur") >= min_current) & (F.col("n_ref") > 0)
    out = d.select(key, "n_ref", "n_cur", F.when(valid, F.col("ks_statistic")).alias("ks_statistic"))
    out = out.withColumn("p_value", ks_p_value(F.col("ks_statistic"), F.col("n_ref"), F.col("n_cur"), method))
    return out.select(key, "n_ref", "n_cur", "ks_statistic", "p_value",
                      F.when(F.col("ks_statistic").isNull(), F.lit("none")).otherwise(F.lit(method)).alias("method"),
                      F.coalesce(F.col("p_value") < threshold, F.lit(False)).alias("drift_detected"))


# ---------------------------------------------------------------------------
# ADF
# ---------------------------------------------------------------------------


def adf_lag0(df: DataFrame, value: str = "close", key: str = "ticker", order: str = "month",
             scale: int = 4) -> DataFrame:
    """G13 (no augmentation lags): regress dy_t on a constant and y_{t-1};
    the statistic is the t-value of the y_{t-1} coefficient.

    Built from exact co-moments per key (one grouped aggregation).
    """
    w = Window.partitionBy(key).orderBy(order)
    prev = F.lag(value, 1).over(w)
    pairs = df.select(key, prev.alias("x"), (F.col(value) - prev).alias("dy")).where(
        F.col("x").isNotNull())
    g = pairs.groupBy(key).agg(
        F.count(F.lit(1)).alias("n"),
        exact_comoment("x", "dy", scale).cast("double").alias("sxy"),
        exact_comoment("x", "x", scale).cast("double").alias("sxx"),
        exact_comoment("dy", "dy", scale).cast("double").alias("syy"))
    n = F.col("n").cast("double")
    slope = F.try_divide(F.col("sxy"), F.col("sxx"))
    ssr = F.try_divide(F.col("syy") - F.col("sxy") * F.col("sxy") / F.col("sxx"), n)
    se = F.sqrt(F.try_divide(F.try_divide(ssr, n - 2), F.try_divide(F.col("sxx"), n)))
    return g.select(key, "n", slope.alias("gamma"), F.try_divide(slope, se).alias("adf_stat"))


def normal_p(z: Column, terms: int = 200) -> Column:
    """P(Z <= z) of the normal law, JVM-side, by the series of its integral
    around 0 (absolute error about 1e-15 for |z| up to 12)."""
    def step(acc, k):
        term = acc["term"] * z * z / (2 * k + 1)
        return F.struct(term.alias("term"), (acc["total"] + term).alias("total"))

    first = F.struct(z.alias("term"), z.alias("total"))
    total = F.aggregate(F.sequence(F.lit(1), F.lit(terms)), first, step)["total"]
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), 0.5 + total * F.exp(-z * z / 2) / F.sqrt(2 * F.pi())))


def adf_p_value(stat: Column) -> Column:
    """MacKinnon's approximate p-value of an ADF t statistic (constant)."""
    def poly(coef):
        out = F.lit(float(coef[-1]))
        for c in coef[-2::-1]:
            out = out * stat + F.lit(float(c))
        return out

    z = F.when(stat <= stats.ADF_C_TAU_STAR, poly(stats.ADF_C_SMALLP)).otherwise(poly(stats.ADF_C_LARGEP))
    return (F.when(stat > stats.ADF_C_TAU_MAX, F.lit(1.0)).when(stat < stats.ADF_C_TAU_MIN, F.lit(0.0))
            .when(stat.isNotNull(), normal_p(z)))


def adf_test(df: DataFrame, value: str = "close", key: str = "ticker", order: str = "month",
             alpha: float = 0.05) -> DataFrame:
    """G13 with MacKinnon p-value and the ``p < alpha => stationary`` verdict."""
    res = adf_lag0(df, value, key, order)
    return (res.withColumn("p_value", adf_p_value(F.col("adf_stat")))
               .withColumn("stationary", F.coalesce(F.col("p_value") < alpha, F.lit(False))))


# ---------------------------------------------------------------------------
# ADF with augmentation lags and AIC lag selection
# ---------------------------------------------------------------------------


def _adf_frame(df: DataFrame, value: str, key: str, order: str, max_lag: int | None):
    """Per key: t (1-based), y_{t-1}, dy_t and dy lags 1..M, with the key's
    maximum lag; M is the largest maximum lag over keys (one scalar)."""
    from panelcast.functions.stats import adf_default_maxlag
    base = df.select(key, order, value).where(F.col(value).isNotNull())
    w = Window.partitionBy(key).orderBy(order)
    n = F.count(F.lit(1)).over(Window.partitionBy(key))
    if max_lag is None:
        cap = F.least(F.floor(n / 2) - 2,
                      F.ceil(F.lit(12.0) * F.pow(n.cast("double") / 100.0, 0.25)))
        ml = F.greatest(cap, F.lit(0)).cast("int")
    else:
        ml = F.lit(int(max_lag))
    # the level is taken off: the constant absorbs it, and products of values
    # far from zero would lose the digits that the statistic needs
    level = F.avg(value).over(Window.partitionBy(key))
    framed = base.select(key, order, value, F.row_number().over(w).alias("t"),
                         n.alias("n_total"), ml.alias("max_lag"),
                         (F.lag(value, 1).over(w) - level).alias("ylag"),
                         (F.col(value) - F.lag(value, 1).over(w)).alias("dy"))
    if max_lag is None:
        big = framed.agg(F.max("n_total")).first()[0] or 0  # one number
        m = adf_default_maxlag(int(big))
    else:
        m = int(max_lag)
    w2 = Window.partitionBy(key).orderBy(order)
    framed = framed.select("*", *[F.lag("dy", j).over(w2).alias(f"dl{j}") for j in range(1, m + 1)])
    return framed, m


def adf(df: DataFrame, value: str = "close", key: str = "ticker", order: str = "month",
        max_lag: int | None = None, autolag: str | None = "aic", alpha: float = 0.05) -> DataFrame:
    """Augmented Dickey-Fuller test with a constant, per key.

    Regress dy_t on [1, y_{t-1}, dy_{t-1} .. dy_{t-p}]; the statistic is the
    t-value of y_{t-1}. With ``autolag='aic'`` every p in 0..max_lag is fitted
    on the common sample (rows with all max_lag lags) and the smallest AIC
    wins; one factor in lag order gives the residuals of every p; the chosen p is then refitted on its own sample. Default max_lag is
    ceil(12 (n/100)^(1/4)) capped at n//2 - 2.

    Two passes fold the rows into a moment matrix per key; the small solves
    run on one row per key.
    """
    from panelcast.functions.stats import adf_critical_values, adf_pvalue, nested_ssr, ols_centered
    framed, m = _adf_frame(df, value, key, order, max_lag)
    lags = [f"dl{j}" for j in range(1, m + 1)]
    cols = ["ylag", *lags, "dy"]
    k = len(cols)
    key_type = df.schema[key].dataType

    def zeroed(limit: Column):
        # lags beyond the key's own lag order are unused: 0 instead of NULL
        return [F.when(F.lit(j) <= limit, F.col(f"dl{j}")).otherwise(F.lit(0.0)).alias(f"dl{j}")
                for j in range(1, m + 1)]

    if autolag:
        common = framed.where(F.col("t") >= F.col("max_lag") + 2).select(
            key, "ylag", *zeroed(F.col("max_lag")), "dy", "max_lag")
        mom = key_matrices(common, [key, "max_lag"], cols)

        def choose(batches):
            for pdf in batches:
                best, ic = [], []
                for raw, ml in zip(pdf["m"], pdf["max_lag"]):
                    total = np.frombuffer(raw).reshape(k + 2, k)
                    n, cand = total[0, 0], []
                    for p, ssr in enumerate(nested_ssr(total[2:])[: int(ml) + 1]):
                        if ssr <= 0:  # perfect fit: the criterion is -inf
                            cand.append((-np.inf, p))
                            continue
                        llf = -n / 2.0 * (np.log(2 * np.pi) + np.log(ssr / n) + 1.0)
                        cand.append((-2.0 * llf + 2.0 * (p + 2), p))
                    a, p = min(cand)
                    best.append(p)
                    ic.append(float(a))
                yield pd.DataFrame({key: pdf[key], "used_lag": best, "ic_best": ic})
        chosen = mom.mapInPandas(choose, StructType([
            StructField(key, key_type), StructField("used_lag", IntegerType()),
            StructField("ic_best", DoubleType())]))
    else:
        chosen = framed.groupBy(key).agg(F.first("max_lag").alias("used_lag"),
                                         F.lit(None).cast("double").alias("ic_best"))

    own = framed.join(chosen, on=key, how="inner").where(F.col("t") >= F.col("used_lag") + 2)
    own = own.select(key, "ylag", *zeroed(F.col("used_lag")), "dy", "used_lag", "ic_best")
    mom2 = key_matrices(own, [key, "used_lag", "ic_best"], cols)

    def fit(batches):
        for pdf in batches:
            nobs, stat, pval, c1, c5, c10 = [], [], [], [], [], []
            for raw, p in zip(pdf["m"], pdf["used_lag"]):
                total, p = np.frombuffer(raw).reshape(k + 2, k), int(p)
                n = total[0, 0]
                nobs.append(int(n))
                beta, ssr, inv = ols_centered(total[2:], list(range(p + 1)), k - 1)
                dof = n - (p + 2)
                se = np.sqrt(ssr / dof * inv[0, 0]) if dof > 0 else np.nan
                t = float(beta[0] / se) if se and np.isfinite(se) and se > 0 else float("nan")
                stat.append(t)
                pval.append(adf_pvalue(t))
                cv = adf_critical_values(int(n))
                c1.append(cv["1%"])
                c5.append(cv["5%"])
                c10.append(cv["10%"])
            yield pd.DataFrame({key: pdf[key], "nobs": nobs, "used_lag": pdf["used_lag"],
                                "ic_best": pdf["ic_best"], "adf_stat": stat, "p_value": pval,
                                "crit_1pct": c1, "crit_5pct": c5, "crit_10pct": c10})
    schema = StructType([StructField(key, key_type), StructField("nobs", LongType()),
                         StructField("used_lag", IntegerType()), StructField("ic_best", DoubleType()),
                         *[StructField(c, DoubleType()) for c in
                           ("adf_stat", "p_value", "crit_1pct", "crit_5pct", "crit_10pct")]])
    res = mom2.mapInPandas(fit, schema)
    return res.withColumn("stationary", F.coalesce(F.col("p_value") < alpha, F.lit(False)))
