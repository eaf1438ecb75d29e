"""Forecasting per entity: OLS fits, predictions, signals, backtest tables.

Many small models (one per ticker) are fitted from per-key sufficient
statistics: exact sums for one feature, a mergeable moment matrix for many,
both combined map-side. The k x k solve runs once per key, on its one matrix.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructField, StructType

from panelcast.functions.exact import exact_comoment, exact_sum
from panelcast.functions.numeric import pct_change
from panelcast.operators.matrices import key_matrices, merge_complete
from panelcast.operators.split import apply_scaler, scaler_stats

# ---------------------------------------------------------------------------
# single regressor: closed form from exact sums (identical on any partitioning)
# ---------------------------------------------------------------------------


def _keys(key: str | Sequence[str]) -> list[str]:
    return [key] if isinstance(key, str) else list(key)


def fit_ols_single(df: DataFrame, x: str, y: str = "y", key: str | Sequence[str] = "ticker",
                   train_flag: str = "is_test", scale: int = 4) -> DataFrame:
    """G5 (one feature): per key slope/intercept on the train rows.

    A constant feature gets slope 0 and intercept mean(y) (minimum-norm
    least squares, as a scaled linear regression gives).
    """
    train = df.where(F.col(train_flag) == F.lit(False))
    g = train.groupBy(*_keys(key)).agg(
        exact_comoment(x, y, scale).cast("double").alias("_sxy"),
        exact_comoment(x, x, scale).cast("double").alias("_sxx"),
        exact_sum(x, scale).cast("double").alias("_sx"),
        exact_sum(y, scale).cast("double").alias("_sy"),
        F.count(F.lit(1)).alias("n_train"))
    slope = F.coalesce(F.try_divide(F.col("_sxy"), F.col("_sxx")), F.lit(0.0))
    g = g.withColumn("slope", slope)
    g = g.withColumn("intercept",
                     (F.col("_sy") - F.col("slope") * F.col("_sx")) / F.col("n_train").cast("double"))
    return g.select(*_keys(key), "slope", "intercept", "n_train")


def predict_single(df: DataFrame, coef: DataFrame, x: str, key: str | Sequence[str] = "ticker",
                   out: str = "predicted") -> DataFrame:
    return (df.join(coef.select(*_keys(key), "slope", "intercept"), on=_keys(key), how="inner")
              .withColumn(out, F.col("intercept") + F.col("slope") * F.col(x))
              .drop("slope", "intercept"))


# ---------------------------------------------------------------------------
# many regressors: per-key normal equations, solved with a pseudo-inverse
# ---------------------------------------------------------------------------


def _solver(k: int, rcond: float, top: int | None = None):
    def solve(batches):
        for pdf in batches:
            intercepts, coefs, ranks = [], [], []
            for raw in pdf["m"]:
                total = np.frombuffer(raw).reshape(k + 3, k + 1)
                mean, czz, czy = total[1], total[2: k + 2, :k], total[2: k + 2, k]
                beta = np.linalg.pinv(czz, rcond=rcond, hermitian=True) @ czy
                if top is not None and top < k:
                    best = np.sort(np.argsort(-np.abs(beta), kind="stable")[:top])
                    kept = np.linalg.pinv(czz[np.ix_(best, best)], rcond=rcond, hermitian=True) @ czy[best]
                    beta = np.zeros(k)
                    beta[best] = kept
                intercepts.append(float(mean[k] - beta @ mean[:k]) if total[0, 0] else None)
                coefs.append(beta.tolist())
                ranks.append(int(np.linalg.matrix_rank(czz, tol=rcond * max(1.0, np.abs(czz).max()))))
            out = pdf.drop(columns=["m"])
            out["intercept"] = intercepts
            out["coef"] = coefs
            out["rank"] = ranks
            yield out
    return solve


def fit_ols(df: DataFrame, features: Sequence[str], y: str = "y", key: str | Sequence[str] = "ticker",
            train_flag: str = "is_test", rcond: float = 1e-10,
            top: int | None = None) -> tuple[DataFrame, DataFrame]:
    """G5 (many features) with G3 scaling, per key.

    With ``top``, each key keeps its own ``top`` features, those of the largest
    standardised coefficients, and is fitted again on them from the same
    moments; the others have coefficient 0.

    Returns (coefficients, scaler statistics). Features are standardised with
    train-only statistics first, so a rank-deficient design gets the same
    minimum-norm solution as least squares on the scaled matrix.
    """
    stats = scaler_stats(df, features, key, train_flag)
    zs = [f"__z_{i}" for i in range(len(features))]
    scaled = apply_scaler(df, stats, features, key, suffix="__z")
    keys = _keys(key)
    scaled = scaled.select(*keys, y, train_flag,
                           *[F.col(f + "__z").alias(z) for f, z in zip(features, zs)])
    train = scaled.where(F.col(train_flag) == F.lit(False))
    moments = key_matrices(train, keys, [*zs, y])
    schema = StructType([*[df.schema[k] for k in keys], StructField("intercept", DoubleType()),
                         StructField("coef", ArrayType(DoubleType())),
                         StructField("rank", IntegerType())])
    coef = moments.mapInPandas(_solver(len(zs), rcond, top), schema)
    return coef, stats


def predict_ols(df: DataFrame, coef: DataFrame, stats: DataFrame, features: Sequence[str],
                key: str | Sequence[str] = "ticker", out: str = "predicted") -> DataFrame:
    """intercept + coef . z, evaluated JVM-side with higher-order functions."""
    scaled = apply_scaler(df, stats, features, key, suffix="__z")
    z = F.array(*[F.col(f + "__z") for f in features])
    dot = F.aggregate(F.zip_with(z, F.col("coef"), lambda a, b: a * b), F.lit(0.0),
                      lambda acc, v: acc + v)
    keys = _keys(key)
    res = (scaled.join(coef.select(*keys, "intercept", "coef"), on=keys, how="inner")
                 .withColumn(out, F.col("intercept") + dot))
    return res.drop("intercept", "coef", *[f + "__z" for f in features])


# ---------------------------------------------------------------------------
# signals, backtest, bias correction
# ---------------------------------------------------------------------------


def signal_expr(predicted, current, threshold: float = 5.0, neutral: str = "Hold") -> Column:
    """G1: change% > threshold -> Buy, < -threshold -> Sell, otherwise neutral.

    Bounds are strict; a zero current price gives NULL change -> neutral.
    """
    change = pct_change(predicted, current)
    return (F.when(change > threshold, F.lit("Buy"))
             .when(change < -threshold, F.lit("Sell"))
             .otherwise(F.lit(neutral)))


def backtest(scored: DataFrame, model: str, horizon: int | str, key: str = "ticker",
             date: str = "month", actual: str = "y", predicted: str = "predicted",
             current: str = "close", threshold: float = 5.0, neutral: str = "Hold",
             test_flag: str | None = "is_test", runs: Sequence[str] = ()) -> DataFrame:
    """(ticker, model, horizon, date, actual, predicted, current_price, signal).

    ``horizon`` is a number, or the name of the column that holds it; ``runs``
    are further columns that name the run and come first.
    """
    rows = scored.where(F.col(test_flag)) if test_flag else scored
    return rows.select(
        *runs, F.col(key).alias("ticker"), F.lit(model).alias("model"),
        (F.col(horizon) if isinstance(horizon, str) else F.lit(int(horizon))).alias("horizon"), F.col(date).alias("date"),
        F.col(actual).alias("actual"), F.col(predicted).alias("predicted"),
        F.col(current).alias("current_price"),
        signal_expr(predicted, current, threshold, neutral).alias("signal"))


def bias_correct(scored: DataFrame, predicted: str = "predicted", actual: str = "y",
                 key: str = "ticker", train_flag: str = "is_test",
                 sign: str = "subtract") -> DataFrame:
    """Shift predictions by the mean train residual mean(pred - actual).

    ``sign='subtract'`` removes the bias; ``'add'`` reproduces the variant
    that adds it (and so doubles it).
    """
    if sign not in ("subtract", "add"):
        raise ValueError("sign must be 'subtract' or 'add'")
    train = F.col(train_flag) == F.lit(False)
    bias = scored.groupBy(key).agg(
        F.avg(F.when(train, F.col(predicted) - F.col(actual))).alias("train_bias"))
    op = (lambda p, b: p - b) if sign == "subtract" else (lambda p, b: p + b)
    return (scored.join(bias, on=key, how="left")
                  .withColumn(predicted, op(F.col(predicted), F.coalesce(F.col("train_bias"), F.lit(0.0)))))


# ---------------------------------------------------------------------------
# Spark ML estimators (pooled over the panel)
# ---------------------------------------------------------------------------


def assemble(df: DataFrame, features: Sequence[str], out: str = "features") -> DataFrame:
    """Feature vectors of the rows that have every feature."""
    from pyspark.ml.feature import VectorAssembler

    from panelcast.operators.clean import drop_missing
    return VectorAssembler(inputCols=list(features), outputCol=out,
                           handleInvalid="error").transform(drop_missing(df, features))


def gbt_forecast(df: DataFrame, features: Sequence[str], y: str = "y",
                 train_flag: str = "is_test", max_depth: int = 6, step_size: float = 0.1,
                 max_iter: int = 100, seed: int = 42, out: str = "predicted") -> DataFrame:
    """Gradient-boosted trees (depth 6, rate 0.1, 100 trees), squared error.

    One pooled model over all keys; fitted on train rows, applied to all rows.
    """
    from pyspark.ml.regression import GBTRegressor
    data = assemble(df, features)
    model = GBTRegressor(featuresCol="features", labelCol=y, predictionCol=out,
                         maxDepth=max_depth, stepSize=step_size, maxIter=max_iter,
                         lossType="squared", seed=seed).fit(
        data.where(F.col(train_flag) == F.lit(False)))
    return model.transform(data).drop("features")


def rf_importance(df: DataFrame, features: Sequence[str], label: str = "close",
                  train_flag: str | None = "is_test", num_trees: int = 50,
                  seed: int = 42) -> DataFrame:
    """Random-forest feature importances, (feature, importance).

    Fitted on train rows when a split flag is given. The result has one row
    per feature (the model's own output), bounded by the feature list.
    """
    from pyspark.ml.regression import RandomForestRegressor
    data = assemble(df, features)
    if train_flag:
        data = data.where(F.col(train_flag) == F.lit(False))
    model = RandomForestRegressor(featuresCol="features", labelCol=label,
                                  numTrees=num_trees, seed=seed).fit(data)
    imp = model.featureImportances.toArray().tolist()
    spark = df.sparkSession
    return spark.createDataFrame(list(zip(features, [float(v) for v in imp])),
                                 "feature string, importance double")


def fold_ids(df: DataFrame, n_folds: int = 5, key: str = "ticker", order: str = "month",
             fold: str = "fold") -> DataFrame:
    """Contiguous, unshuffled folds per key (first n % k folds one larger)."""
    from pyspark.sql import Window
    w = Window.partitionBy(key).orderBy(order)
    i = F.row_number().over(w) - 1
    n = F.count(F.lit(1)).over(Window.partitionBy(key))
    q = F.floor(n / n_folds)
    r = n % n_folds
    big = r * (q + 1)
    fid = F.when(i < big, F.floor(i / (q + 1))).otherwise(r + F.floor((i - big) / q))
    return df.withColumn(fold, fid.cast("int"))


def cv_r2(df: DataFrame, features: Sequence[str], label: str = "close", n_folds: int = 5,
          num_trees: int = 50, seed: int = 42, key: str = "ticker") -> DataFrame:
    """G8 + A11: k-fold R2 of a random forest; mean and population std of folds."""
    from pyspark.ml.regression import RandomForestRegressor

    from panelcast.session import cut_lineage
    # k fits read the same assembled frame: materialise it once
    data = cut_lineage(assemble(fold_ids(df, n_folds, key), features))
    rows = []
    for f in range(n_folds):  # k is a small constant: k pooled fits
        model = RandomForestRegressor(featuresCol="features", labelCol=label,
                                      numTrees=num_trees, seed=seed).fit(
            data.where(F.col("fold") != f))
        pred = model.transform(data.where(F.col("fold") == f))
        rows.append(pred.select(F.lit(f).alias("fold"), label, "prediction"))
    scored = rows[0]
    for r in rows[1:]:
        scored = scored.unionByName(r)
    per_fold = scored.groupBy("fold").agg(r2_expr(label, "prediction").alias("r2"))
    return per_fold.agg(F.avg("r2").alias("cv_r2_mean"), F.stddev_pop("r2").alias("cv_r2_std"),
                        F.count(F.lit(1)).alias("n_folds"))


def linear_importance(coef: DataFrame, features: Sequence[str], key: str = "ticker") -> DataFrame:
    """Per-ticker feature ranking from a fitted linear model: |beta| on
    train-standardised features, normalised to sum to 1 per ticker.

    (key, feature, importance) - one row per ticker and feature.
    """
    names = F.array(*[F.lit(f) for f in features])
    pairs = coef.select(key, F.arrays_zip(names.alias("feature"), F.col("coef").alias("b")).alias("z"))
    long = pairs.select(key, F.explode("z").alias("p")).select(
        key, F.col("p.feature").alias("feature"), F.abs(F.col("p.b")).alias("w"))
    from pyspark.sql import Window
    total = F.sum("w").over(Window.partitionBy(key))
    return long.select(key, "feature", F.when(total > 0, F.col("w") / total).alias("importance"))


def cv_ols_r2(df: DataFrame, features: Sequence[str], y: str = "y", n_folds: int = 5,
              key: str = "ticker", order: str = "month", train_flag: str | None = "is_test",
              rcond: float = 1e-10) -> DataFrame:
    """G8 + A11 per ticker: k-fold (contiguous, unshuffled) CV R2 of OLS.

    Features are standardised once with train statistics (as the source
    scales before cross-validating). Moment matrices merge, so one pass per
    (ticker, fold) gives every fold's training moments as the others' merged;
    the k solves and held-out scores per ticker run on one
    row per ticker. Returns (ticker, cv_r2_mean, cv_r2_std (population),
    n_folds).
    """
    import pandas as pd
    feats = list(features)
    data = df.where(F.col(train_flag) == F.lit(False)) if train_flag else df
    flag = "__all_train"
    data = data.withColumn(flag, F.lit(False))
    stats = scaler_stats(data, feats, key, flag)
    z = apply_scaler(data, stats, feats, key, suffix="__z")
    z = fold_ids(z, n_folds, key, order, "fold")
    cols = [f"{f}__z" for f in feats] + [y]
    k = len(feats)
    mom = key_matrices(z, [key, "fold"], cols)
    per_key = mom.groupBy(key).agg(F.collect_list(F.struct("fold", "m")).alias("folds"))

    def score(batches):
        for pdf in batches:
            means, stds, counts = [], [], []
            for folds in pdf["folds"]:
                mats = {int(f["fold"]): np.frombuffer(f["m"]).reshape(k + 3, k + 1) for f in folds}
                r2s = []
                for f, held in sorted(mats.items()):
                    others = [m for g, m in sorted(mats.items()) if g != f]
                    if not others:
                        continue
                    tr = reduce(merge_complete, others)
                    n_tr, n_te = tr[0, 0], held[0, 0]
                    if n_tr < 2 or n_te < 1:
                        continue
                    beta = np.linalg.pinv(tr[2: k + 2, :k], rcond=rcond, hermitian=True) @ tr[2: k + 2, k]
                    # held-out SSres around the fold's own means (well conditioned)
                    off = held[1, k] - tr[1, k] - beta @ (held[1, :k] - tr[1, :k])
                    hxx, hxy, hyy = held[2: k + 2, :k], held[2: k + 2, k], held[k + 2, k]
                    ss_res = hyy - 2 * beta @ hxy + beta @ hxx @ beta + n_te * off ** 2
                    if hyy <= 0:
                        r2s.append(1.0 if ss_res <= 0 else 0.0)
                    else:
                        r2s.append(1.0 - ss_res / hyy)
                means.append(float(np.mean(r2s)) if r2s else None)
                stds.append(float(np.std(r2s)) if r2s else None)
                counts.append(len(r2s))
            yield pd.DataFrame({key: pdf[key], "cv_r2_mean": means, "cv_r2_std": stds,
                                "n_folds": counts})
    schema = StructType([StructField(key, df.schema[key].dataType),
                         StructField("cv_r2_mean", DoubleType()), StructField("cv_r2_std", DoubleType()),
                         StructField("n_folds", IntegerType())])
    return per_key.mapInPandas(score, schema)


def r2_expr(actual: str, predicted: str) -> Column:
    """1 - SSres/SStot; SStot = 0 gives 1.0 for a perfect fit, else 0.0."""
    err = F.col(actual) - F.col(predicted)
    ss_res = F.sum(err * err)
    ss_tot = F.var_pop(actual) * F.count(actual)
    return (F.when(ss_tot == 0, F.when(ss_res == 0, F.lit(1.0)).otherwise(F.lit(0.0)))
             .otherwise(F.lit(1.0) - ss_res / ss_tot))


def apply_per_ticker(df: DataFrame, fn, schema, key: str = "ticker") -> DataFrame:
    """H1 escape hatch: run a pandas function on each ticker's rows.

    Only for the monthly panel, whose groups are bounded by the calendar
    (a few hundred rows per ticker); never for raw trade or event rows.
    """
    return df.groupBy(key).applyInPandas(fn, schema)
