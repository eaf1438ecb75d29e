"""Model monitoring: score new data with a saved pipeline (G11) + A6/A7.

The fitted pipeline (assembler + train-fitted scaler + regression) is saved
under the session's shared checkpoint folder and loaded back; the scaler
fitted at training time is reused (never refitted on the monitored data).
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelcast.operators import forecast, metrics
from panelcast.operators.clean import drop_missing, require_columns
from panelcast.plans import pipeline
from panelcast.session import cut_lineage, ensure_checkpoint_dir
from panelcast.sources import sinks


def train_pipeline(train: DataFrame, features: list[str], label: str = "y"):
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import StandardScaler, VectorAssembler
    from pyspark.ml.regression import LinearRegression
    stages = [VectorAssembler(inputCols=features, outputCol="raw", handleInvalid="error"),
              StandardScaler(inputCol="raw", outputCol="features", withMean=True, withStd=True),
              LinearRegression(featuresCol="features", labelCol=label, predictionCol="predicted",
                               regParam=0.0, solver="normal")]
    return Pipeline(stages=stages).fit(drop_missing(train, [*features, label]))


def save_model(model, spark: SparkSession, name: str) -> str:
    root = ensure_checkpoint_dir(spark).rstrip("/")
    path = f"{root}/models/{name}-{uuid.uuid4().hex[:8]}"
    model.write().overwrite().save(path)
    return path


def score_with_saved(spark: SparkSession, path: str, data: DataFrame) -> DataFrame:
    """Predictions of a saved model; rows that lack one of its features are left out."""
    from pyspark.ml import PipelineModel
    model = PipelineModel.load(path)
    inputs = model.stages[0].getInputCols()
    return model.transform(drop_missing(require_columns(data, inputs), inputs)).drop("raw", "features")


def monitor(spark: SparkSession, model_path: str, data: DataFrame, name: str = "LinearRegression",
            log_root: str | None = None) -> DataFrame:
    """Score new data (features and the observed ``y``) with an existing model:
    bias and directional accuracy per ticker, also appended to the run log (K6)."""
    scored = score_with_saved(spark, model_path, data)
    res = metrics.bias_directional(forecast.backtest(scored, name, 1, neutral="", test_flag=None))
    if log_root:
        res = cut_lineage(res)
        runs = res.select(F.concat_ws("_", "ticker", "model").alias("run_name"), "bias", "directional_accuracy")
        sinks.log_metrics_table(runs, log_root)
    return res


def score_saved_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fit on the train split, save, reload, score the test split, and report
    bias and directional accuracy of the reloaded model per ticker."""
    exp = pipeline.TEST_EXPERIMENTS[0]
    sup = pipeline.supervised(pipeline.feature_table(spark, sf_dir, exp, check_present=False), 1)
    feats = exp.feature_list()
    model = train_pipeline(sup.where(~F.col("is_test")), feats)
    path = save_model(model, spark, "linear")
    return monitor(spark, path, sup.where(F.col("is_test")))


# --- versioned models of each ticker -----------------------------------------------

def linear_version(coef: DataFrame, stats: DataFrame, features: list[str], starts: DataFrame, model: str, version: int) -> DataFrame:
    """A row per ticker of one version of the linear models of ``fit_ols``
    (coefficients and training scaler), in force from ``starts`` (ticker, valid_from)."""
    place = F.array_position(F.array(*[F.lit(f) for f in features]), F.col("feature"))
    scaler = stats.groupBy("ticker").agg(F.array_sort(F.collect_list(F.struct(place.alias("at"), "mean", "std"))).alias("_s"))
    return (coef.join(scaler, "ticker").join(starts, "ticker")
            .select("ticker", F.lit(model).alias("model"), F.lit(version).alias("version"), "valid_from",
                    F.array(*[F.lit(f) for f in features]).alias("features"), F.transform("_s", lambda s: s["mean"]).alias("mean"),
                    F.transform("_s", lambda s: s["std"]).alias("std"), "coef", "intercept"))


def single_version(coef: DataFrame, feature: str, starts: DataFrame, model: str, version: int) -> DataFrame:
    """The same for the one-feature models of ``fit_ols_single``, which have no scaler."""
    return (coef.join(starts, "ticker")
            .select("ticker", F.lit(model).alias("model"), F.lit(version).alias("version"), "valid_from",
                    F.array(F.lit(feature)).alias("features"), F.array(F.lit(0.0)).alias("mean"), F.array(F.lit(1.0)).alias("std"),
                    F.array("slope").alias("coef"), "intercept"))


def save_versions(versions: DataFrame, path: str) -> str:
    """Write versions; those of other models or numbers stay."""
    return sinks.write_table(versions, path, ["model", "version"], replace="partitions")


def _linear(features: list[str]) -> Column:
    """Prediction from a version's columns and the row's features, by name."""
    have = F.map_from_arrays(F.array(*[F.lit(f) for f in features]), F.array(*[F.col(f"`{f}`").cast("double") for f in features]))
    values = F.transform("features", lambda f: F.try_element_at(have, f))
    scaled = F.zip_with(F.zip_with(values, "mean", lambda x, m: x - m), "std", lambda x, s: x / s)
    return F.col("intercept") + F.aggregate(F.zip_with(scaled, "coef", lambda z, b: z * b), F.lit(0.0), lambda a, v: a + v)


def score_versions(data: DataFrame, versions: DataFrame, features: list[str], date: str = "month") -> DataFrame:
    """``data`` with model, version and predicted: for each model the version
    of the row's ticker that was in force on its date (of equal dates the highest).

    Rows before a ticker's first version, and those that miss one of its
    features (P9), are left out. ``data`` may be a stream.
    """
    nxt = F.lead("valid_from").over(Window.partitionBy("ticker", "model").orderBy("valid_from", "version"))
    spans = versions.withColumn("_until", nxt).where("_until is null or valid_from < _until").withColumnRenamed("ticker", "_ticker")
    on = (F.col("ticker") == F.col("_ticker")) & (F.col(date) >= F.col("valid_from")) & (
        F.col("_until").isNull() | (F.col(date) < F.col("_until")))
    scored = data.join(spans, on).withColumn("predicted", _linear(features)).where(F.col("predicted").isNotNull())
    return scored.drop("_ticker", "_until", "valid_from", "features", "mean", "std", "coef", "intercept")
