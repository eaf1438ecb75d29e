"""Drift checks kept up to date as new observations land.

Each micro-batch of new observation files is stored in a history table,
partitioned by batch id and written with dynamic partition overwrite: a
replayed batch (after a failure) replaces its own partition instead of
adding duplicates. Then the KS drift test is recomputed, on the full
history, for the series the batch touched only; their result rows replace
the previous ones (results partitioned by series).
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, DoubleType, StringType, StructField, StructType

from panelcast.operators.drift import ks_drift
from panelcast.session import ensure_checkpoint_dir

BUCKETS = 64  # of series, in the history

OBS_SCHEMA = StructType([StructField("series_id", StringType()), StructField("date", DateType()),
                         StructField("value", DoubleType())])


def run_drift_updates(spark: SparkSession, source: str, history: str, results: str,
                      reference_end: str = "2024-12-31", window_months: int | None = 12,
                      window_days: int | None = None, threshold: float = 0.05,
                      checkpoint: str | None = None, schema: StructType = OBS_SCHEMA, method: str = "asymp"):
    """Process every observation file available under ``source`` and stop.

    The history is kept by bucket of the series' hash, and a batch reads only
    the buckets of the series that it touches. ``method`` is that of the
    p-value; the exact one is for short series only.
    """
    root = ensure_checkpoint_dir(spark).rstrip("/")
    ckpt = checkpoint or f"{root}/streams/drift-{uuid.uuid4().hex[:8]}"

    def on_batch(batch: DataFrame, batch_id: int) -> None:
        bucket = F.pmod(F.xxhash64("series_id"), F.lit(BUCKETS)).cast("int")
        rows = batch.withColumns({"bucket": bucket, "batch_id": F.lit(batch_id)})
        (rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
             .partitionBy("bucket", "batch_id").parquet(history))
        touched = rows.select("series_id", "bucket").distinct()
        own = [r["bucket"] for r in touched.select("bucket").distinct().collect()]  # at most BUCKETS numbers
        hist = (spark.read.parquet(history).where(F.col("bucket").isin(own))
                .join(touched.select("series_id"), on="series_id", how="left_semi"))
        res = ks_drift(hist, "series_id", "date", "value", reference_end,
                       window_months=window_months, window_days=window_days, threshold=threshold, method=method)
        (res.withColumn("batch_id", F.lit(batch_id))
            .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
            .partitionBy("series_id").parquet(results))

    obs = spark.readStream.schema(schema).parquet(source)
    q = (obs.writeStream.foreachBatch(on_batch).option("checkpointLocation", ckpt)
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return q
