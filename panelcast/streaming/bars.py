"""Monthly bars kept up to date from an append-only trade feed.

Each micro-batch of new trade files is reduced to partial bars, one row per
(ticker, month): the last trade's order key and price, and the volume. The rows
of a batch are a partition of their own, overwritten when the batch is replayed
after a failure, so nothing counts twice. Reading merges the partials by the
order key: trades may come late by any time, no month is held back, and the
result is that of the batch operator (A2) over all trades seen.

Partials are small: one row per ticker and month that a batch touches.
Checkpoints live under the session's shared checkpoint folder.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import (DateType, DecimalType, DoubleType, IntegerType, LongType, StringType, StructField,
                               StructType, TimestampType)

from panelcast.functions.numeric import month_start, order_key, round_half_even
from panelcast.session import ensure_checkpoint_dir

TICK_SCHEMA = StructType([
    StructField("ticker", StringType()), StructField("ts", TimestampType()),
    StructField("seq", LongType()),
    StructField("price", DoubleType()), StructField("qty", DoubleType())])

PARTIAL_SCHEMA = StructType([
    StructField("ticker", StringType()), StructField("month", DateType()),
    StructField("last_key", DecimalType(38, 0)), StructField("last_price", DoubleType()),
    StructField("volume", DoubleType()), StructField("batch_id", IntegerType())])


def partial_bars(ticks: DataFrame) -> DataFrame:
    """(ticker, month, last_key, last_price, volume) of some of the trades."""
    keyed = ticks.select("ticker", month_start("ts").alias("month"), order_key("ts", "seq").alias("k"), "price", "qty")
    return keyed.groupBy("ticker", "month").agg(
        F.max("k").alias("last_key"), F.max_by("price", "k").alias("last_price"), F.sum("qty").alias("volume"))


def merge_bars(partials: DataFrame) -> DataFrame:
    """Partial bars -> (ticker, month, close, volume)."""
    return partials.groupBy("ticker", "month").agg(
        round_half_even(F.max_by("last_price", "last_key"), 4).alias("close"), F.sum("volume").alias("volume"))


def run_bars(spark: SparkSession, source: str, sink: str, checkpoint: str | None = None,
             schema: StructType = TICK_SCHEMA, max_files: int | None = None):
    """Process every trade file available under ``source`` into partial bars
    under ``sink`` and stop; call again later to pick up new files."""
    root = ensure_checkpoint_dir(spark).rstrip("/")
    ckpt = checkpoint or f"{root}/streams/bars-{uuid.uuid4().hex[:8]}"

    def on_batch(batch: DataFrame, batch_id: int) -> None:
        (partial_bars(batch).withColumn("batch_id", F.lit(batch_id))
         .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(sink))

    reader = spark.readStream.schema(schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    q = (reader.parquet(source).writeStream.foreachBatch(on_batch).option("checkpointLocation", ckpt)
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return q


def read_bars(spark: SparkSession, sink: str) -> DataFrame:
    """The bars of all trades processed so far."""
    return merge_bars(spark.read.schema(PARTIAL_SCHEMA).parquet(sink))


def stage_ticks(ticks: DataFrame, path: str) -> str:
    """Land a batch of trades as parquet files (the feed a stream reads)."""
    ticks.select(*[f.name for f in TICK_SCHEMA.fields]).write.mode("append").parquet(path)
    return path
