"""Canonical panel views over the driver's parquet tables.

The engine is generic over (entity, time, value). The driver tables are
mapped onto it as follows:

* ``prices``      lineitem x part: ticker = brand, one bar per month
                  (close = last trade of the month, volume = quantity sum)
* ``indicators``  orders: series = order priority, monthly mean of totals
* ``quarterly``   the same series bucketed by quarter (low-frequency input
                  for as-of alignment / forward fill)
* ``daily``       events: series = event type, one observation per event
* ``props``       events.props JSON text (observation-JSON input)

Every view reads only the columns it needs, and date slices are written on
the raw timestamp column so that they reach the parquet scan as pushed
filters.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelcast.functions.exact import exact_mean
from panelcast.functions.numeric import month_start, order_key, round_half_even

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet relation of a driver table, as it is now."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _as_date(value) -> dt.date | None:
    if value is None:
        return None
    if isinstance(value, dt.datetime):
        return value.date()
    if isinstance(value, dt.date):
        return value
    return dt.date.fromisoformat(str(value)[:10])


def month_bounds(start=None, end=None) -> tuple[dt.datetime | None, dt.datetime | None]:
    """[first instant of start's month, first instant after end's month)."""
    lo = hi = None
    if start is not None:
        d = _as_date(start)
        lo = dt.datetime(d.year, d.month, 1)
    if end is not None:
        d = _as_date(end)
        hi = dt.datetime(d.year + (d.month == 12), d.month % 12 + 1, 1)
    return lo, hi


def _slice_ts(df: DataFrame, ts_col: str, start, end) -> DataFrame:
    lo, hi = month_bounds(start, end)
    if lo is not None:
        df = df.where(F.col(ts_col) >= F.lit(lo))
    if hi is not None:
        df = df.where(F.col(ts_col) < F.lit(hi))
    return df


def price_ticks(spark: SparkSession, sf_dir: str, start=None, end=None) -> DataFrame:
    """Trade-level rows: (ticker, ts, seq, price, qty).

    ``seq`` numbers the trades: orderkey * 8 + linenumber (line numbers are
    1..7), so (ts, seq) orders trades as (ts, orderkey, linenumber).
    """
    li = _slice_ts(
        table(spark, sf_dir, "lineitem").select(
            "l_orderkey", "l_linenumber", "l_partkey", "l_shipdate",
            "l_extendedprice", "l_quantity"),
        "l_shipdate", start, end)
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    # No broadcast hint: part grows with the data. AQE/CBO broadcast it only
    # when its measured size is under the threshold; otherwise sort-merge.
    return (li.join(part, li.l_partkey == part.p_partkey)
              .select(F.col("p_brand").alias("ticker"),
                      F.col("l_shipdate").alias("ts"),
                      (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("seq"),
                      F.col("l_extendedprice").alias("price"),
                      F.col("l_quantity").alias("qty")))


def monthly_bars(ticks: DataFrame, key: str = "ticker", ts: str = "ts",
                 price: str = "price", qty: str = "qty", seq: str = "seq") -> DataFrame:
    """A2: one bar per (key, month): last price by (ts, seq), summed volume.

    ``max_by`` is a declarative aggregate on the hash path (decimal order
    key), so each map task combines its rows first; a hot ticker-month costs
    one partial row per task in the shuffle.
    """
    last = order_key(ts, seq)
    return (ticks.groupBy(F.col(key), month_start(ts).alias("month"))
                 .agg(round_half_even(F.max_by(price, last), 4).alias("close"),
                      F.sum(qty).alias("volume")))


def prices(spark: SparkSession, sf_dir: str, start=None, end=None) -> DataFrame:
    """(ticker, month, close, volume)."""
    return monthly_bars(price_ticks(spark, sf_dir, start, end))


def indicator_obs(spark: SparkSession, sf_dir: str, start=None, end=None) -> DataFrame:
    """Raw indicator observations: (series_id, ts, value)."""
    o = _slice_ts(table(spark, sf_dir, "orders").select(
        "o_orderpriority", "o_orderdate", "o_totalprice"), "o_orderdate", start, end)
    return o.select(F.col("o_orderpriority").alias("series_id"),
                    F.col("o_orderdate").alias("ts"),
                    F.col("o_totalprice").alias("value"))


def resample_mean(obs: DataFrame, unit: str = "month", key: str = "series_id",
                  ts: str = "ts", value: str = "value", out: str = "month") -> DataFrame:
    """A1: mean of higher-frequency observations per (series, period start)."""
    period = F.to_date(F.date_trunc(unit, F.col(ts)))
    return (obs.groupBy(F.col(key), period.alias(out))
               .agg(exact_mean(value).alias("value"),
                    F.count(value).alias("n_obs")))


def indicators(spark: SparkSession, sf_dir: str, start=None, end=None) -> DataFrame:
    """(series_id, month, value)."""
    return resample_mean(indicator_obs(spark, sf_dir, start, end)).drop("n_obs")


def quarterly(spark: SparkSession, sf_dir: str, start=None, end=None) -> DataFrame:
    """(series_id, month = quarter start, value): a low-frequency series."""
    return resample_mean(indicator_obs(spark, sf_dir, start, end), unit="quarter").drop("n_obs")


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(series_id, day, ts, value): one row per observation."""
    e = table(spark, sf_dir, "events").select("event_type", "ts", "value")
    return e.select(F.col("event_type").alias("series_id"),
                    F.to_date("ts").alias("day"), "ts", "value")


def props(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(obs_id, ts, series_id, props JSON text)."""
    e = table(spark, sf_dir, "events").select("event_id", "ts", "event_type", "props")
    return e.select(F.col("event_id").alias("obs_id"), "ts",
                    F.col("event_type").alias("series_id"), "props")

