"""Readers for landed series files (CSV / JSON / parquet), explicit schemas.

Layouts accepted:

* price CSVs ``Date,{TICKER}_Close,{TICKER}_Volume`` - one file per ticker,
  any number of files in a folder; the ticker comes from the value header;
* indicator CSVs ``date,{SERIES_ID}`` (header ``date`` or ``Date``) - one
  file per series; the series id is the value-column header;
* provider JSON ``{"observations": [{"date": ..., "value": ...}, ...]}`` with
  string values ('.' marks a gap);
* wide combined tables (first column = month, one column per series).

All readers return long frames: prices (ticker, month, close, volume),
indicators (series_id, month, value). One Spark scan per folder, not one
read per file: the per-file header is recovered from the file itself.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DecimalType, MapType, StringType, StructField, StructType

from panelcast.functions.numeric import month_start, round_half_even, to_double

OBSERVATIONS_SCHEMA = StructType([StructField("observations", ArrayType(StructType([
    StructField("date", StringType()), StructField("value", StringType())])))])


_NO_DATE, _NO_HEADER, _NO_VALUE = "no date", "no header", "no value column"


def _cells(line: Column) -> Column:
    """Cells of a CSV line, as many as it has; quotes are taken off."""
    outside = ',(?=(?:[^"]*"[^"]*")*[^"]*$)'
    cells = F.when(line.contains('"'), F.split(line, outside)).otherwise(F.split(line, ","))
    return F.transform(cells, lambda c: F.trim(F.regexp_replace(F.regexp_replace(F.trim(c), '(?s)^"(.*)"$', "$1"), '""', '"')))


def _csv_rows(spark: SparkSession, path: str) -> DataFrame:
    """(file, obs_order, cells, header, month) of every data row of every file.

    Rows may have any number of cells. A file's header is its first row that
    isn't blank, unless that begins with a date: then the file has none, and its
    rows come with a null header. obs_order follows the file (block start, then
    row), as keep-first needs it.
    """
    raw = (spark.read.text(path).where(F.trim("value") != "")
           .select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_block"),
                   _cells(F.regexp_replace("value", "^\ufeff|\r$", "")).alias("cells")))
    rows = raw.select("file", "cells", _row_order(F.col("_block")).alias("obs_order"),
                      month_start(_parse_date(F.col("cells")[0])).alias("month"))
    heads = (rows.groupBy("file").agg(F.min_by(F.struct("cells", "month"), "obs_order").alias("_top"), F.min("obs_order").alias("_h")))
    named = F.when(F.col("_top.month").isNull(), F.col("_top.cells"))
    return (rows.join(heads, on="file").where(F.col("_top.month").isNotNull() | (F.col("obs_order") != F.col("_h")))
            .withColumn("header", named).drop("_top", "_h"))


def _row_order(block: Column) -> Column:
    """Place of a row in its file, as one exact number."""
    dec = DecimalType(38, 0)
    return block.cast(dec) * F.lit("10000000000000000000").cast(dec) + F.monotonically_increasing_id().cast(dec)


def _parse_date(col: Column) -> Column:
    return F.try_to_date(F.trim(col))


def _at(suffix: str) -> Column:
    """Place of the header cell that ends with ``suffix`` (null: none)."""
    place = F.array_position(F.transform("header", lambda h: F.coalesce(h.endswith(suffix), F.lit(False))), True)
    return F.nullif(place, F.lit(0))


def _reason(kind: str) -> Column:
    """Why a row of a price or indicator file can't be read (null: it can)."""
    value = _at("Close").isNull() if kind == "prices" else F.size("header") < 2
    return (F.when(F.col("month").isNull(), _NO_DATE).when(F.col("header").isNull(), _NO_HEADER).when(value, _NO_VALUE))


def rejected_rows(spark: SparkSession, path: str, kind: str = "indicators") -> DataFrame:
    """(file, reason, n_rejected): rows that the CSV readers leave out: their first
    cell is no date, or their file has no header or no value column. ``kind``
    is 'prices' or 'indicators'."""
    rows = _csv_rows(spark, path).withColumn("reason", _reason(kind)).where("reason is not null")
    return rows.groupBy("file", "reason").agg(F.count(F.lit(1)).alias("n_rejected"))


def read_indicator_csvs(spark: SparkSession, path: str) -> DataFrame:
    """``date|Date,<SERIES_ID>`` CSV files -> (series_id, month, value, obs_order).

    The series id is the second header cell; values are coerced leniently
    (P2) and bucketed to month start (P3). Rows that can't be read are counted
    by ``rejected_rows``.
    """
    rows = _csv_rows(spark, path).where(_reason("indicators").isNull())
    return rows.select(F.col("header")[1].alias("series_id"), "month",
                       to_double(F.get("cells", F.lit(1))).alias("value"), "obs_order")


def read_price_csvs(spark: SparkSession, path: str) -> DataFrame:
    """Price files -> (ticker, month, close, volume, obs_order).

    Headers ``Date,{T}_Close,{T}_Volume`` (any columns, in any order) name the
    ticker; plain ``Date,Close,Volume`` files take it from the file name
    (``{T}_monthly.csv`` or ``{T}.csv``). A missing cell is a missing value.
    Rows that can't be read are counted by ``rejected_rows(..., 'prices')``.
    """
    rows = _csv_rows(spark, path).where(_reason("prices").isNull())
    cell = lambda suffix, of: F.get(of, (_at(suffix) - 1).cast("int"))
    name = cell("Close", "header")
    from_file = F.regexp_extract("file", r"([^/]+?)(_monthly)?\.csv$", 1)
    ticker = F.when(name.endswith("_Close"), F.regexp_replace(name, "_Close$", "")).otherwise(from_file)
    return rows.select(ticker.alias("ticker"), "month",
                       round_half_even(to_double(cell("Close", "cells")), 4).alias("close"),
                       to_double(cell("Volume", "cells")).alias("volume"), "obs_order")


def keep_first(df: DataFrame, keys: Sequence[str], order: str = "obs_order") -> DataFrame:
    """D1 + P8 on landed rows: rows with a missing value are dropped first,
    then the first remaining row of each key (file order) is kept."""
    values = [c for c in df.columns if c not in (*keys, order)]
    # one min_by per column on a single long order: hash aggregation
    return (df.dropna(how="any", subset=values)
              .groupBy(*keys).agg(*[F.min_by(v, F.col(order)).alias(v) for v in values]))


def _json_rows(spark: SparkSession, path: str) -> DataFrame:
    df = spark.read.schema(OBSERVATIONS_SCHEMA).option("multiLine", "true").json(path)
    rows = df.select(F.input_file_name().alias("file"), F.posexplode_outer("observations").alias("pos", "o"))
    return rows.withColumn("month", month_start(_parse_date(F.col("o.date"))))


def rejected_observations(spark: SparkSession, path: str) -> DataFrame:
    """(file, reason, n_rejected): observations of provider JSON without a date,
    and documents without observations."""
    reason = F.when(F.col("pos").isNull(), "no observations").otherwise(_NO_DATE)
    return (_json_rows(spark, path).where("month is null").groupBy("file", reason.alias("reason"))
            .agg(F.count(F.lit(1)).alias("n_rejected")))


def read_observations_json(spark: SparkSession, path: str, series_id: str | None = None) -> DataFrame:
    """S3: provider JSON -> (series_id, month, value, obs_order); '.' and junk -> NULL.

    obs_order is the place in the document's list, behind all CSV rows.
    Observations without a date are counted by ``rejected_observations``.
    """
    df = _json_rows(spark, path).where("month is not null")
    sid = F.lit(series_id) if series_id else F.regexp_extract("file", r"([^/]+)\.json$", 1)
    dec = DecimalType(38, 0)
    return df.select(sid.alias("series_id"), "month", to_double("o.value").alias("value"),
                     (F.col("pos").cast(dec) + F.lit("1" + "0" * 37).cast(dec)).cast(dec).alias("obs_order"))


def flatten_observations(df: DataFrame, json_col: str) -> DataFrame:
    """S3 on a text column holding observation JSON documents."""
    parsed = df.withColumn("_j", F.from_json(json_col, OBSERVATIONS_SCHEMA))
    keep = [c for c in df.columns if c != json_col]
    return parsed.select(*keep, F.explode("_j.observations").alias("_o")).select(
        *keep, _parse_date(F.col("_o.date")).alias("date"), to_double("_o.value").alias("value"))


def flatten_json_object(df: DataFrame, json_col: str) -> DataFrame:
    """Flat JSON objects -> one row per (row, field) with a coerced value."""
    parsed = df.withColumn("_m", F.from_json(json_col, MapType(StringType(), StringType())))
    keep = [c for c in df.columns if c != json_col]
    return parsed.select(*keep, F.explode("_m").alias("field", "_raw")).select(
        *keep, "field", to_double("_raw").alias("value"))


def read_parquet(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    """Parquet scan; a column list keeps the scan pruned."""
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def read_universe(spark: SparkSession, path: str, column: str = "Symbol") -> DataFrame:
    """Ticker universe file -> distinct tickers."""
    schema = StructType([StructField(column, StringType())])
    df = spark.read.schema(schema).option("header", "true").csv(path)
    return df.select(F.trim(column).alias("ticker")).where(F.col("ticker") != "").distinct()


def read_wide_combined(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    """Wide combined tables (first column = month, one column per
    series; CSV with an unnamed first column, or parquet) -> long rows.

    Each CSV file has its own header, by which its cells are named.
    """
    if fmt == "parquet":
        df = spark.read.parquet(path)
        month_col, values = df.columns[0], df.columns[1:]
        cast = df.select(_parse_date(F.col(f"`{month_col}`").cast("string")).alias("month"),
                         *[to_double(F.col(f"`{c}`")).alias(c) for c in values])
        return cast.unpivot(["month"], [F.col(f"`{c}`") for c in values], "series_id", "value")
    named = (_csv_rows(spark, path).where("month is not null and header is not null")
             .select("month", F.posexplode(F.arrays_zip("header", "cells")).alias("place", "x")))
    return named.where("place > 0 and x.header is not null").select(
        "month", F.col("x.header").alias("series_id"), to_double("x.cells").alias("value"))
