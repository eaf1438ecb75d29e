import datetime as dt

from pyspark.sql import functions as F

from panelcast.operators import clean
from conftest import rows

D = dt.date


def test_coerce_numeric_bad_text_and_nan_become_null(spark):
    df = spark.createDataFrame([("1.5",), (".",), ("",), ("n/a",), ("NaN",), ("-3",)], "v string")
    out = [r.v for r in clean.coerce_numeric(df, ["v"]).collect()]
    assert out == [1.5, None, None, None, None, -3.0]


def test_coerce_numeric_on_double_column_nan_to_null(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (None,)], "v double")
    assert [r.v for r in clean.coerce_numeric(df, ["v"]).collect()] == [1.0, None, None]


def test_add_month_and_range_slice_inclusive(spark):
    df = spark.createDataFrame([(D(2024, 1, 31),), (D(2024, 2, 1),), (D(2024, 3, 15),)], "d date")
    m = clean.add_month(df, "d")
    assert [r.month for r in m.orderBy("d").collect()] == [D(2024, 1, 1), D(2024, 2, 1), D(2024, 3, 1)]
    s = clean.range_slice(m, "month", "2024-02-01", "2024-03-01")
    assert sorted(r.d for r in s.collect()) == [D(2024, 2, 1), D(2024, 3, 15)]


def test_first_per_period_keeps_first_by_total_order(spark):
    df = spark.createDataFrame([
        ("A", dt.datetime(2024, 1, 5), 2, 10.0),
        ("A", dt.datetime(2024, 1, 5), 1, 11.0),   # same ts, lower seq -> first
        ("A", dt.datetime(2024, 1, 20), 0, 12.0),
        ("A", dt.datetime(2024, 2, 1), 0, 13.0),
        ("B", dt.datetime(2024, 1, 9), 0, 20.0)], "k string, ts timestamp, seq int, v double")
    out = clean.first_per_period(df, ["k"], F.trunc(F.to_date("ts"), "month"), ["ts", "seq"], ["v"])
    assert rows(out, "k", "month", "v") == [("A", D(2024, 1, 1), 11.0), ("A", D(2024, 2, 1), 13.0),
                                            ("B", D(2024, 1, 1), 20.0)]


def test_duplicate_periods(spark):
    df = spark.createDataFrame([("A", D(2024, 1, 1)), ("A", D(2024, 1, 20)), ("A", D(2024, 2, 1))],
                               "k string, d date")
    out = clean.duplicate_periods(df, ["k"], F.trunc("d", "month"))
    assert rows(out) == [("A", D(2024, 1, 1), 2)]


def _gapped(spark):
    return spark.createDataFrame([
        ("A", D(2024, 1, 1), 1.0), ("A", D(2024, 3, 1), 3.0), ("A", D(2024, 6, 1), 6.0),
        ("B", D(2024, 2, 1), 5.0)], "ticker string, month date, close double")


def test_reindex_forward_and_back_fill(spark):
    g = clean.reindex_months(_gapped(spark), ["ticker"])
    assert g.count() == 7  # A: Jan..Jun (6) + B: Feb (1)
    ff = clean.forward_fill(g.withColumn("f", F.col("close")), ["ticker"], "month", ["f"])
    bf = clean.back_fill(g.withColumn("b", F.col("close")), ["ticker"], "month", ["b"])
    fa = [r.f for r in ff.where("ticker='A'").orderBy("month").collect()]
    ba = [r.b for r in bf.where("ticker='A'").orderBy("month").collect()]
    assert fa == [1.0, 1.0, 3.0, 3.0, 3.0, 6.0]
    assert ba == [1.0, 3.0, 3.0, 6.0, 6.0, 6.0]


def test_null_counts(spark):
    g = clean.reindex_months(_gapped(spark), ["ticker"])
    out = rows(clean.null_counts(g, ["ticker"], ["close"]))
    assert out == [("A", 6, 3), ("B", 1, 0)]


def test_drop_missing_subset(spark):
    df = spark.createDataFrame([(1.0, None), (None, 2.0), (3.0, 4.0)], "a double, b double")
    assert clean.drop_missing(df).count() == 1
    assert clean.drop_missing(df, ["a"]).count() == 2


def test_split_run_name_first_separator_and_invalid_skipped(spark):
    df = spark.createDataFrame([("BTC-USD_XGB_x",), ("SPY_LSTM",), ("nosep",)], "r string")
    out = rows(clean.split_run_name(df, "r"), "r", "ticker", "model")
    assert out == [("BTC-USD_XGB_x", "BTC-USD", "XGB_x"), ("SPY_LSTM", "SPY", "LSTM")]
