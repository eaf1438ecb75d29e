import datetime as dt

from pyspark.sql import functions as F

from panelcast.sources import testdata
from panelcast.streaming import bars

SF = "/root/testdata/sf0.001"


def test_stream_equals_batch_bars_with_late_trades(spark, tmp_path):
    ticks = testdata.price_ticks(spark, SF)
    feed, sink = str(tmp_path / "feed"), str(tmp_path / "bars")
    # newer trades land first, older ones in a second batch
    cut = dt.datetime(1997, 1, 1)
    bars.stage_ticks(ticks.where(F.col("ts") >= cut), feed)
    bars.run_bars(spark, feed, sink, checkpoint=str(tmp_path / "ck"))
    first = bars.read_bars(spark, sink).count()
    bars.stage_ticks(ticks.where(F.col("ts") < cut), feed)
    bars.run_bars(spark, feed, sink, checkpoint=str(tmp_path / "ck"), max_files=1)
    got = bars.read_bars(spark, sink)
    want = testdata.prices(spark, SF)
    assert 0 < first < got.count()
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_late_trade_and_newest_month_are_kept(spark, tmp_path):
    def land(trades):
        df = spark.createDataFrame(trades, bars.TICK_SCHEMA)
        bars.stage_ticks(df, str(tmp_path / "feed"))
        bars.run_bars(spark, str(tmp_path / "feed"), str(tmp_path / "bars"), checkpoint=str(tmp_path / "ck"))
    land([("A", dt.datetime(2020, m, 5), m, float(m), 1.0) for m in range(1, 5)])
    land([("A", dt.datetime(2020, 1, 9), 9, 7.5, 2.0), ("B", dt.datetime(2020, 2, 1), 1, 3.0, 1.0)])
    got = {(r.ticker, r.month.month): (r.close, r.volume) for r in bars.read_bars(spark, str(tmp_path / "bars")).collect()}
    assert got[("A", 1)] == (7.5, 3.0) and got[("B", 2)] == (3.0, 1.0) and got[("A", 4)] == (4.0, 1.0)


def test_drift_updates_follow_landed_batches(spark, tmp_path):
    from panelcast.operators.drift import ks_drift
    from panelcast.streaming import drift_updates as du
    daily = testdata.daily(spark, SF).select("series_id", F.col("day").alias("date"), "value")
    feed, hist, res = str(tmp_path / "feed"), str(tmp_path / "hist"), str(tmp_path / "res")
    ck = str(tmp_path / "ck")
    first = daily.where(F.col("date") <= dt.date(2024, 1, 20))
    first.write.parquet(feed + "/a")
    du.run_drift_updates(spark, feed + "/*", hist, res, reference_end="2024-01-15",
                         window_days=5, checkpoint=ck)
    daily.where(F.col("date") > dt.date(2024, 1, 20)).write.parquet(feed + "/b")
    du.run_drift_updates(spark, feed + "/*", hist, res, reference_end="2024-01-15",
                         window_days=5, checkpoint=ck)
    got = {r.series_id: r for r in spark.read.parquet(res).collect()}
    want = {r.series_id: r for r in ks_drift(daily, "series_id", "date", "value", "2024-01-15",
                                             window_days=5).collect()}
    assert set(got) == set(want)
    for k, w in want.items():
        assert (got[k].n_ref, got[k].n_cur, got[k].ks_statistic, got[k].drift_detected) == \
               (w.n_ref, w.n_cur, w.ks_statistic, w.drift_detected)
    assert spark.read.parquet(hist).count() == daily.count()
