"""Landed files -> readers -> experiment pipeline -> metrics -> sinks."""

import datetime as dt
import json
import math

import pytest
from pyspark.sql import functions as F

from panelcast.operators import clean
from panelcast.plans import experiments
from panelcast.plans.pipeline import Experiment
from panelcast.sources import files, sinks
from conftest import rows

D = dt.date


def _months(n, y=2015, m=1):
    out = []
    for _ in range(n):
        out.append(D(y, m, 1))
        y, m = (y + 1, 1) if m == 12 else (y, m + 1)
    return out


@pytest.fixture(scope="module")
def landed(tmp_path_factory):
    root = tmp_path_factory.mktemp("landed")
    px, ind, js = root / "prices", root / "fred", root / "json"
    for d in (px, ind, js):
        d.mkdir()
    months = _months(48)
    for t, base in (("AAA", 100.0), ("BB-X", 50.0)):
        lines = [f"Date,{t}_Close,{t}_Volume"]
        for i, mth in enumerate(months):
            close = base + 3 * i + 5 * math.sin(i)
            lines.append(f"{mth.isoformat()},{close:.4f},{1000 + i}")
        (px / f"{t}_monthly.csv").write_text("\n".join(lines) + "\n")
    # monthly indicator with a '.' gap and a duplicated month (keep-first)
    lines = ["date,UNRATE"] + [f"{m.isoformat()},{4 + 0.1 * i:.1f}" for i, m in enumerate(months)]
    lines.insert(5, f"{months[3].isoformat()},99.0")
    lines[10] = f"{months[9].isoformat()},."
    (ind / "UNRATE.csv").write_text("\n".join(lines) + "\n")
    # quarterly indicator with a 'Date' header
    q = [m for m in months if m.month in (1, 4, 7, 10)]
    (ind / "GDP.csv").write_text("Date,GDP\n" + "\n".join(f"{m.isoformat()},{20000 + 100 * i}"
                                                          for i, m in enumerate(q)) + "\n")
    obs = {"observations": [{"date": "2015-01-01", "value": "1.5"}, {"date": "2015-02-01", "value": "."},
                            {"date": "2015-03-01", "value": "2.5"}]}
    (js / "M2SL.json").write_text(json.dumps(obs))
    (root / "equities.csv").write_text("Symbol\nAAA\nBB-X\nAAA\n")
    (root / "wide.csv").write_text(",GDP,AAA_Close\n2024-04-01,1.5,10.0\n2024-05-01,1.5,11.0\n")
    return root


def test_indicator_csv_reader_and_keep_first(spark, landed):
    raw = files.read_indicator_csvs(spark, str(landed / "fred"))
    assert rows(raw.select("series_id").distinct()) == [("GDP",), ("UNRATE",)]
    ind = files.keep_first(raw, ["series_id", "month"])
    un = {r.month: r.value for r in ind.where("series_id = 'UNRATE'").collect()}
    assert un[D(2015, 4, 1)] == pytest.approx(4.3)   # first of the duplicated month
    assert len(un) == 47                            # the '.' row is dropped


def test_price_csv_reader(spark, landed):
    p = files.keep_first(files.read_price_csvs(spark, str(landed / "prices")), ["ticker", "month"])
    assert rows(p.groupBy("ticker").count()) == [("AAA", 48), ("BB-X", 48)]


def test_json_universe_wide_readers(spark, landed):
    j = files.read_observations_json(spark, str(landed / "json"))
    assert rows(j, "series_id", "month", "value") == [("M2SL", D(2015, 1, 1), 1.5),
                                                      ("M2SL", D(2015, 2, 1), None),
                                                      ("M2SL", D(2015, 3, 1), 2.5)]
    assert rows(files.read_universe(spark, str(landed / "equities.csv"))) == [("AAA",), ("BB-X",)]
    w = files.read_wide_combined(spark, str(landed / "wide.csv"))
    assert w.count() == 4 and set(w.columns) == {"month", "series_id", "value"}


def test_experiment_from_files_end_to_end_and_sinks(spark, landed, tmp_path):
    prices = files.keep_first(files.read_price_csvs(spark, str(landed / "prices")), ["ticker", "month"])
    ind = files.keep_first(files.read_indicator_csvs(spark, str(landed / "fred")),
                           ["series_id", "month"])
    exps = [Experiment("inner_unrate", ("UNRATE", "M2SL"), ("AAA", "BB-X"), horizons=(1, 3)),
            Experiment("asof_gdp", ("GDP",), ("AAA",), align="asof")]
    bt, m = experiments.run_experiments(prices, ind, exps)
    got = rows(m, "experiment", "ticker", "horizon")
    assert got == [("asof_gdp", "AAA", 1), ("inner_unrate", "AAA", 1), ("inner_unrate", "AAA", 3),
                   ("inner_unrate", "BB-X", 1), ("inner_unrate", "BB-X", 3)]
    assert all(r.rmse is not None for r in m.collect())
    assert set(bt.select("signal").distinct().toPandas().signal) <= {"Buy", "Sell", "Hold"}
    out = str(tmp_path / "out")
    sinks.save_backtest(bt, out)
    sinks.save_metrics(m, out, csv_export=True)
    back = spark.read.parquet(f"{out}/backtest")
    assert back.count() == bt.count()
    with pytest.raises(sinks.EmptyResultError):
        sinks.write_table(bt.limit(0), str(tmp_path / "empty"))
    assert not (tmp_path / "empty").exists()
    sinks.log_run(spark, out, "AAA_LinearRegression_1", params={"features": ["a", "b"]},
                  metrics={"rmse": 1.0})
    runs = spark.read.parquet(f"{out}/runs")
    assert rows(runs, "kind", "key", "value") == [("metric", "rmse", "1.0"), ("param", "features", "a, b")]


def test_require_columns_and_preview(spark):
    df = spark.createDataFrame([("A", D(2020, m, 1), 1.0) for m in range(1, 13)],
                               "ticker string, month date, close double")
    with pytest.raises(clean.MissingColumnsError) as e:
        clean.require_columns(df, ["close", "close_ma3"])
    assert e.value.missing == ["close_ma3"]
    assert [r.month.month for r in clean.preview(df, 3).collect()] == [1, 2, 3]
    assert clean.columns_except(df.withColumn("close_t1", F.lit(1.0)), "close", ["ticker"]) == ["month"]


def test_command_line_experiments_and_drift(spark, landed, tmp_path):
    import shutil

    from panelcast.__main__ import main
    px = tmp_path / "px"
    px.mkdir()
    shutil.copy(landed / "prices" / "AAA_monthly.csv", px / "XOM_monthly.csv")
    (px / "XOM_monthly.csv").write_text((px / "XOM_monthly.csv").read_text().replace("AAA_", "XOM_"))
    fred = tmp_path / "fred"
    fred.mkdir()
    (fred / "WTISPLC.csv").write_text((landed / "fred" / "UNRATE.csv").read_text().replace("UNRATE", "WTISPLC"))
    out = str(tmp_path / "out")
    main(["experiments", "--prices", str(px), "--indicators", str(fred), "--out", out, "--names", "oil"])
    m = spark.read.parquet(f"{out}/metrics_summary")
    assert rows(m, "experiment", "ticker", "model", "horizon") == [("oil", "XOM", "LinearRegression", 1)]
    main(["drift", "--indicators", str(fred), "--out", out, "--reference-end", "2017-12-31"])
    d = spark.read.parquet(f"{out}/drift").first()
    assert d.series_id == "WTISPLC" and d.n_cur == 12 and d.ks_statistic is not None


def test_price_csv_ticker_from_file_name(spark, tmp_path):
    d = tmp_path / "plain"
    d.mkdir()
    (d / "GLD_monthly.csv").write_text("Date,Close,Volume\n2020-01-31,150.12345,10\n2020-02-28,151.5,11\n")
    (d / "SLV.csv").write_text("Date,Volume,Close\n2020-01-15,5,17.25\n")
    p = files.read_price_csvs(spark, str(d))
    assert rows(p, "ticker", "month", "close", "volume") == [
        ("GLD", D(2020, 1, 1), 150.1234, 10.0), ("GLD", D(2020, 2, 1), 151.5, 11.0),
        ("SLV", D(2020, 1, 1), 17.25, 5.0)]


def test_wide_combined_parquet(spark, tmp_path):
    import pandas as pd
    pdf = pd.DataFrame({"Date": pd.to_datetime(["2024-04-01", "2024-05-01"]), "GDP": [1.5, 1.5],
                        "GEV_Close": [153.4775, 175.634]})
    path = str(tmp_path / "GEV_combined.parquet")
    pdf.to_parquet(path, coerce_timestamps="us", allow_truncated_timestamps=True)
    long = files.read_wide_combined(spark, path, fmt="parquet")
    assert rows(long, "month", "series_id", "value") == [
        (D(2024, 4, 1), "GDP", 1.5), (D(2024, 4, 1), "GEV_Close", 153.4775),
        (D(2024, 5, 1), "GDP", 1.5), (D(2024, 5, 1), "GEV_Close", 175.634)]


def test_csv_with_quotes_short_rows_and_bad_dates(spark, tmp_path):
    d = tmp_path / "px"
    d.mkdir()
    (d / "AAA_monthly.csv").write_text('"Date","AAA_Close","AAA_Volume"\n"2020-01-01","1,5","10"\n2020-02-01,2.5\n'
                                       'not a date,9,9\n2020-03-01,"3.5",30\n')
    got = rows(files.read_price_csvs(spark, str(d)), "ticker", "month", "close", "volume")
    assert got == [("AAA", D(2020, 1, 1), None, 10.0), ("AAA", D(2020, 2, 1), 2.5, None), ("AAA", D(2020, 3, 1), 3.5, 30.0)]
    assert [r.n_rejected for r in files.rejected_rows(spark, str(d)).collect()] == [1]


def test_wide_tables_keep_their_own_headers(spark, tmp_path):
    d = tmp_path / "combined"
    d.mkdir()
    (d / "a.csv").write_text(",AAA_Close,GDP\n2024-04-01,10.0,1.5\n")
    (d / "b.csv").write_text(",GDP,BBB_Close\n2024-04-01,1.5,99.0\n2024-05-01,1.5,\n")
    got = files.read_wide_combined(spark, str(d)).collect()
    assert {(r.month, r.series_id, r.value) for r in got} == {
        (D(2024, 4, 1), "AAA_Close", 10.0), (D(2024, 4, 1), "GDP", 1.5), (D(2024, 4, 1), "BBB_Close", 99.0),
        (D(2024, 5, 1), "GDP", 1.5), (D(2024, 5, 1), "BBB_Close", None)}


def test_json_rows_survive_keep_first(spark, landed):
    ind = files.read_indicator_csvs(spark, str(landed / "fred")).unionByName(
        files.read_observations_json(spark, str(landed / "json")))
    kept = {(r.series_id, r.month): r.value for r in files.keep_first(ind, ["series_id", "month"]).collect()}
    assert kept[("M2SL", D(2015, 1, 1))] == 1.5 and kept[("M2SL", D(2015, 3, 1))] == 2.5
    assert ("M2SL", D(2015, 2, 1)) not in kept and kept[("GDP", D(2015, 1, 1))] == 20000.0


def test_an_empty_result_leaves_the_old_table(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.createDataFrame([("A", 1.0), ("B", 2.0)], "ticker string, v double")
    sinks.write_table(df, path)
    with pytest.raises(sinks.EmptyResultError):
        sinks.write_table(df.limit(0), path)
    assert rows(spark.read.parquet(path)) == [("A", 1.0), ("B", 2.0)]
    parts = str(tmp_path / "p")
    sinks.write_table(df, parts, ["ticker"])
    with pytest.raises(sinks.EmptyResultError):
        sinks.write_table(df.limit(0), parts, ["ticker"])
    assert spark.read.parquet(parts).count() == 2
    assert sorted(p.name for p in tmp_path.iterdir()) == ["p", "t"]


def test_no_landed_row_vanishes(spark, tmp_path):
    d = tmp_path / "px"
    d.mkdir()
    (d / "AAA_monthly.csv").write_text("2020-01-01,1.5,10\n2020-02-01,2.5,11\n")          # no header row
    more = ",".join(f"o{k}" for k in range(1, 12))
    (d / "BBB_monthly.csv").write_text(f"\ufeffDate,{more},BBB_Close,BBB_Volume\r\n2020-01-01,{','.join('7' * 11)},3.5,9\r\n")
    (d / "CCC.csv").write_text('\n"Date","Open, first","Close","Volume"\n2020-01-01,"1,000",4.5,8\nlater,1,2,3\n')
    (d / "DDD.csv").write_text("Date,Open\n2020-01-01,4.5\n")                             # no close
    got = rows(files.read_price_csvs(spark, str(d)), "ticker", "month", "close", "volume")
    assert got == [("BBB", D(2020, 1, 1), 3.5, 9.0), ("CCC", D(2020, 1, 1), 4.5, 8.0)]
    rejects = {(r.file.rsplit("/", 1)[1], r.reason): r.n_rejected for r in files.rejected_rows(spark, str(d), "prices").collect()}
    assert rejects == {("AAA_monthly.csv", "no header"): 2, ("CCC.csv", "no date"): 1, ("DDD.csv", "no value column"): 1}
    j = tmp_path / "json"
    j.mkdir()
    (j / "X.json").write_text('{"observations": [{"date": "2020-01-01", "value": "1"}, {"value": "2"}, {"date": "?", "value": "3"}]}')
    (j / "Y.json").write_text('{"other": 1}')
    assert files.read_observations_json(spark, str(j)).count() == 1
    rejects = {(r.file.rsplit("/", 1)[1], r.reason): r.n_rejected for r in files.rejected_observations(spark, str(j)).collect()}
    assert rejects == {("X.json", "no date"): 2, ("Y.json", "no observations"): 1}


def test_a_failed_write_leaves_the_old_version(spark, tmp_path, monkeypatch):
    table, parts = str(tmp_path / "t"), str(tmp_path / "p")
    old = spark.createDataFrame([("A", 1, 1.0), ("B", 1, 2.0)], "ticker string, horizon int, v double")
    new = spark.createDataFrame([("B", 1, 5.0), ("C", 2, 6.0)], "ticker string, horizon int, v double")
    sinks.write_table(old, table)
    sinks.write_table(old, parts, ["ticker", "horizon"])
    rename = sinks._Folder.rename
    for fail_at in (1, 2, 3, 4):
        calls = []

        def broken(self, a, b, calls=calls, fail_at=fail_at):
            calls.append(a)
            if len(calls) == fail_at:
                raise OSError("injected")
            rename(self, a, b)

        monkeypatch.setattr(sinks._Folder, "rename", broken)
        for path, by, n in ((table, [], 2), (parts, ["ticker", "horizon"], 3)):
            calls.clear()
            if fail_at <= n:
                with pytest.raises(OSError, match="injected"):
                    sinks.write_table(new, path, by, replace="partitions" if by else "table")
                assert rows(sinks.read_table(spark, path), "ticker", "v") == [("A", 1.0), ("B", 2.0)]
        monkeypatch.setattr(sinks._Folder, "rename", rename)
    sinks.write_table(new, parts, ["ticker", "horizon"], replace="partitions")
    assert rows(sinks.read_table(spark, parts), "ticker", "v") == [("A", 1.0), ("B", 5.0), ("C", 6.0)]
    sinks.write_table(new, parts, ["ticker", "horizon"])
    assert rows(sinks.read_table(spark, parts), "ticker", "v") == [("B", 5.0), ("C", 6.0)]
    # a writer killed between its renames
    (tmp_path / "t").rename(tmp_path / "t.old-1")
    assert rows(sinks.read_table(spark, table), "ticker", "v") == [("A", 1.0), ("B", 2.0)]
    assert sorted(x.name for x in tmp_path.iterdir()) == ["p", "t"]
