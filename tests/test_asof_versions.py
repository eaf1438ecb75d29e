"""As-of joins of rows at any times, and versioned models."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from panelcast.operators import align, forecast
from panelcast.plans import monitoring
from panelcast.sources import sinks

T0 = dt.datetime(2024, 1, 1)
D = dt.date


def at(minute):
    return None if minute is None else T0 + dt.timedelta(minutes=minute)


@pytest.mark.parametrize("segments", [2, 7, 256])
def test_asof_equals_brute_force(spark, segments):
    r = random.Random(segments)
    keys = ["a", "b", "c", None, "hot"]
    left = [(r.choice(keys + ["hot"] * 6), at(r.choice([None, *range(80)])), k) for k in range(300)]
    right = [(r.choice(keys[:2] + [None] + ["hot"] * 3), at(r.choice([None, *range(10, 90)])), k, r.choice([None, 1.5, float(k)])) for k in range(150)]
    ldf = spark.createDataFrame(left, "key string, ts timestamp, id long").repartition(4)
    rdf = spark.createDataFrame(right, "key string, ts timestamp, seq long, v double").repartition(3)
    got = {r["id"]: (r["seq"], r["v"]) for r in align.asof_join(ldf, rdf, "ts", ["seq", "v"], by="key", tie=["seq"], segments=segments).collect()}
    want = {}
    for key, ts, k in left:
        before = [x for x in right if key is not None and ts is not None and x[0] == key and x[1] is not None and x[1] <= ts]
        best = max(before, key=lambda x: (x[1], x[2]), default=None)
        want[k] = (best[2], best[3]) if best else (None, None)
    assert got == want


@pytest.mark.parametrize("segments", [2, 7, 256])
def test_asof_of_one_series_equals_brute_force(spark, segments):
    r = random.Random(segments)
    left = [(at(r.choice([None, *range(200)])), k) for k in range(400)]
    right = [(at(r.choice([None, *range(20, 60), *range(120, 190)])), k, r.choice([None, 1.5, float(k)])) for k in range(120)]
    ldf = spark.createDataFrame(left, "ts timestamp, id long").repartition(4)
    rdf = spark.createDataFrame(right, "ts timestamp, seq long, v double").repartition(3)
    got = {r["id"]: (r["seq"], r["v"]) for r in align.asof_join(ldf, rdf, "ts", ["seq", "v"], tie=["seq"], segments=segments).collect()}
    want = {}
    for ts, k in left:
        best = max((x for x in right if ts is not None and x[0] is not None and x[0] <= ts), key=lambda x: (x[0], x[1]), default=None)
        want[k] = (best[1], best[2]) if best else (None, None)
    assert got == want


def test_asof_of_one_series_moves_its_rows_once(spark):
    # joins of all rows to the list of segments or of their carries, and a lambda a row and edge, took most of the time
    ldf = spark.range(50).select(F.timestamp_seconds("id").alias("ts"), "id")
    rdf = spark.range(9).select(F.timestamp_seconds(F.col("id") * 7).alias("ts"), F.col("id").alias("v"))
    plan = align.asof_join(ldf, rdf, "ts", ["v"])._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "lambdafunction" not in plan


@pytest.mark.parametrize("most", [1, 2, 6, 7, 8, 255])
def test_edges_below(spark, most):
    edges = sorted(random.Random(most).choices(range(300), k=most))
    df = spark.range(-2, 302).select("id", F.array(*[F.lit(e).cast("long") for e in edges]).alias("edges"))
    got = {r["id"]: r["n"] for r in align._edges_below("edges", F.col("id"), df, "n", most).collect()}
    assert got == {k: sum(e < k for e in edges) for k in range(-2, 302)}


def test_asof_of_empty_sides(spark):
    ldf = spark.createDataFrame([(at(1), 1)], "ts timestamp, id long")
    rdf = spark.createDataFrame([(at(0), 9)], "ts timestamp, v long")
    assert align.asof_join(ldf, rdf.limit(0), "ts", ["v"]).collect()[0]["v"] is None
    assert align.asof_join(ldf.limit(0), rdf, "ts", ["v"]).count() == 0
    assert align.asof_join(ldf, rdf, "ts", ["v"]).collect()[0]["v"] == 9


def test_values_are_carried_over_segments_without_any(spark):
    rows = [("x", at(k), k, 1.0 if k == 3 else 2.0 if k == 90 else None) for k in range(100)]
    df = spark.createDataFrame(rows, "key string, ts timestamp, seq long, v double").repartition(5)
    got = {r["seq"]: r["last"] for r in align.carry_last(df, "key", "ts", ["seq"], "v", "last", 16).collect()}
    assert got == {k: None if k < 3 else 1.0 if k < 90 else 2.0 for k in range(100)}


def test_values_of_one_series_are_carried_over_segments_without_any(spark):
    rows = [(at(k), k, 1.0 if k == 3 else 2.0 if k == 90 else None) for k in range(100)]
    df = spark.createDataFrame(rows, "ts timestamp, seq long, v double").repartition(5)
    got = {r["seq"]: r["last"] for r in align.carry_last(df, None, "ts", ["seq"], "v", "last", 16).collect()}
    assert got == {k: None if k < 3 else 1.0 if k < 90 else 2.0 for k in range(100)}


@pytest.fixture(scope="module")
def versions(spark, tmp_path_factory):
    rows = [(t, D(2020 + m // 12, m % 12 + 1, 1), float(m % 7), float(m * m % 11), m, s) for t, s in (("A", 1.0), ("B", -2.0)) for m in range(48)]
    df = spark.createDataFrame([(t, d, a, b, 10 + s * a - 3 * s * b, m >= 40) for t, d, a, b, m, s in rows],
                               "ticker string, month date, a double, b double, y double, is_test boolean")
    path = str(tmp_path_factory.mktemp("models") / "linear")
    starts = df.groupBy("ticker").agg(F.lit(D(2020, 6, 1)).alias("valid_from"))
    coef, stats = forecast.fit_ols(df, ["a", "b"])
    monitoring.save_versions(monitoring.linear_version(coef, stats, ["a", "b"], starts, "linear", 1), path)
    later = starts.where("ticker = 'A'").withColumn("valid_from", F.lit(D(2022, 1, 1)))
    one = forecast.fit_ols_single(df, "a")
    monitoring.save_versions(monitoring.single_version(one, "a", later, "linear", 2), path)
    return df, path, one


def test_the_version_in_force_scores(spark, versions):
    df, path, one = versions
    data = df.unionByName(spark.createDataFrame([("A", D(2023, 1, 1), None, 1.0, 0.0, True)], df.schema))
    rows = monitoring.score_versions(data, sinks.read_table(spark, path), ["a", "b"]).collect()
    line = {r["ticker"]: r for r in one.collect()}
    assert len(rows) == 2 * 43
    for r in rows:
        assert r["version"] == (2 if r["ticker"] == "A" and r["month"] >= D(2022, 1, 1) else 1)
        want = line["A"]["intercept"] + line["A"]["slope"] * r["a"] if r["version"] == 2 else r["y"]
        assert r["predicted"] == pytest.approx(want, abs=1e-6)


def test_a_stream_is_scored(spark, versions, tmp_path):
    df, path, _ = versions
    df.write.parquet(str(tmp_path / "feed"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "feed"))
    q = (monitoring.score_versions(stream, sinks.read_table(spark, path), ["a", "b"]).writeStream.format("parquet")
         .option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start(str(tmp_path / "out")))
    q.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2 * 43
