"""Keyed trees against a plain learner on the same bins."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelcast.operators import trees
from panelcast.plans import pipeline

FEATS = ["a", "b", "c"]


@pytest.fixture(scope="module")
def panel(spark):
    r = np.random.default_rng(3)
    rows = []
    for k, t in enumerate(("AA", "BB", "CC")):
        for m in range(48):
            a, b, c = r.normal(size=3).round(3).tolist()
            y = round(float(100 + 20 * (k == 0) * (a > 0) + 15 * (k == 1) * b + 5 * c + r.normal()), 4)
            rows.append((t, dt.date(2020 + m // 12, m % 12 + 1, 1), a, b, c, y, m >= 38))
    rows += [("AA", dt.date(2030, 1, 1), None, 1.0, 1.0, 5.0, True), ("AA", dt.date(2030, 2, 1), 1.0, 1.0, 1.0, None, True),
             ("DD", dt.date(2020, 1, 1), 1.0, 2.0, 3.0, 4.0, False), ("EE", dt.date(2020, 1, 1), 1.0, 2.0, 3.0, 4.0, True)]
    return spark.createDataFrame(rows, "ticker string, month date, a double, b double, c double, y double, is_test boolean").repartition(5)


def plain_tree(bins, target, weight, depth, l2, scale):
    """{node: (n, feature, bin, gain, value, left, right)} by looking at all cuts."""
    out = {}

    def part(s, n):
        return (s / scale) * (s / scale) / (n + l2)

    def grow(node, at, level):
        at = [i for i in at if weight[i]]
        n, s = sum(weight[i] for i in at), sum(weight[i] * target[i] for i in at)
        best = None
        for f in range(bins.shape[1]):
            for b in sorted({bins[i, f] for i in at}):
                left = [i for i in at if bins[i, f] <= b]
                nl, sl = sum(weight[i] for i in left), sum(weight[i] * target[i] for i in left)
                if nl == n:
                    continue
                gain = part(sl, nl) + part(s - sl, n - nl) - part(s, n)
                if best is None or gain > best[0]:
                    best = (gain, f, b, nl, sl)
        value = lambda s, n: s / scale / (n + l2)
        if best is None or best[0] <= 0:
            out[node] = (n, None, None, 0.0, value(s, n), None, None)
            return
        gain, f, b, nl, sl = best
        out[node] = (n, f, int(b), gain, value(s, n), value(sl, nl), value(s - sl, n - nl))
        if level + 1 < depth:
            grow(2 * node + 1, [i for i in at if bins[i, f] <= b], level + 1)
            grow(2 * node + 2, [i for i in at if bins[i, f] > b], level + 1)

    grow(0, range(len(target)), 0)
    return out


def plain_value(tree, bins):
    node, value = 0, None
    while node in tree:
        _, f, b, _, own, left, right = tree[node]
        if f is None:
            return own
        node, value = (2 * node + 2, right) if bins[f] > b else (2 * node + 1, left)
    return value


def quantile_bins(train, x, n_bins):
    s = sorted(train)
    edges = [s[max(math.ceil(len(s) * k / n_bins), 1) - 1] for k in range(1, n_bins)]
    return sum(e < x for e in edges)


def test_forest_equals_a_plain_learner(panel):
    nodes, rows = trees.fit_forest(panel, FEATS, num_trees=4, max_depth=3, n_bins=8)
    got, data = {}, {}
    for r in nodes.collect():
        got.setdefault((r["ticker"], r["tree"]), {})[r["node"]] = tuple(
            r[c] for c in ("n", "feature", "bin", "gain", "value", "left_value", "right_value"))
    for r in rows.collect():
        data.setdefault(r["ticker"], []).append(r)
    assert set(data) == {"AA", "BB", "CC", "DD", "EE"} and {t for t, _ in got} <= {"AA", "BB", "CC", "DD"}
    share = {}
    for t, all_rows in data.items():
        train = [r for r in all_rows if not r["is_test"]]
        for r in train:
            assert list(r["bins"]) == [quantile_bins([x[f] for x in train], r[f], 8) for f in FEATS]
        for k in range(4):
            weight = [r["weights"][k] for r in train]
            if not any(weight):
                assert (t, k) not in got
                continue
            want = plain_tree(np.array([r["bins"] for r in train]), [r["target"] for r in train], weight, 3, 0.0, trees.SCALE)
            assert got[t, k] == want
            gains = [sum(v[3] for v in want.values() if v[1] == f) for f in range(3)]
            if sum(gains):
                share.setdefault(t, []).append([g / sum(gains) for g in gains])
    imp = {(r["ticker"], r["feature"]): r["importance"] for r in trees.importances(nodes, FEATS).collect()}
    for t in ("AA", "BB", "CC"):
        mean = np.mean(share[t], 0)
        assert [imp[t, f] for f in FEATS] == pytest.approx(list(mean / mean.sum()))
    assert [imp["DD", f] for f in FEATS] == [0.0, 0.0, 0.0]
    scored = trees.predict_forest(rows, nodes, 4, 3).collect()
    trees_of = lambda t: [got[t, k] for k in range(4) if (t, k) in got]
    for r in scored:
        bins = next(x["bins"] for x in data[r["ticker"]] if x["month"] == r["month"])
        said = [plain_value(tree, bins) for tree in trees_of(r["ticker"])]
        assert r["predicted"] == (pytest.approx(np.mean(said)) if said else None)


def test_draws_follow_the_poisson_law(spark):
    draws = spark.range(4000).select(F.explode(trees._bootstrap(["id"], 3, 7)).alias("w"))
    n = {r["w"]: r["count"] / 12_000 for r in draws.groupBy("w").count().collect()}
    assert n[0] == pytest.approx(math.exp(-1), abs=0.02) and n[1] == pytest.approx(math.exp(-1), abs=0.02)
    assert n[2] == pytest.approx(math.exp(-1) / 2, abs=0.02)


def test_boosting_equals_plain_rounds_and_beats_the_mean(panel):
    scored, nodes = trees.fit_boosted(panel, FEATS, rounds=6, max_depth=2, rate=0.5, n_bins=8)
    rows = scored.collect()
    assert len(rows) == 3 * 48 + 2 and sorted({r["tree"] for r in nodes.collect()}) == list(range(6))
    for t in ("AA", "BB", "CC"):
        own = sorted((r for r in rows if r["ticker"] == t), key=lambda r: r["month"])
        train = [r for r in own if not r["is_test"]]
        bins = np.array([[quantile_bins([x[f] for x in train], r[f], 8) for f in FEATS] for r in own])
        y = [r["y"] for r in train]
        mean, std = np.mean(y), np.std(y)
        at = np.zeros(len(own))
        z = np.array([(r["y"] - mean) / std for r in own])
        for _ in range(6):
            target = [round(v) for v in (z - at)[:len(train)] * trees.UNIT_SCALE]
            tree = plain_tree(bins[:len(train)], target, [1] * len(train), 2, 1.0, trees.UNIT_SCALE)
            at = at + 0.5 * np.array([plain_value(tree, b) for b in bins])
        assert [r["predicted"] for r in own] == pytest.approx(list(at * std + mean), rel=1e-5)
        errors = [abs(r["y"] - r["predicted"]) for r in train]
        assert sum(e * e for e in errors) < 0.5 * sum((v - mean) ** 2 for v in y)


def test_every_fold_is_scored_by_the_others(panel):
    out = {r["ticker"]: r for r in trees.cross_validate(panel.where("not is_test"), FEATS, num_trees=3, max_depth=3).collect()}
    assert all(out[t]["n_folds"] == 5 for t in ("AA", "BB", "CC")) and out["AA"]["cv_r2_mean"] > 0.3
    assert "EE" not in out


def test_models_are_one_grid(spark, panel):
    feat = panel.where("ticker in ('AA', 'BB') and y is not null").withColumnRenamed("y", "close").drop("is_test")
    feat = feat.withColumn("experiment", F.lit("x")).withColumn("flat", F.lit(1.0))
    bt = pipeline.model_backtests(feat, [*FEATS, "flat"], (1, 3), runs=("experiment", "ticker"), rounds=2, max_depth=2)
    rows = bt.collect()
    assert {(r["model"], r["horizon"], r["ticker"]) for r in rows} == {
        (m, h, t) for m in ("OLS", "LinearRegression", "GBT") for h in (1, 3) for t in ("AA", "BB")}
    assert all(r["predicted"] is not None for r in rows)
    with pytest.raises(ValueError, match="lstm"):
        pipeline.model_backtests(feat, FEATS, (1,), models=("lstm",))


def test_sweep_ranks_by_forests_and_fits_on_each_tickers_own_features(spark):
    from panelcast.plans.experiments import forest_features, forest_sweep
    r = np.random.default_rng(11)
    names = ["f0", "f1", "f2", "close"]
    rows = []
    for k, t in enumerate(("AA", "BB")):
        x = r.normal(size=(80, 3)).round(4)
        close = np.round(50 + 9 * x[:, 2 * k] + r.normal(size=80) * 0.2, 4)
        rows += [(t, dt.date(2010 + m // 12, m % 12 + 1, 1), float(close[m]), *map(float, x[m])) for m in range(80)]
    df = spark.createDataFrame(rows, "ticker string, month date, close double, f0 double, f1 double, f2 double").repartition(4)
    own = {q.ticker: q.top_features for q in forest_features(df, names[:3], 2, num_trees=10).collect()}
    assert own["AA"][0] == "f0" and own["BB"][0] == "f2" and all(len(v) == 2 for v in own.values())

    res, best = forest_sweep(df, names[:3], horizons=(1, 2), n_features=1, n_models=3, num_trees=10)
    got = {(q.ticker, q.horizon): q for q in res.collect()}
    assert set(got) == {(t, h) for t in ("AA", "BB") for h in (1, 2)}
    for (t, h), q in got.items():
        mine = [w for w in rows if w[0] == t]
        x = np.array([w[3 + ["f0", "f1", "f2"].index(q.top_features[0])] for w in mine])[:-h]
        y = np.array([w[2] for w in mine])[h:]
        n = len(y) - math.ceil(0.2 * len(y))
        a = np.c_[np.ones(n), x[:n]]
        said = np.c_[np.ones(len(y) - n), x[n:]] @ np.linalg.lstsq(a, y[:n], rcond=None)[0]
        assert q.rmse == pytest.approx(math.sqrt(np.mean((y[n:] - said) ** 2)), rel=1e-8)
        assert q.n == len(y) - n
    want = sorted(got.values(), key=lambda q: -q.r2)[:3]
    assert [(q.ticker, q.horizon) for q in best.collect()] == [(q.ticker, q.horizon) for q in want]
    empty, _ = forest_sweep(df.limit(0), names[:3], horizons=(1,), num_trees=2, max_depth=2)
    assert empty.count() == 0
