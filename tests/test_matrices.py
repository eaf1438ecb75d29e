"""Moment matrices of keys: merged over tasks, wide tables, odd keys and gaps."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelcast.functions import stats
from panelcast.operators import matrices, metrics


def _numpy(rows):
    x = np.array([r for r in rows if not any(v is None or np.isnan(v) for v in r)], dtype=float)
    z = x - x.mean(axis=0)
    return np.vstack([np.full(x.shape[1], len(x)), x.mean(axis=0), z.T @ z])


@pytest.mark.parametrize("task_bytes, batch_bytes, subkeys", [(64 << 20, 8 << 20, 64), (1, 1, 2), (1, 8 << 20, 1)])
def test_matrices_of_two_keys(spark, monkeypatch, task_bytes, batch_bytes, subkeys):
    monkeypatch.setattr(matrices, "TASK_BYTES", task_bytes)
    monkeypatch.setattr(matrices, "BATCH_BYTES", batch_bytes)
    monkeypatch.setattr(matrices, "SUBKEYS", subkeys)
    rng = np.random.default_rng(4)
    rows = [(k, n, float(v[0]), float(v[1]), None if i % 17 == 0 else float(v[2]))
            for i, (k, n, v) in enumerate(zip(rng.choice(["a", "b \"x", "é", None], 700), rng.choice([1, 2, None], 700),
                                              rng.normal(1e6, 1, (700, 3))))]
    rows = [(None if k is None else str(k), None if n is None else int(n), *v) for k, n, *v in rows]
    rows += [("hot", 1, float(i), 2.0 * i, float("nan") if i == 9 else -float(i)) for i in range(900)]
    df = spark.createDataFrame(rows, "name string, n int, x double, y double, z double").repartition(7)
    got = {(r["name"], r["n"]): np.frombuffer(r["m"]).reshape(5, 3)
           for r in matrices.key_matrices(df, ["name", "n"], ["x", "y", "z"]).collect()}
    assert set(got) == {r[:2] for r in rows}
    for at, m in got.items():
        np.testing.assert_allclose(m, _numpy([r[2:] for r in rows if r[:2] == at]), rtol=1e-9, atol=1e-7)
    whole = matrices.key_matrices(df, [], ["x", "y"]).collect()
    assert len(whole) == 1
    np.testing.assert_allclose(np.frombuffer(whole[0]["m"]).reshape(4, 2), _numpy([r[2:4] for r in rows]), rtol=1e-9)
    assert matrices.key_matrices(df.limit(0), ["name"], ["x"]).count() == 0


def test_keys_with_gaps_only_have_no_rows_in_their_matrix(spark):
    df = spark.createDataFrame([("a", None, 1.0), ("a", 2.0, None)], "k string, x double, y double")
    m = np.frombuffer(matrices.key_matrices(df, ["k"], ["x", "y"]).first()["m"])
    assert not m.any()


def test_correlations_of_150_columns(spark):
    k = 150
    df = spark.range(400).select(F.lit("a").alias("ticker"), *[
        (F.sin(F.col("id") * (j + 1)) + F.col("id") * (j % 3)).alias(f"c{j}") for j in range(k)])
    out = metrics.correlation_matrix(df, [f"c{j}" for j in range(k)], digits=None)
    got = {(r.col_a, r.col_b): r.r for r in out.collect()}
    want = np.corrcoef(df.drop("ticker").toPandas().to_numpy().T)
    assert len(got) == k * k
    assert max(abs(got[f"c{i}", f"c{j}"] - want[i, j]) for i in range(k) for j in range(k)) < 1e-9


def test_nested_residuals_are_those_of_every_fit():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(80, 6))
    x[:, 3] = x[:, 0] + x[:, 1]
    z = x - x.mean(axis=0)
    got = stats.nested_ssr(z.T @ z)
    for p in range(5):
        fit = z[:, : p + 1] @ np.linalg.lstsq(z[:, : p + 1], z[:, 5], rcond=None)[0]
        assert got[p] == pytest.approx(((z[:, 5] - fit) ** 2).sum(), rel=1e-9)
