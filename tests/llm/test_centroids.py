"""Centroid clustering against plain Python."""

import hashlib
import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from panelcast.llm import centroids as ce

EMB = "vec_id long, embedding array<float>, cluster string"


def plain(rows, k=ce.K, rounds=ce.ROUNDS, dim=ce.DIM):
    kept = [(i, [math.floor(256 * x) for x in v]) for i, v in rows
            if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    name = lambda i: hashlib.sha256(f"2:{i}".encode()).hexdigest()
    cents = [v for _, v in sorted(kept, key=lambda r: (r[0] is None, name(r[0]), r[1]))[:k]]
    dist = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c, strict=True))
    best = lambda v: min((dist(v, c), j) for j, c in enumerate(cents))
    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(best(v)[1], []).append(v)
        cents = [[sum(x) // len(groups[j]) for x in zip(*groups[j], strict=True)] if j in groups else c for j, c in enumerate(cents)]
    ends = [(i, *best(v)) for i, v in kept]
    total = sum(d for _, d, _ in ends)
    return [(i, j, d, sum(e for _, e, f in ends if f == j), total,
             hashlib.sha256(",".join(map(str, cents[j])).encode()).hexdigest()) for i, d, j in ends]


def got(df):
    return sorted(tuple(r)[:6] for r in df.collect())


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 2**32 - 1), st.sampled_from([1, 3, 300, 2**26]), st.integers(1, 9))
def test_bounds_never_lose_the_nearest(seed, spread, dim):
    r = np.random.default_rng(seed)
    x, c = r.integers(-spread, spread + 1, (50, dim)), r.integers(-spread, spread + 1, (12, dim))
    c[5:8] = x[3]
    pivots = ce.pick_pivots(c, 5)
    near = ce.Nearest(c, pivots)
    exact = np.stack([ce.squared(x, v) for v in c], 1)
    bound = near.bounds(ce.pivot_distances(x, pivots))
    assert (bound ** 2 <= exact).all()
    cluster, dist, measured = near.find(x, ce.pivot_distances(x, pivots))
    assert (cluster == exact.argmin(1)).all() and (dist == exact.min(1)).all() and measured.max() <= 12


def test_bounds_leave_out_most_centroids_of_parted_groups():
    r = np.random.default_rng(1)
    c = r.integers(-4000, 4000, (40, 64))
    x = c[r.integers(0, 40, 500)] + r.integers(-40, 40, (500, 64))
    pivots = ce.pick_pivots(c, 8)
    assert ce.Nearest(c, pivots).find(x, ce.pivot_distances(x, pivots))[2].mean() < 10


def test_report_equals_plain_python(spark):
    r = np.random.default_rng(5)
    centre = r.normal(0, 1, (6, 64))
    rows = [(k, (centre[k % 6] + r.normal(0, 0.2, 64)).astype(np.float32).tolist()) for k in range(150)]
    rows += [(200 + k, rows[7][1]) for k in range(30)] + [(9, rows[9][1]), (9, rows[10][1]), (None, rows[11][1])]
    odd = [(900, None), (901, []), (902, [0.5] * 63), (903, [0.5] * 65), (904, [None] + [0.5] * 63),
           (905, [math.nan] + [0.5] * 63), (906, [math.inf] * 64), (907, [-0.001] * 64)]
    df = spark.createDataFrame([(*x, "other") for x in rows + odd], EMB).repartition(4)
    want = plain(rows + odd)
    rest = lambda v: sorted(t for t in v if t[0] is not None)
    out = [tuple(x)[:6] for x in ce.report(df).collect()]
    assert rest(out) == rest(want)
    assert [t for t in out if t[0] is None] == [t for t in want if t[0] is None]


def test_few_or_no_vectors(spark):
    empty = spark.createDataFrame([], EMB)
    assert ce.report(empty).collect() == []
    one = [(1, [0.1] * 64), (2, [0.1] * 64), (3, [5.0] * 64)]
    assert got(ce.report(spark.createDataFrame([(*x, None) for x in one], EMB))) == sorted(plain(one))
    assert ce.report(empty).columns == ce.report(spark.createDataFrame([(*x, None) for x in one], EMB)).columns


def test_too_large_components_are_named(spark):
    with pytest.raises(Exception, match="beyond"):
        ce.report(spark.createDataFrame([(1, [1e30] * 64, None)], EMB)).collect()
