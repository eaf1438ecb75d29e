"""Centroid clustering of whole-number vectors with Ptolemaic pivots.

Vectors become whole numbers, floor(scale * x). A few fixed pivots are taken
from the first centroids, and each vector's distances to them are worked out
once and kept beside it. For a vector v, a centroid c and two pivots p and s,
Ptolemy's inequality gives

    d(v, c) >= |d(v, p) d(c, s) - d(v, s) d(c, p)| / d(p, s).

In each pass the centroid with the least bound is measured exactly; only those
whose bound, rounded down, doesn't exceed that distance are measured too. Bounds
only leave out centroids that are farther, so results are exact, ties included.

Each task adds up the vectors of each cluster before anything is shuffled; the
driver holds ``k`` centroids and ``k`` sums, whatever the input. The vectors and
their pivot distances are written once to the shared folder.

Kept are vectors of exactly ``dim`` components, none null or not finite; a null
vector is left out. The first centroids are ordered by the hash of their id,
then by their components (a null id comes last); with fewer kept vectors than
``k`` there are as many centroids. Repeated rows and null ids count like others.
Columns other than the id and the vector are ignored. No kept vector: no rows.
Components beyond +-2**27 after scaling raise an error, as a squared distance
wouldn't fit a long.
"""

from __future__ import annotations

import hashlib
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import stage

K, ROUNDS, DIM, SCALE, SEED = 40, 5, 64, 256, "2"
PIVOTS = 8               # fixed pivots; every two of them are a pair
LARGEST = 1 << 27        # of a component
BLOCK_ROWS = 4096
_SLACK = 2.0 ** -46      # far above the rounding of one bound's few operations


def whole_vectors(col: pa.Array, dim: int, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the kept vectors, and their whole-number components."""
    col = pa.concat_arrays([col.cast(pa.list_(pa.float64()))])
    right = pc.fill_null(pc.equal(pc.list_value_length(col), dim), False)
    at = np.flatnonzero(right.to_numpy(zero_copy_only=False))
    flat = pc.list_flatten(col.take(pa.array(at)))
    x = pc.fill_null(flat, float("nan")).to_numpy(zero_copy_only=False).reshape(-1, dim)
    good = np.isfinite(x).all(1)
    x = np.floor(scale * x[good])
    if len(x) and np.abs(x).max() > LARGEST:
        raise ValueError(f"a component is beyond {LARGEST} after scaling")
    return at[good], x.astype(np.int64)


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of the rows of ``x`` to one vector or as many."""
    d = x - c
    return np.einsum("ij,ij->i", d, d)


def pivot_distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.stack([squared(x, p) for p in pivots], 1)) if len(pivots) else np.zeros((len(x), 0))


def pick_pivots(centroids: np.ndarray, count: int) -> np.ndarray:
    """Of the first centroids, the first and then always the one farthest from
    those taken; equal vectors are taken once."""
    taken = [centroids[0]]
    least = squared(centroids, centroids[0])
    while len(taken) < count and least.max() > 0:
        taken.append(centroids[int(least.argmax())])
        least = np.minimum(least, squared(centroids, taken[-1]))
    return np.array(taken)


class Nearest:
    """Nearest centroid by Ptolemaic bounds and exact checks."""

    def __init__(self, centroids: np.ndarray, pivots: np.ndarray):
        self.centroids = centroids
        self.pairs = list(combinations(range(len(pivots)), 2))
        self.between = pivot_distances(pivots, pivots)
        self.to_pivots = pivot_distances(centroids, pivots)

    def bounds(self, near: np.ndarray) -> np.ndarray:
        """Lower bounds of the distances to every centroid, rounded down."""
        best = np.zeros((len(near), len(self.centroids)))
        for p, s in self.pairs:
            a = near[:, p, None] * self.to_pivots[None, :, s]
            b = near[:, s, None] * self.to_pivots[None, :, p]
            np.maximum(best, (np.abs(a - b) - _SLACK * (a + b)) / self.between[p, s], out=best)
        return best * (1 - _SLACK)

    def find(self, x: np.ndarray, near: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(cluster, squared distance, centroids measured) of whole-number rows."""
        bound = self.bounds(near)
        first = bound.argmin(1)
        cluster, dist = first.copy(), squared(x, self.centroids[first])
        left = bound * bound * (1 - _SLACK) <= dist[:, None]
        left[np.arange(len(x)), first] = False
        for c in range(len(self.centroids)):
            at = np.flatnonzero(left[:, c])
            d = squared(x[at], self.centroids[c])
            closer = (d < dist[at]) | (d == dist[at]) & (c < cluster[at])
            dist[at[closer]], cluster[at[closer]] = d[closer], c
        return cluster, dist, left.sum(1) + 1


def _matrix(col: pa.Array, width: int, kind) -> np.ndarray:
    col = pa.concat_arrays([col])
    return np.frombuffer(b"".join(col.to_pylist()), kind).reshape(len(col), width)


def _bytes(rows: np.ndarray) -> pa.Array:
    return pa.array([r.tobytes() for r in np.ascontiguousarray(rows)], pa.binary())


def _blocks(batches):
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK_ROWS):
            yield batch.slice(at, BLOCK_ROWS)


def _found(batches, nearest: Nearest, dim: int):
    pivots = len(nearest.between)
    for block in _blocks(batches):
        x = _matrix(block.column("whole"), dim, np.int64)
        yield block, x, nearest.find(x, _matrix(block.column("near"), pivots, np.float64))


def first_centroids(df: DataFrame, key: str, vector: str, k: int, dim: int, scale: int, seed: str) -> np.ndarray:
    """The ``k`` kept vectors with the smallest hash, as whole numbers; only they
    come to the driver."""
    def run(batches):
        for batch in batches:
            at, x = whole_vectors(batch.column(vector), dim, scale)
            yield pa.RecordBatch.from_arrays([batch.column(key).take(pa.array(at)), pa.array(x.tolist(), pa.list_(pa.int64()))],
                                             names=["id", "whole"])

    schema = T.StructType([T.StructField("id", df.schema[key].dataType), T.StructField("whole", T.ArrayType(T.LongType()))])
    rank = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")).cast("binary"), 256)
    rows = (df.select(key, vector).mapInArrow(run, schema).select(rank.alias("rank"), "whole")
            .orderBy(F.asc_nulls_last("rank"), "whole").limit(k).collect())
    return np.array([r["whole"] for r in rows], np.int64).reshape(len(rows), dim)


def _floor_means(sums: np.ndarray, counts: np.ndarray, old: np.ndarray) -> np.ndarray:
    out = old.copy()
    some = counts > 0
    out[some] = sums[some] // counts[some, None]
    return out


def digest(centroid: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, centroid.tolist())).encode()).hexdigest()


def cluster(df: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = K, rounds: int = ROUNDS, dim: int = DIM,
            scale: int = SCALE, seed: str = SEED, pivots: int = PIVOTS) -> tuple[DataFrame, np.ndarray]:
    """((key, cluster, distance, n_checked) of every kept vector, final centroids).

    ``n_checked`` is how many centroids the last pass measured for the vector.
    """
    own = df.select(F.col(f"`{key}`").alias("vec_id"), F.col(f"`{vector}`").alias("vector"))
    schema = T.StructType([T.StructField("vec_id", own.schema["vec_id"].dataType), T.StructField("cluster", T.IntegerType()),
                           T.StructField("distance", T.LongType()), T.StructField("n_checked", T.IntegerType())])
    centroids = first_centroids(own, "vec_id", "vector", k, dim, scale, seed)
    if not len(centroids):
        return df.sparkSession.createDataFrame([], schema), centroids
    fixed = pick_pivots(centroids, pivots)

    def prepare(batches):
        for batch in _blocks(batches):
            at, x = whole_vectors(batch.column("vector"), dim, scale)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id").take(pa.array(at)), _bytes(x), _bytes(pivot_distances(x, fixed))],
                                             names=["vec_id", "whole", "near"])

    kept = stage(own.mapInArrow(prepare, T.StructType([schema["vec_id"], T.StructField("whole", T.BinaryType()),
                                                       T.StructField("near", T.BinaryType())])), "whole-vectors")
    sums = [f"s{j}" for j in range(dim)]

    for _ in range(rounds):
        nearest = Nearest(centroids, fixed)

        def add_up(batches, nearest=nearest, n=len(centroids)):
            total, count = np.zeros((n, dim), np.int64), np.zeros(n, np.int64)
            for _, x, (own_cluster, _, _) in _found(batches, nearest, dim):
                for c in np.unique(own_cluster):
                    total[c] += x[own_cluster == c].sum(0)
                count += np.bincount(own_cluster, minlength=n)
            at = np.flatnonzero(count)
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(count[at]), *map(pa.array, total[at].T)],
                                             names=["cluster", "n", *sums])

        parts = kept.mapInArrow(add_up, "cluster int, n long, " + ", ".join(f"{s} long" for s in sums))
        total, count = np.zeros_like(centroids), np.zeros(len(centroids), np.int64)
        for r in parts.groupBy("cluster").agg(*[F.sum(c).alias(c) for c in ("n", *sums)]).collect():
            count[r["cluster"]], total[r["cluster"]] = r["n"], [r[s] for s in sums]
        centroids = _floor_means(total, count, centroids)

    nearest = Nearest(centroids, fixed)

    def assign(batches):
        for block, x, (own_cluster, dist, checked) in _found(batches, nearest, dim):
            yield pa.RecordBatch.from_arrays([
                block.column("vec_id"), pa.array(own_cluster, pa.int32()), pa.array(dist, pa.int64()),
                pa.array(checked, pa.int32())], names=schema.names)

    return kept.mapInArrow(assign, schema), centroids


def report(embeddings: DataFrame) -> DataFrame:
    """Cluster, distance, inertia of the cluster and of all, and the centroid's
    digest, of every kept vector."""
    found, centroids = cluster(embeddings)
    if not len(centroids):
        return found.select("vec_id", "cluster", "distance", F.col("distance").alias("cluster_inertia"),
                            F.col("distance").alias("inertia"), F.lit("").alias("centroid_sha256"))
    found = stage(found, "clusters")
    inertia = {r["cluster"]: r["s"] for r in found.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
    of_cluster = found.sparkSession.createDataFrame(
        [(c, inertia.get(c, 0), sum(inertia.values()), digest(v)) for c, v in enumerate(centroids)],
        "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return (found.join(F.broadcast(of_cluster), "cluster")  # one row for each of the k clusters
            .select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"))


def _oracle() -> str:
    near = """select v, vec_id, c, d from (
        select a.v, a.vec_id, b.c, sum((a.x - b.x) * (a.x - b.x))::bigint as d from parts a join {0} b using (k) group by all)
        qualify row_number() over (partition by v order by d, c) = 1"""
    move = """select o.c, o.k, coalesce((m.s - ((m.s % m.n) + m.n) % m.n) // m.n, o.x)::bigint as x from {0} o left join (
        select n.c, p.k, sum(p.x)::bigint as s, count(*) as n from {1} n join parts p using (v) group by all) m using (c, k)"""
    steps = []
    for r in range(ROUNDS):
        steps += [f"a{r} as materialized ({near.format(f'c{r}')})", f"c{r + 1} as materialized ({move.format(f'c{r}', f'a{r}')})"]
    return f"""
with kept as materialized (
  select row_number() over () as v, vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::double)::bigint) as xs
  from embeddings where len(embedding) = {DIM} and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = {DIM}),
parts as materialized (select v, vec_id, unnest(xs) as x, generate_subscripts(xs, 1) as k from kept),
c0 as materialized (
  select c, unnest(xs) as x, generate_subscripts(xs, 1) as k from (
    select row_number() over (order by sha256('{SEED}:' || vec_id::varchar) nulls last, xs) - 1 as c, xs from kept) where c < {K}),
{', '.join(steps)},
final as materialized ({near.format(f'c{ROUNDS}')}),
digests as (select c, sha256(string_agg(x::varchar, ',' order by k)) as s from c{ROUNDS} group by c)
select f.vec_id, f.c::int as cluster, f.d as distance, sum(f.d) over (partition by f.c)::bigint as cluster_inertia,
  sum(f.d) over ()::bigint as inertia, s as centroid_sha256
from final f join digests using (c)"""


ORACLE = _oracle()
