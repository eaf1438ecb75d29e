"""Mergeable matrices of moments: one for each key, of any number of columns.

A task folds its rows into one matrix per key, whatever their number, so the
shuffle carries a matrix for each task and key. A key's matrices are merged in
two steps, first by (key, sub-key), so a hot key is spread over tasks. A task
reads them in order and holds one running total, never a whole group. The plan
is the same for any number of columns.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

SUBKEYS = 64            # of a key in the first merge
TASK_BYTES = 64 << 20   # of matrices that a task holds before it hands them on
BATCH_BYTES = 8 << 20   # in one batch of merged matrices


def complete_rows(x: np.ndarray) -> np.ndarray:
    """Moments of the rows without a gap: counts, means, then the matrix of
    centred products."""
    x = x[~np.isnan(x).any(axis=1)]
    mean = x.mean(axis=0) if len(x) else np.zeros(x.shape[1])
    z = x - mean
    return np.vstack([np.full(x.shape[1], float(len(x))), mean, z.T @ z])


def merge_complete(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``complete_rows`` of two blocks together."""
    n = a[0] + b[0]
    d = b[1] - a[1]
    share = b[0] / np.maximum(n, 1)
    return np.vstack([n, a[1] + d * share, a[2:] + b[2:] + np.outer(d, d) * (a[0] * share)[0]])


def _frame(names: list, totals: list) -> pd.DataFrame:
    return pd.DataFrame({"_k": [n[0] for n in names], "_s": [n[1] for n in names],
                         "m": [t.tobytes() for t in totals]})


def key_matrices(df: DataFrame, keys: Sequence[str], cols: Sequence[str],
                 of_rows: Callable[[np.ndarray], np.ndarray] = complete_rows,
                 merge: Callable[[np.ndarray, np.ndarray], np.ndarray] = merge_complete) -> DataFrame:
    """(keys..., m): the merged matrix of each key's rows over ``cols``, as the
    bytes of its doubles. A missing value is NaN for ``of_rows``; null keys are
    a group of their own, and without keys the whole table is one."""
    key = F.to_json(F.struct(*[F.col(f"`{k}`").alias(f"k{i}") for i, k in enumerate(keys)])) if keys else F.lit("{}")
    rows = df.select(key.alias("_k"), F.spark_partition_id().alias("_s"),
                     *[F.col(f"`{c}`").cast("double").alias(f"_c{i}") for i, c in enumerate(cols)])

    def fold(batches):
        held: dict = {}
        size = 0
        for pdf in batches:
            codes, names = pd.factorize(pdf["_k"])
            task = int(pdf["_s"].iloc[0]) if len(pdf) else 0
            x = pdf.iloc[:, 2:].to_numpy(dtype=float)[np.argsort(codes, kind="stable")]
            ends = np.cumsum(np.bincount(codes, minlength=len(names)))
            for name, part in zip(names, np.split(x, ends[:-1])):
                one = of_rows(part)
                at = (name, task)
                size += 0 if at in held else one.nbytes
                held[at] = merge(held[at], one) if at in held else one
                if size > TASK_BYTES:
                    yield _frame(list(held), list(held.values()))
                    held, size = {}, 0
        if held:
            yield _frame(list(held), list(held.values()))

    shape = of_rows(np.zeros((0, len(cols)))).shape

    def total(batches):
        names, totals = [], []
        for pdf in batches:
            for name, sub, raw in zip(pdf["_k"], pdf["_s"], pdf["m"]):
                one = np.frombuffer(raw).reshape(shape)
                if names and names[-1] == (name, sub):
                    totals[-1] = merge(totals[-1], one)
                    continue
                if len(totals) * one.nbytes > BATCH_BYTES:
                    yield _frame(names, totals)
                    names, totals = [], []
                names.append((name, sub))
                totals.append(one)
        if names:
            yield _frame(names, totals)

    made = "_k string, _s int, m binary"
    parts = rows.mapInPandas(fold, made).select("_k", F.pmod("_s", F.lit(SUBKEYS)).alias("_s"), F.col("_s").alias("_p"), "m")
    parts = (parts.repartition("_k", "_s").sortWithinPartitions("_k", "_s", "_p").drop("_p").mapInPandas(total, made)
             .repartition("_k").sortWithinPartitions("_k", "_s").withColumn("_s", F.lit(0)).mapInPandas(total, made))
    if not keys:
        return parts.select("m")
    fields = StructType()
    for i, k in enumerate(keys):
        fields.add(f"k{i}", df.schema[k].dataType)
    return parts.select(F.from_json("_k", fields).alias("_k"), "m").select(
        *[F.col(f"_k.k{i}").alias(k) for i, k in enumerate(keys)], "m")
