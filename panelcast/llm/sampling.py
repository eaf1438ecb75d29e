"""Bounded samples of labelled rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def in_fold(key: str = "doc_id", fold: int = 2, folds: int = 4) -> Column:
    """Whether crc32 of the key as text falls in ``fold``; a null key doesn't."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % folds == fold, F.lit(False))


def labelled_sample(labels: DataFrame, label: str, per_class: int) -> list[tuple[int, int, float]]:
    """(doc_id, label, weight) of at most ``per_class`` rows of either class, the
    first by a hash of the key; the weight makes up for rows left out. A key
    with several labels takes the largest; null keys and labels are left out."""
    one = (labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label"))
           .where("doc_id is not null and label in (0, 1)").groupBy("doc_id").agg(F.max("label").alias("label")))
    sizes = {r["label"]: r["n"] for r in one.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    out = []
    for kind, size in sorted(sizes.items()):
        rows = one.where(F.col("label") == kind).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class).collect()
        out += [(r["doc_id"], kind, size / len(rows)) for r in rows]
    return out
