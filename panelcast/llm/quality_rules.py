"""Quality rules: plain counts of a text, and a log-likelihood ratio of its n-grams.

Two multinomials over hashed byte 4-grams are counted: the raw corpus over all
documents, the trusted target over all documents with a good quality label (of
folds 0 and 1). A text's score is the mean over its n-grams of
log p(target) - log p(raw); every document at or above one threshold passes.
The threshold is the cut between score bins that best parts good from bad
labels of fold 3 that pass the plain rules (middle of the best run of cuts).
Fold 2 takes no part, so it can be used to measure.

Log ratios are held as whole multiples of 2**-20, so a text's score is the same
on any partitioning. Every count covers all documents; the driver holds two
tables of ``BUCKETS`` counts and one of score bins, whatever the input.

Null or empty text has no words and fails the plain rules. Texts under four
bytes have score 0. Rows are kept as they come: repeated rows and null keys give
one result each; a null key has no label. Of several labels of a key the largest
counts. Without good or without bad labels only the plain rules reject. Columns
other than the key and the text are ignored by ``report`` and kept by ``keep``.
Windows are compared by 64-bit hashes.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import words
from .common import extended, non_null_text, stage, text_slices, with_columns
from .pretokens import buffers

GRAM, BITS = 4, 16
BUCKETS = 1 << BITS
ONE = 1 << 20            # fixed-point unit of the log ratios
SMOOTH = 1.0             # added to every bucket of both multinomials
BINS = 256               # score bins in a unit, for the threshold
MOST = 16                # scores lie within -MOST and MOST
WINDOW = 8               # words of a repeated window
FEWEST_WORDS, MOST_REPEATED = 20, 30  # words, per cent of words
FOLDS, TARGET_FOLDS, CUT_FOLD = 4, (0, 1), 3
_MIX = np.uint32(0x9E3779B1)  # odd multiplier of the bucket hash

_WORD = np.ones(256, bool)
_WORD[[9, 10, 11, 12, 13, 32]] = False
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _cut(data: np.ndarray, keep: np.ndarray, start: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The kept bytes as strings that begin at ``start``, and where each begins."""
    first = np.flatnonzero(start)
    places = np.append(np.cumsum(keep)[first] - keep[first], keep.sum()).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(places), pa.py_buffer(data[keep])]), first


def _per_row(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate([[0], np.cumsum(flags)])[offsets])


def _repeated(h: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Which hashes occur twice or more in their row; rows ascend."""
    again = np.zeros(len(h), bool)
    if len(h) < 2:
        return again
    order = np.argsort(h, kind="stable")
    same = (h[order[1:]] == h[order[:-1]]) & (row[order[1:]] == row[order[:-1]])
    again[order[1:]] = same
    again[order[:-1]] |= same
    return again


def plain_counts(col: pa.Array) -> dict[str, np.ndarray]:
    """The five counts of every text of a column without nulls."""
    data, offsets = buffers(col)
    if not len(data):
        return {c: np.zeros(len(col), np.int64) for c in COUNTS}
    in_word = _WORD[data]
    edges = offsets[:-1][offsets[:-1] < len(data)]
    start = in_word.copy()
    start[1:] &= ~in_word[:-1]
    start[edges] = in_word[edges]
    found, first = _cut(data, in_word, start)
    word_at = np.searchsorted(first, offsets)
    n_words = np.diff(word_at)

    window, place = words.row_windows(words.hashes(found), word_at, WINDOW)
    again = place[_repeated(window, np.searchsorted(word_at, place, "right") - 1)]
    cover = np.zeros(len(found) + 1, np.int64)
    np.add.at(cover, again, 1)
    np.add.at(cover, again + WINDOW, -1)
    covered = np.cumsum(cover)[:-1] > 0

    newline = data == 10
    line_start = np.zeros(len(data), bool)
    line_start[1:] = newline[:-1]
    line_start[edges] = True
    lines, begins = _cut(data, ~newline, line_start)
    has_word = np.diff(np.searchsorted(first, np.append(begins, len(data)))) > 0
    line_row = np.searchsorted(offsets, begins, "right") - 1
    coded = lines.dictionary_encode()
    size = max(len(coded.dictionary), 1)
    key = (line_row * size + coded.indices.to_numpy())[has_word]
    own = np.bincount(line_row[has_word], minlength=len(col))
    distinct = np.bincount(np.unique(key) // size, minlength=len(col))
    return {"n_words": n_words,
            "word_chars": _per_row(in_word & ((data & 0xC0) != 0x80), offsets),
            "n_symbols": _per_row(_SYMBOL[data], offsets),
            "n_dup_lines": own - distinct,
            "n_repeat_words": _per_row(covered, word_at)}


def grams(col: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket of the n-gram at each byte of a column without nulls (those over
    the end of a row too), and each row's first and end of whole n-grams."""
    data, offsets = buffers(col)
    n = max(len(data) - GRAM + 1, 0)
    value = np.zeros(n, np.uint32)
    for k in range(GRAM):
        value |= data[k: n + k].astype(np.uint32) << np.uint32(8 * k)
    value *= _MIX
    first = np.minimum(offsets[:-1], n)
    return value >> np.uint32(32 - BITS), first, np.maximum(offsets[1:] - GRAM + 1, first)


def count_grams(docs: DataFrame, text: str = "text") -> np.ndarray:
    """n-grams of all texts by bucket; each task adds up its own first."""
    def run(batches):
        total = np.zeros(BUCKETS, np.int64)
        for batch in text_slices(batches, text):
            bucket, first, end = grams(non_null_text(batch.column(0)))
            inside = np.zeros(len(bucket) + 1, np.int32)
            np.add.at(inside, first, 1)
            np.add.at(inside, end, -1)
            total += np.bincount(bucket[np.cumsum(inside)[:-1] > 0], minlength=BUCKETS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at])], names=["bucket", "n"])

    parts = docs.select(F.col(f"`{text}`")).mapInArrow(run, "bucket int, n long")
    out = np.zeros(BUCKETS)
    for r in parts.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def log_ratios(target: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """log p(target) - log p(raw) of every bucket, in units of 1/ONE."""
    p = (target + SMOOTH) / (target.sum() + SMOOTH * BUCKETS)
    q = (raw + SMOOTH) / (raw.sum() + SMOOTH * BUCKETS)
    return np.clip(np.rint(np.log(p / q) * ONE), -MOST * ONE, MOST * ONE).astype(np.int64)


def best_cut(bins: dict[int, tuple[int, int]]) -> float | None:
    """Threshold from (bad, good) labels in each score bin; None if a kind lacks."""
    bad, good = sum(b for b, _ in bins.values()), sum(g for _, g in bins.values())
    if not bad or not good:
        return None
    order = sorted(bins)
    below_bad = below_good = 0
    gains = [(0, order[0])]
    for k in order:
        below_bad, below_good = below_bad + bins[k][0], below_good + bins[k][1]
        gains.append((below_bad * good - below_good * bad, k + 1))
    best = max(gain for gain, _ in gains)
    at = next(i for i, (gain, _) in enumerate(gains) if gain == best)
    upto = order[at] if at < len(order) else gains[at][1]
    return (gains[at][1] + upto) / 2 / BINS


@dataclass
class Verdict:
    """Log ratios by bucket, and the threshold of the mean (None: no verdict)."""

    ratios: np.ndarray
    threshold: float | None


def _fold(key: str) -> Column:
    return F.crc32(F.col(key).cast("string").cast("binary")) % FOLDS


def _labels(labels: DataFrame) -> DataFrame:
    return (labels.select(F.col("doc_id").alias("_key"), F.col("quality").cast("int").alias("_quality"))
            .where("_key is not null and _quality in (0, 1)").groupBy("_key").agg(F.max("_quality").alias("_quality")))


def base_failed() -> Column:
    return (F.col("n_words") < FEWEST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))


def measure(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id") -> tuple[DataFrame, Verdict]:
    """(key, the five counts, base_failed, score) of every document, and the verdict."""
    own = docs.select(F.col(f"`{key}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    marks = _labels(labels)
    trusted = marks.where(_fold("_key").isin(*TARGET_FOLDS) & (F.col("_quality") == 1))
    raw = count_grams(own)
    # labels grow with the documents, so they are never broadcast; only the folds of the target are moved
    target = count_grams(own.join(trusted.hint("merge"), F.col("doc_id") == F.col("_key"), "left_semi"))
    ratios = log_ratios(target, raw)
    table = docs.sparkSession.sparkContext.broadcast(ratios)
    fields = [T.StructField(c, T.LongType()) for c in (*COUNTS, "ratio_sum", "n_grams")]

    def run(batches):
        for batch in text_slices(batches, "text"):
            col = non_null_text(batch.column(1))
            counts = plain_counts(col)
            bucket, first, end = grams(col)
            sums = np.concatenate([[0], np.cumsum(table.value[bucket])])
            counts |= {"ratio_sum": sums[end] - sums[first], "n_grams": end - first}
            yield with_columns(batch.select(["doc_id"]), {c: pa.array(v, pa.int64()) for c, v in counts.items()})

    out = stage(own.mapInArrow(run, extended(own.select("doc_id"), fields)), "quality-rules")
    score = F.coalesce(F.try_divide(F.col("ratio_sum") / ONE, F.col("n_grams")), F.lit(0.0))
    out = out.select("doc_id", *COUNTS, base_failed().alias("base_failed"), score.alias("score"))
    judged = (out.where(~F.col("base_failed") & (_fold("doc_id") == CUT_FOLD)).select("doc_id", "score")
              .join(marks, F.col("doc_id") == F.col("_key")))
    bins = judged.groupBy(F.floor(F.col("score") * BINS).cast("int").alias("bin")).agg(
        F.count_if(F.col("_quality") == 0).alias("bad"), F.count_if(F.col("_quality") == 1).alias("good"))
    return out, Verdict(ratios, best_cut({r["bin"]: (r["bad"], r["good"]) for r in bins.collect()}))


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Counts, score and verdict of every document."""
    out, verdict = measure(docs, labels)
    least = -math.inf if verdict.threshold is None else verdict.threshold
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("score") >= F.lit(least)))


def keep(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that pass, with all their columns. Documents are read by
    their text once more, so rows need no key of their own."""
    _, verdict = measure(docs, labels)
    table = docs.sparkSession.sparkContext.broadcast(verdict)

    def run(batches):
        for batch in text_slices(batches, "text"):
            col = non_null_text(batch.column(batch.schema.get_field_index("text")))
            c = plain_counts(col)
            bucket, first, end = grams(col)
            sums = np.concatenate([[0], np.cumsum(table.value.ratios[bucket])])
            score = (sums[end] - sums[first]) / ONE / np.maximum(end - first, 1)
            ok = (c["n_words"] >= FEWEST_WORDS) & (100 * c["n_repeat_words"] <= MOST_REPEATED * c["n_words"])
            if table.value.threshold is not None:
                ok &= score >= table.value.threshold
            yield batch.filter(pa.array(ok))

    return docs.mapInArrow(run, docs.schema)
