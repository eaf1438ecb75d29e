"""Quality classifier by co-training of two views.

The text view sees the content: shares of byte values, repeats and word sizes.
The page view sees only metadata: source, language, length, and the layout of
lines. Both start from labelled rows. In each round either view labels the
unlabelled rows it is surest about for the other, which is fitted again with
them. In the end the views' log odds are calibrated together on labelled rows
that neither was fitted to, and all documents are scored.

Fitting uses at most ``PER_CLASS`` labelled rows of a class, the first by a
hash of the key, and every unlabelled row: the rows' features are written once,
each round finds the cut points of the surest over all of them, and tasks add
up their parts of the gradient and curvature of each Newton step. The driver
holds the labelled sample and such sums. Scoring covers every row.

Null or empty text has zero content and is scored by what is left; a null
source, language or length counts as a value of its own. Repeated rows and
null keys are scored like others. Without labels every score is 1/2.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import logistic, words
from .common import extended, non_null_text, stage, text_slices, with_columns
from .pretokens import buffers
from .sampling import in_fold, labelled_sample

PER_CLASS = 8_000
ROUNDS = 3
STEPS, CLOSE = 25, 1e-4  # most Newton steps of a fit, and the last step's size
BINS = 4096             # of log odds, for the cut points
MOST_SUMS = 256         # tasks' sums that the driver adds up itself
SURE = 0.95             # probability that makes a pseudo-label
PSEUDO_SHARE = 0.3      # of the rows that each class should have, taken in a round
PSEUDO_WEIGHT = 0.3
MOST_ODDS = 8.0         # log odds of a view are cut off here before they are combined
THRESHOLD = 0.5         # of the probability of good quality
SOURCES, LANGS, SIZES = 32, 16, 20
INPUT = ["text", "lang", "source", "n_chars"]


def text_view(col: pa.Array) -> np.ndarray:
    """Content features of a column without nulls."""
    data, offsets = buffers(col)
    n, size = len(col), np.maximum(np.diff(offsets), 1)[:, None]
    place = np.repeat(np.arange(0, n * 256, 256), np.diff(offsets))
    place += data
    shares = np.bincount(place, minlength=n * 256).reshape(n, 256) / size
    del place
    found, first = words.split(col)
    h = words.hashes(found)
    count = np.maximum(np.diff(first), 1)
    same = np.zeros(len(h) + 1)
    if len(h):
        inside = np.ones(len(h), bool)
        inside[first[:-1][first[:-1] < len(h)]] = False
        repeat = np.zeros(len(h))
        repeat[1:] = h[1:] == h[:-1]
        same = np.concatenate([[0], np.cumsum(repeat * inside)])
    upper = shares[:, 65:91].sum(1)
    letters = upper + shares[:, 97:123].sum(1) + shares[:, 128:].sum(1)
    extra = np.stack([np.diff(same[first]) / count, np.log1p(size[:, 0] / count), upper, letters,
                      shares[:, 48:58].sum(1), upper / np.maximum(letters, 1e-6)], 1)
    return np.hstack([np.sqrt(shares[:, :128]), extra, np.sqrt(np.maximum(extra, 0))])


def _hashed(values: list, size: int) -> np.ndarray:
    out = np.zeros((len(values), size))
    where = [xxhash.xxh3_64_intdigest(repr(v)) % size for v in values]
    out[np.arange(len(values)), where] = 1
    return out


def page_view(col: pa.Array, lang: list, source: list, n_chars: list) -> np.ndarray:
    """Metadata features."""
    data, offsets = buffers(col)
    lines = np.diff(np.concatenate([[0], np.cumsum(data == 10)])[offsets]) + 1
    length = np.array([-1 if c is None else max(c, 0) for c in n_chars], float)
    known = np.log1p(np.maximum(length, 0))
    bucket = np.zeros((len(lang), SIZES))
    bucket[np.arange(len(lang)), np.clip(known / 0.6, 0, SIZES - 1).astype(int)] = length >= 0
    per_line = np.log1p(np.diff(offsets) / lines)
    shape = np.stack([known, np.log1p(lines), per_line, per_line ** 2, known * per_line, length < 0], 1)
    return np.hstack([_hashed(lang, LANGS), _hashed(source, SOURCES), bucket, shape])


def views(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    get = lambda c: batch.column(batch.schema.get_field_index(c))
    col = non_null_text(get("text"))
    return text_view(col), page_view(col, get("lang").to_pylist(), get("source").to_pylist(),
                                     pc.cast(get("n_chars"), pa.int64()).to_pylist())


@dataclass
class View:
    mean: np.ndarray
    scale: np.ndarray
    beta: np.ndarray

    def odds(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale @ self.beta[:-1] + self.beta[-1], -MOST_ODDS, MOST_ODDS)


@dataclass
class Model:
    text: View
    page: View
    combine: np.ndarray
    rounds: list = field(default_factory=list)

    def score(self, text: np.ndarray, page: np.ndarray) -> np.ndarray:
        """(probability by text, by page, by both) of each row."""
        a, b = self.text.odds(text), self.page.odds(page)
        both = logistic.predict(self.combine, np.stack([a, b], 1))
        return np.stack([logistic.sigmoid(a), logistic.sigmoid(b), both], 1)


def _bins(odds: np.ndarray) -> np.ndarray:
    return np.minimum((odds + MOST_ODDS) * (BINS / (2 * MOST_ODDS)), BINS - 1).astype(np.int64)


def surest(counts: np.ndarray, base: float) -> tuple[np.ndarray, np.ndarray]:
    """Share of each bin's rows to take as poor and as good: the surest
    ``PSEUDO_SHARE`` of the rows that each class should have."""
    def taken(n, most):
        return np.clip((most - np.cumsum(n) + n) / np.maximum(n, 1), 0, 1)

    most = PSEUDO_SHARE * counts.sum()
    return taken(counts, most * (1 - base)), taken(counts[::-1], most * base)[::-1]


def pseudo(odds: np.ndarray, taken: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Label and share (0: no label) of rows by their log odds. All rows of the
    last bin that is taken in part count alike, by that part."""
    limit, at = math.log(SURE / (1 - SURE)), _bins(odds)
    good = odds > 0
    return good.astype(float), np.where(good, taken[1][at], taken[0][at]) * (np.abs(odds) >= limit)


def _terms(view: View, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Loss, gradient and curvature of the weighted log likelihood, in a row."""
    z = np.hstack([(x - view.mean) / view.scale, np.ones((len(x), 1))])
    odds = z @ view.beta
    p = logistic.sigmoid(odds)
    curve = (z * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ z
    return np.concatenate([[(weight * (np.logaddexp(0, odds) - y * odds)).sum()], z.T @ (weight * (y - p)), curve.ravel()])


def _matrix(col: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(col.to_pylist()), "<f4").reshape(len(col), -1).astype(float)


def added(pool: DataFrame, values: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray | None:
    """The sum of ``values`` (text features, page features: numbers of a fixed
    length) over the batches of all rows; None without rows."""
    def sums(batches):
        total = None
        for batch in batches:
            if batch.num_rows:
                own = values(_matrix(batch.column(0)), _matrix(batch.column(1)))
                total = own if total is None else total + own
        if total is not None:
            yield pa.RecordBatch.from_pydict({"part": pa.array([TaskContext.get().partitionId()], pa.int32()), "sums": [total.tobytes()]})

    def again(batches):
        part, total = 0, None
        for batch in batches:
            for part, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                total = np.frombuffer(x) if total is None else total + np.frombuffer(x)
        if total is not None:
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "sums": [total.tobytes()]})

    tasks = pool.rdd.getNumPartitions()
    rows = pool.select("text_x", "page_x").mapInArrow(sums, "part int, sums binary")
    if tasks > MOST_SUMS:
        rows = rows.repartition(math.isqrt(tasks), "part").sortWithinPartitions("part").mapInArrow(again, rows.schema)
    total = None
    for r in sorted(rows.collect(), key=lambda r: r["part"]):
        total = np.frombuffer(r["sums"]) if total is None else total + np.frombuffer(r["sums"])
    return total


def _scales(known: list[np.ndarray], pool: DataFrame) -> tuple[int, list[tuple[np.ndarray, np.ndarray]]]:
    """Rows of the pool; mean and deviation of each view over it and the labelled rows."""
    sums = added(pool, lambda a, b: np.concatenate([[len(a)], *(v for x in (a, b) for v in (x.sum(0), (x * x).sum(0)))]))
    wide = [x.shape[1] for x in known]
    n, at, out = 0 if sums is None else int(sums[0]), 1, []
    for x, w in zip(known, wide, strict=True):
        one, two = (np.zeros(w), np.zeros(w)) if sums is None else (sums[at: at + w], sums[at + w: at + 2 * w])
        at += 2 * w
        count = max(n + len(x), 1)
        mean = (one + x.sum(0)) / count
        scale = np.sqrt(np.maximum((two + (x * x).sum(0)) / count - mean ** 2, 0))
        out.append((mean, np.where(scale > 1e-6, scale, 1.0)))
    return n, out


def _newton(scales: list, base: float, known: list[np.ndarray], y, weight, more: Callable, l2: float = 20.0) -> list[View]:
    """Newton steps with a ridge of both views at once, from the base rate;
    ``more`` gives the pool's terms at given coefficients. A step that doesn't
    lower the loss is halved."""
    wide = [x.shape[1] + 1 for x in known]
    now = [View(m, s, np.append(np.zeros(len(m)), math.log(base / (1 - base)))) for m, s in scales]
    best: list = [None] * len(now)  # least loss so far, its view, the step from there
    for _ in range(STEPS):
        extra, at = more(now), 0
        for k, (v, x, w) in enumerate(zip(now, known, wide, strict=True)):
            size = 1 + w + w * w
            t = _terms(v, x, y, weight) + extra[at: at + size]
            at += size
            ridge = np.full(w, l2)
            ridge[-1] = 1e-6
            loss = t[0] + (ridge * v.beta ** 2).sum() / 2
            if best[k] is None or loss <= best[k][0] + 1e-9 * abs(best[k][0]):
                step = np.linalg.solve(t[1 + w:].reshape(w, w) + np.diag(ridge), t[1: 1 + w] - ridge * v.beta)
                best[k] = (loss, v, step)
            else:
                best[k] = (*best[k][:2], best[k][2] / 2)
        now = [View(v.mean, v.scale, v.beta + step) for _, v, step in best]
        if max(np.abs(step).max() for _, _, step in best) < CLOSE:
            break
    else:
        now = [v for _, v, _ in best]
    # sums of other partitions differ in their last digits
    return [View(v.mean, v.scale, np.round(v.beta, 9)) for v in now]


def co_train(text, page, y, weight, held, pool: DataFrame, rounds: int = ROUNDS) -> Model:
    """Fit both views on rows not ``held``, exchange labels of the rows of
    ``pool`` (text_x, page_x), combine on ``held``."""
    use = ~held
    known, y_use, w_use = [text[use], page[use]], y[use], weight[use]
    mixed = len(set(y_use)) == 2
    n, scales = _scales(known, pool) if mixed else (0, [(np.zeros(x.shape[1]), np.ones(x.shape[1])) for x in known])
    a, b = (View(m, s, logistic.fit((x - m) / s, y_use, w_use, l2=20.0)) for (m, s), x in zip(scales, known, strict=True))
    history = []
    for _ in range(rounds if n else 0):  # labels of one class, or none, have nothing to tell
        old = (a, b)

        def counted(x, z, old=old):
            return np.concatenate([np.bincount(_bins(v.odds(f)), minlength=BINS) for v, f in zip(old, (x, z), strict=True)]).astype(float)

        counts = added(pool, counted).reshape(2, BINS)
        base = float(np.average(y_use, weights=w_use))
        taken = [surest(c, base) for c in counts]
        middle = (np.arange(BINS) + 0.5) * (2 * MOST_ODDS / BINS) - MOST_ODDS
        of_text, of_page = (float((pseudo(middle, t)[1] * c).sum()) for t, c in zip(taken, counts, strict=True))
        history.append((round(of_page), round(of_text)))  # labels given to the text view, to the page view

        def more(fitted, old=old, taken=taken):
            def terms(x, z):
                out = []
                for k, own in ((0, x), (1, z)):  # each view learns from the other
                    label, share = pseudo(old[1 - k].odds((z, x)[k]), taken[1 - k])
                    at = share > 0
                    out.append(_terms(fitted[k], own[at], label[at], PSEUDO_WEIGHT * share[at]))
                return np.concatenate(out)

            return added(pool, terms)

        a, b = _newton(scales, base, known, y_use, w_use, more)
    odds = np.stack([a.odds(text[held]), b.odds(page[held])], 1)
    return Model(a, b, logistic.fit(odds, y[held], weight[held]), history)


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Model:
    """Fit on a bounded sample of labelled rows outside fold 2 and on all other rows."""
    spark = docs.sparkSession
    sample = labelled_sample(labels.where(~in_fold()), "quality", per_class)
    chosen = spark.createDataFrame(sample, "doc_id long, label int, weight double")
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang", "source",
                       F.col("n_chars").cast("long").alias("n_chars"))

    def run(batches):
        for batch in text_slices(batches, "text"):
            a, b = views(batch)
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column(0), "label": batch.column(batch.schema.get_field_index("label")),
                "weight": batch.column(batch.schema.get_field_index("weight")),
                "text_x": pa.array([r.astype("<f4").tobytes() for r in a], pa.binary()),
                "page_x": pa.array([r.astype("<f4").tobytes() for r in b], pa.binary())})

    # a few hundred numbers of every row, written once and read in every pass
    every = stage(base.join(F.broadcast(chosen), "doc_id", "left")
                  .mapInArrow(run, "doc_id long, label int, weight double, text_x binary, page_x binary"), "quality")
    rows = (every.where("label is not null")
            .withColumn("held", F.crc32(F.concat(F.lit("q"), F.col("doc_id").cast("string")).cast("binary")) % 4 == 0)
            .orderBy("doc_id", "text_x", "page_x").collect())  # at most 2 * per_class keys
    empty = pa.RecordBatch.from_arrays([pa.array([""]), pa.array([None], pa.string()), pa.array([None], pa.string()),
                                        pa.array([None], pa.int64())], names=INPUT)
    widths = [v.shape[1] for v in views(empty)]
    text, page = (np.frombuffer(b"".join(bytes(r[c]) for r in rows), "<f4").reshape(-1, w).astype(float)
                  for c, w in zip(("text_x", "page_x"), widths, strict=True))
    y, weight, held = (np.array([r[c] for r in rows], t) for c, t in (("label", float), ("weight", float), ("held", bool)))
    del rows
    return co_train(text, page, y, weight, held, every.where("label is null").select("text_x", "page_x"))


def score(docs: DataFrame, model: Model, prefix: str = "") -> DataFrame:
    """Add text_score, page_score and score, probabilities of good quality."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = [prefix + n for n in ("text_score", "page_score", "score")]

    def run(batches):
        for batch in text_slices(batches, "text"):
            p = shared.value.score(*views(batch))
            yield with_columns(batch, {n: pa.array(p[:, k]) for k, n in enumerate(names)})

    return docs.mapInArrow(run, extended(docs, [T.StructField(n, T.DoubleType()) for n in names]))


def report(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, the three scores and predicted (1: good) of every document."""
    scored = score(docs.select("doc_id", *INPUT), train(docs, labels)).drop(*INPUT)
    return scored.select("doc_id", in_fold().alias("held_out"), "text_score", "page_score", "score",
                         (F.col("score") >= threshold).cast("int").alias("predicted"))


def drop_poor(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without those that score below ``threshold``."""
    own = f"quality_{uuid.uuid4().hex}_"
    return score(docs, train(docs, labels), own).where(F.col(f"{own}score") >= threshold).select(*docs.columns)
