"""Toxicity scores from a weighted lexicon matched by Aho-Corasick.

Text is lower-cased and folded: letters of other scripts that look like Latin
ones, and digits and signs that stand for letters, become those letters.
A 1 is read as i and as l. Lexicon entries are beginnings of words, or whole
words of two or three letters; a match counts at a word's start, unless it lies
in an exception phrase that ends with a word. The weights of the matched words are
summed, also per length, and a logistic curve turns both into a probability.

The lexicon is learned from labelled rows, at most ``PER_CLASS`` of a class
(the bound of what the driver handles; more rows only sharpen the weights).
An entry needs a share of the toxic rows, which bounds the candidates by the
mean number of word beginnings in a text over that share.

Null or empty text has no match and scores the base rate of such rows. Rows
that are repeated, or have a null key, are scored like others; labels without
a document are not used; without labels every score is 1/2 or less. Only
doc_id (for the fold) and text are read. An empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
import uuid
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import logistic
from .common import extended, non_null_text, stage, text_slices, with_columns
from .sampling import in_fold, labelled_sample

PER_CLASS = 20_000
SHORTEST, LONGEST = 4, 12       # characters of a lexicon entry
WHOLE = "|"                     # ends an entry that is a whole short word; no letter
LEAST_ROWS, LEAST_SHARE = 3, 0.005  # of the toxic rows, to hold an entry
LEAST_WEIGHT = 2.0              # log odds of an entry
EXPLAINED = 2                   # matched words that explain a toxic row
CLOSED = 0.9                    # an entry gives way to a longer one in so much of its rows
THRESHOLD = 0.3
EXCEPTIONS = ("trash can", "trash bin", "trash bag", "clown fish", "stupid question", "class clown")

#: Characters that look like Latin letters, then digits and signs used as letters.
LOOKALIKES = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "ӏ": "l", "м": "m",
    "н": "h", "о": "o", "р": "p", "ѕ": "s", "т": "t", "у": "y", "х": "x", "α": "a", "β": "b", "ε": "e", "ι": "i",
    "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i",
    "0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s",
}
_FOLD = str.maketrans(LOOKALIKES | {chr(0xFF41 + k): chr(97 + k) for k in range(26)}
                      | dict.fromkeys("​‌‍­⁠", ""))
_WORD = re.compile(r"[^\W\d_]+")


def fold(text: str) -> str:
    return text.lower().translate(_FOLD)


def readings(text: str) -> list[str]:
    """The folded text, and with every 1 as l where it has one; places agree."""
    return [fold(text)] + ([fold(text.replace("1", "l"))] if "1" in text else [])


@dataclass
class Model:
    lexicon: dict[str, float]
    curve: np.ndarray
    exceptions: tuple[str, ...] = EXCEPTIONS

    def automaton(self):
        import ahocorasick

        found = ahocorasick.Automaton()
        # (entry, characters, weight, whether it must end with its word)
        for entry, weight in self.lexicon.items():
            word = entry.removesuffix(WHOLE)
            found.add_word(word, (entry, len(word), weight, word != entry))
        for phrase in map(fold, self.exceptions):
            found.add_word(phrase, (phrase, len(phrase), None, True))
        if len(found):
            found.make_automaton()
        return found


def starts(automaton, text: str) -> dict[int, tuple[str, float]]:
    """The heaviest entry (and its weight) at each matched word of a text."""
    at: dict[int, tuple[str, float]] = {}
    spared = []
    for own in readings(text) if len(automaton) else ():
        for end, (entry, size, weight, whole) in automaton.iter(own):
            begin = end + 1 - size
            if begin and own[begin - 1].isalnum() or whole and end + 1 < len(own) and own[end + 1].isalnum():
                continue
            if weight is None:
                spared.append((begin, end))
            elif begin not in at or weight > at[begin][1]:
                at[begin] = (entry, weight)
    if not spared:
        return at
    inside = lambda b, e: any(p <= b and b + len(e.removesuffix(WHOLE)) - 1 <= q for p, q in spared)
    return {b: x for b, x in at.items() if not inside(b, x[0])}


def evidence(automaton, text: str) -> tuple[float, float]:
    """Log of the summed weights of matched words, and of that per 100 words."""
    total = sum(w for _, w in starts(automaton, text).values())
    return (math.log1p(total), math.log1p(100 * total / (20 + len(text.split())))) if total else (0.0, 0.0)


def beginnings(text: str) -> set[str]:
    """Beginnings of the words of a text, and its short whole words."""
    words = {w for own in readings(text) for w in _WORD.findall(own)}
    return ({w[:k] for w in words for k in range(SHORTEST, min(len(w), LONGEST) + 1)}
            | {w + WHOLE for w in words if 2 <= len(w) < SHORTEST})


def _counted(rows: DataFrame, entries=None) -> DataFrame:
    """(entry, n): in how many rows an entry stands; only ``entries`` if given."""
    def run(batches):
        found: Counter = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                own = beginnings(text or "")
                found.update(own if entries is None else own & entries.value)
                if len(found) > 300_000:
                    yield pa.RecordBatch.from_pydict({"entry": list(found), "n": list(found.values())})
                    found.clear()
        if found:
            yield pa.RecordBatch.from_pydict({"entry": list(found), "n": list(found.values())})

    return rows.select("text").mapInArrow(run, "entry string, n long").groupBy("entry").agg(F.sum("n").alias("n"))


def choose(toxic: dict[str, int], clean: dict[str, int], n_toxic: int, n_clean: int) -> dict[str, float]:
    """The lexicon: entries by their log odds, without those that a longer entry
    of about as many rows, or a shorter one of about the weight, makes needless."""
    def weight(e):
        return (math.log((toxic[e] + 0.5) / (n_toxic + 1)) - math.log((clean.get(e, 0) + 0.5) / (n_clean + 1)))

    longer: Counter = Counter()
    for e, n in toxic.items():
        if len(e) > SHORTEST:
            longer[e[:-1]] = max(longer[e[:-1]], n)
    out: dict[str, float] = {}
    for e in sorted(toxic, key=lambda e: (len(e), e)):
        w = weight(e)
        if w < LEAST_WEIGHT or longer[e] >= CLOSED * toxic[e]:
            continue
        if any(out.get(e[:k], -9) >= w - 0.7 for k in range(SHORTEST, len(e))):
            continue
        out[e] = w
    return out


def needed(lexicon: dict[str, float], support: dict[str, int], rows: list[dict[str, int]], least: int) -> dict[str, float]:
    """The entries that explain toxic rows which others leave unexplained.

    A row is explained by ``EXPLAINED`` matched words. Entries are gone through
    by falling support, and one stays if enough rows that hold it are still
    open. Words that merely stand in a group of copies of toxic texts come
    late, when their rows are explained, and go.
    """
    holders: dict[str, list[int]] = {}
    for k, found in enumerate(rows):
        for entry in found:
            holders.setdefault(entry, []).append(k)
    seen, out = [0] * len(rows), {}
    for entry in sorted(lexicon, key=lambda e: (-support[e], e)):
        own = holders.get(entry, [])
        if sum(seen[k] < EXPLAINED for k in own) >= least:
            out[entry] = lexicon[entry]
            for k in own:
                seen[k] += rows[k][entry]
    return out


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Model:
    """Learn the lexicon and the curve from labelled rows outside the held-out fold."""
    spark = docs.sparkSession
    sample = labelled_sample(labels.where(~in_fold()), "toxic", per_class)
    chosen = spark.createDataFrame(sample, "doc_id long, label int, weight double")
    # at most 2 * per_class rows of three numbers
    rows = stage(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
                 .join(F.broadcast(chosen), "doc_id"), "toxic-sample")
    sizes = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    n_toxic, n_clean = sizes.get(1, 0), sizes.get(0, 0)
    least = max(LEAST_ROWS, math.ceil(LEAST_SHARE * n_toxic))
    toxic = {r["entry"]: r["n"] for r in _counted(rows.where("label = 1")).where(F.col("n") >= least).collect()}
    entries = spark.sparkContext.broadcast(frozenset(toxic))
    clean = {r["entry"]: r["n"] for r in _counted(rows.where("label = 0"), entries).collect()}
    model = Model(choose(toxic, clean, n_toxic, n_clean), np.zeros(3))
    shared = spark.sparkContext.broadcast(model)

    def matched(batches):
        automaton = shared.value.automaton()
        for batch in batches:
            found = [Counter(e for e, _ in starts(automaton, t or "").values()) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_pydict({"entries": pa.array([list(f) for f in found], pa.list_(pa.string())),
                                              "counts": pa.array([list(f.values()) for f in found], pa.list_(pa.int64()))})

    # at most per_class rows of entries
    held = rows.where("label = 1").select("text").mapInArrow(matched, "entries array<string>, counts array<long>").collect()
    model.lexicon = needed(model.lexicon, toxic, [dict(zip(r["entries"], r["counts"], strict=True)) for r in held], least)
    shared = spark.sparkContext.broadcast(model)

    def seen(batches):
        automaton = shared.value.automaton()
        for batch in batches:
            found = [evidence(automaton, t or "") for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_pydict({
                "total": pa.array([round(a, 1) for a, _ in found], pa.float64()),
                "dense": pa.array([round(b, 1) for _, b in found], pa.float64()),
                "label": batch.column(1), "weight": batch.column(2)})

    # a bounded grid of evidence, whatever the sample
    grid = (rows.select("text", "label", "weight").mapInArrow(seen, "total double, dense double, label int, weight double")
            .groupBy("total", "dense", "label").agg(F.sum("weight").alias("weight")).orderBy("total", "dense", "label").collect())
    x = np.array([[r["total"], r["dense"]] for r in grid]).reshape(-1, 2)
    model.curve = logistic.fit(x, np.array([r["label"] for r in grid], float), np.array([r["weight"] for r in grid], float))
    return model


def score(df: DataFrame, model: Model, text: str = "text", to: str = "score") -> DataFrame:
    """Add the probability that a whole text is toxic."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        automaton = shared.value.automaton()
        for batch in text_slices(batches, text):
            col = non_null_text(batch.column(batch.schema.get_field_index(text)))
            x = np.array([evidence(automaton, t) for t in col.to_pylist()]).reshape(-1, 2)
            yield with_columns(batch, {to: pa.array(logistic.predict(shared.value.curve, x))})

    return df.mapInArrow(run, extended(df, [T.StructField(to, T.DoubleType())]))


def report(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    scored = score(docs.select("doc_id", "text"), train(docs, labels)).drop("text")
    return scored.select("doc_id", in_fold().alias("held_out"), "score",
                         (F.col("score") >= threshold).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without those that score at least ``threshold``."""
    own = f"score_{uuid.uuid4().hex}"
    return score(docs, train(docs, labels), to=own).where(F.col(own) < threshold).drop(own)
