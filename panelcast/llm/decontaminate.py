"""Benchmark decontamination by a broadcast hash set of n-grams.

Words are lower-cased in A-Z and are runs of ASCII letters and digits and of
characters beyond ASCII. A window is ``size`` consecutive words of a benchmark
item; an item of fewer words, but not none, is one window of its own length.
Window hashes of the benchmark are broadcast; tasks hash the windows of whole
texts, look them up, and compare the words of every hit, so a chance equality
of hashes is no hit. Words inside any occurrence are hit.

At most ``block_windows`` windows are broadcast at once. A larger benchmark is
gone through in so many blocks, each a further pass over the texts that adds
to the hits found before.

Null or empty text has no words and no hits; a null or empty item has no
window. Items with the same id are one item, and an item with a null id can
hit words but isn't listed. Repeated rows and null keys are kept, each with its
own result. Same-named columns of the input are replaced.
"""

from __future__ import annotations

import re
import uuid

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import words
from .common import extended, non_null_text, stage, text_slices, with_columns

WINDOW = 13
BLOCK_WINDOWS = 200_000
PERCENT_HIT = 5  # of the words, at least, make a text contaminated
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

SCAN = [T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()),
        T.StructField("items", T.ArrayType(T.LongType())), T.StructField("spans", T.BinaryType())]


def windows(batches, size: int):
    """The distinct windows of benchmark rows: (n, hash, words, item)."""
    for batch in batches:
        col = non_null_text(batch.column(1))
        found, first = words.split(col)
        tokens = found.to_pylist()
        out = {"n": [], "hash": [], "gram": [], "item_id": []}
        for row, item in enumerate(batch.column(0).to_pylist()):
            own = tokens[first[row]: first[row + 1]]
            n = min(size, len(own))
            if not n:
                continue
            h = words.window_hashes(words.hashes(pa.array(own, pa.binary())), n).view(np.int64)
            for k in range(len(own) - n + 1):
                out["n"].append(n)
                out["hash"].append(int(h[k]))
                out["gram"].append(b" ".join(own[k: k + n]))
                out["item_id"].append(item)
        yield pa.RecordBatch.from_pydict(out, schema=pa.schema([
            ("n", pa.int32()), ("hash", pa.int64()), ("gram", pa.binary()), ("item_id", pa.int64())]))


class Block:
    """Windows of one pass, by length, then hash."""

    def __init__(self, rows: list):
        self.grams: dict[int, dict[int, dict[bytes, set]]] = {}
        for r in rows:
            (self.grams.setdefault(r["n"], {}).setdefault(r["hash"], {})
             .setdefault(bytes(r["gram"]), set()).add(r["item_id"]))
        self.sorted = {n: np.sort(np.fromiter(g, np.int64, len(g)).view(np.uint64)) for n, g in self.grams.items()}
        self.bits = {n: max(16, int(np.ceil(np.log2(32 * len(s))))) for n, s in self.sorted.items()}
        self.seen = {}
        for n, s in self.sorted.items():
            self.seen[n] = np.zeros(1 << self.bits[n], bool)
            self.seen[n][s >> np.uint64(64 - self.bits[n])] = True

    def hits(self, col: pa.Array) -> tuple[np.ndarray, dict[int, tuple[list, set]]]:
        """Words of each row; for rows with hits (first, last) places and items."""
        found, first = words.split(col)
        h = words.hashes(found)
        out: dict[int, tuple[list, set]] = {}
        for n, grams in self.grams.items():
            hashed, at = words.row_windows(h, first, n)
            maybe = np.flatnonzero(self.seen[n][hashed >> np.uint64(64 - self.bits[n])])
            s = self.sorted[n]
            place = np.minimum(np.searchsorted(s, hashed[maybe]), len(s) - 1)
            maybe = maybe[s[place] == hashed[maybe]]
            rows = np.searchsorted(first, at[maybe], "right") - 1
            for k, begin, row in zip(hashed[maybe].view(np.int64).tolist(), at[maybe].tolist(), rows.tolist(), strict=True):
                gram = b" ".join(found.slice(begin, n).to_pylist())
                items = grams[k].get(gram)
                if items:
                    spans, named = out.setdefault(row, ([], set()))
                    spans.append((begin - int(first[row]), begin - int(first[row]) + n))
                    named |= items
        return np.diff(first), out


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans of word places [first, end), joined where they touch or overlap."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def scan(docs: DataFrame, benchmark: DataFrame, text: str = "text", size: int = WINDOW,
         block_windows: int = BLOCK_WINDOWS, prefix: str = "") -> DataFrame:
    """Add n_words, n_hit, items (sorted distinct ids) and spans (pairs of
    little-endian 64-bit word places [first, end)) to every row, their names
    behind ``prefix``."""
    spark = docs.sparkSession
    grams = (benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text")
             .mapInArrow(lambda b: windows(b, size), "n int, hash long, gram binary, item_id long").distinct())
    parts = max(1, -(-grams.count() // block_windows))
    schema = extended(docs, [T.StructField(prefix + f.name, f.dataType) for f in SCAN])
    out = docs
    for part in range(parts):
        rows = grams.where(F.pmod("hash", F.lit(parts)) == part).collect() if parts > 1 else grams.collect()
        block = spark.sparkContext.broadcast(Block(rows))

        def run(batches, block=block, again=part > 0):
            for batch in text_slices(batches, text):
                n_words, hits = block.value.hits(non_null_text(batch.column(batch.schema.get_field_index(text))))
                spans, items = [[] for _ in n_words], [set() for _ in n_words]
                if again:
                    old_spans, old_items = batch.column(f"{prefix}spans").to_pylist(), batch.column(f"{prefix}items").to_pylist()
                    spans = [list(map(tuple, np.frombuffer(x, "<i8").reshape(-1, 2).tolist())) for x in old_spans]
                    items = [set(x) for x in old_items]
                for row, (found, named) in hits.items():
                    spans[row] = merged([*spans[row], *found])
                    items[row] |= named - {None}
                yield with_columns(batch, {
                    f"{prefix}n_words": pa.array(n_words), f"{prefix}n_hit": pa.array([sum(b - a for a, b in s) for s in spans], pa.int64()),
                    f"{prefix}items": pa.array([sorted(x) for x in items], pa.list_(pa.int64())),
                    f"{prefix}spans": pa.array([np.array(s, "<i8").tobytes() for s in spans], pa.binary())})

        out = out.mapInArrow(run, schema)
        if part + 1 < parts:
            out = stage(out, "benchmark-block")  # a task holds one block at a time
    return out


def contaminated(percent: int = PERCENT_HIT, prefix: str = ""):
    """Whether the hit words are some and at least ``percent`` of all."""
    hit = F.col(f"{prefix}n_hit")
    return (hit > 0) & (100 * hit >= percent * F.col(f"{prefix}n_words"))


def drop_documents(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """``docs`` without the contaminated ones."""
    own = f"found_{uuid.uuid4().hex}_"
    return scan(docs, benchmark, prefix=own, **options).where(~contaminated(prefix=own)).select(*docs.columns)


def cut_spans(docs: DataFrame, benchmark: DataFrame, text: str = "text", **options) -> DataFrame:
    """``docs`` with the hit words, and what stands between them, cut out."""
    own = f"found_{uuid.uuid4().hex}_"
    found = scan(docs, benchmark, text, prefix=own, **options)

    def run(batches):
        for batch in batches:
            texts = batch.column(text).to_pylist()
            for k, raw in enumerate(batch.column(f"{own}spans").to_pylist()):
                if raw:
                    places = [m.span() for m in WORD.finditer(texts[k])]
                    for a, b in np.frombuffer(raw, "<i8").reshape(-1, 2)[::-1]:
                        texts[k] = texts[k][: places[a][0]] + texts[k][places[b - 1][1]:]
            yield with_columns(batch, {text: pa.array(texts, pa.string())})

    return found.mapInArrow(run, extended(found, [T.StructField(text, T.StringType())])).select(*docs.columns)


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated."""
    found = scan(docs.select("doc_id", "text"), benchmark)
    listed = F.array_join(F.array_sort(F.col("items").cast("array<string>")), ",")
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.encode(listed, "utf-8"), 256).alias("items_sha256"),
                        contaminated().alias("contaminated"))


ORACLE = r"""
WITH d AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
        'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
    SELECT item_id, w, least(len(w), 13) AS n FROM (
        SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
            'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark)
    WHERE len(w) > 0),
bw AS (
    SELECT DISTINCT item_id, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS gram
    FROM (SELECT item_id, n, w, unnest(range(1, len(w) - n + 2)) AS i FROM b)),
dw AS (
    SELECT doc_id, i, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS gram
    FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i
          FROM d CROSS JOIN (SELECT DISTINCT n FROM b) WHERE len(w) >= n)),
hits AS (SELECT doc_id, i, n, item_id FROM dw JOIN bw USING (n, gram)),
covered AS (
    SELECT doc_id, count(DISTINCT p) AS n_hit
    FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT doc_id, i, n FROM hits)) GROUP BY doc_id),
named AS (
    SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
    FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(c.n_hit, 0) AS BIGINT) AS n_hit,
    CAST(coalesce(n.n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(n.items, '')) AS items_sha256,
    coalesce(c.n_hit, 0) > 0 AND 20 * coalesce(c.n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN covered c USING (doc_id) LEFT JOIN named n USING (doc_id)
"""
