"""N-gram Jaccard self-join by MinHash banding.

Texts are sets of word n-grams. Rows with equal sets are copies and stand for
one set. Every set has ``bands`` keys of ``rows`` minima; sets that share a key
may be alike. Groups of sets connected by keys are checked in full: the sets
of a group are dealt over blocks, each pair of blocks is one task's work, and
all pairs of sets in it are compared by exact intersections. No pair becomes a
row: a task gives each set its number of links and one edge to a linked set,
so a group of m alike texts costs m rows for each block pair.

Bands and rows follow from the threshold and the recall wanted of a pair just
at the threshold (see ``banding``).

Rows with no words (null, empty or signs only) have the empty set: they are
copies of one another and link to nothing else. A text shorter than n words is
one gram. Rows with a null key take no part and get a null class and no links.
Rows that share a key count as one document. Repeated rows are copies. Other
columns are never read; an empty table gives an empty result.
"""

from __future__ import annotations

import uuid
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcast.session import cut_lineage

from . import ngram_sets
from .common import non_null_text, stage, text_slices
from .graph import components

NGRAM = 5
THRESHOLD = 0.8
RECALL = 0.9999
HASHES = 192
BLOCK_SETS = 256
BLOCK_GRAMS = 1 << 21


def banding(threshold: float = THRESHOLD, recall: float = RECALL, hashes: int = HASHES) -> tuple[int, int]:
    """(bands, rows): the most selective rows, with bands so many that a pair at
    the threshold shares a key with probability ``recall``, within ``hashes``."""
    best = (hashes, 1)
    for rows in range(1, hashes + 1):
        miss = 1 - threshold ** rows
        bands = int(np.ceil(np.log(1 - recall) / np.log(miss)))
        if bands * rows > hashes:
            break
        best = (bands, rows)
    return best


def features(docs: DataFrame, n: int, bands: int, rows: int) -> DataFrame:
    """doc_id, set_key, n_grams and band keys of every row."""
    def run(batches):
        for batch in text_slices(batches, "text"):
            grams, offsets = ngram_sets.gram_sets(non_null_text(batch.column(1)), n)
            keys = ngram_sets.band_keys(grams, offsets, bands, rows).view(np.int64)
            filled = np.diff(offsets) > 0
            ends = np.concatenate([[0], np.cumsum(filled) * bands]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array(ngram_sets.set_keys(grams, offsets), pa.binary()),
                pa.array(np.diff(offsets)), pa.ListArray.from_arrays(pa.array(ends), pa.array(keys.reshape(-1)))],
                names=["doc_id", "set_key", "n_grams", "bands"])

    return (docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
            .mapInArrow(run, "doc_id long, set_key binary, n_grams long, bands array<long>"))


def _sets(docs: DataFrame, n: int) -> DataFrame:
    """Add the set's key and its sorted grams to (doc_id, text, ...)."""
    def run(batches):
        for batch in text_slices(batches, "text"):
            at = batch.schema.get_field_index("text")
            grams, offsets = ngram_sets.gram_sets(non_null_text(batch.column(at)), n)
            rest = [(f, c) for f, c in zip(batch.schema.names, batch.columns, strict=True) if f != "text"]
            yield pa.RecordBatch.from_arrays(
                [c for _, c in rest] + [pa.array(ngram_sets.set_keys(grams, offsets), pa.binary()),
                                        ngram_sets.packed(grams, offsets)],
                names=[f for f, _ in rest] + ["text_key", "grams"])

    fields = ", ".join(f"{f} {t}" for f, t in docs.dtypes if f != "text")
    return docs.mapInArrow(run, f"{fields}, text_key binary, grams binary")


def _columns(sets: list[np.ndarray], place: np.ndarray) -> list[np.ndarray]:
    ends = np.cumsum([len(s) for s in sets])
    return [place[e - len(s): e] for e, s in zip(ends, sets, strict=True)]


def overlaps(left: list[np.ndarray], right: list[np.ndarray] | None, chunk: int = 4096) -> np.ndarray:
    """Sizes of the intersections of all pairs (right None: of left with itself)."""
    both = left + (right or [])
    grams, place = np.unique(np.concatenate(both), return_inverse=True)
    cols = _columns(both, place)
    a, b = cols[: len(left)], cols[len(left):] if right is not None else cols
    if right is None:
        shared = np.bincount(place, minlength=len(grams)) > 1
    else:
        shared = np.isin(np.arange(len(grams)), np.concatenate(a)) & np.isin(np.arange(len(grams)), np.concatenate(b))
    number = np.cumsum(shared) - 1
    a = [number[c[shared[c]]] for c in a]
    b = a if right is None else [number[c[shared[c]]] for c in b]
    out = np.zeros((len(a), len(b)), np.float64)
    for begin in range(0, int(shared.sum()), chunk):
        def dense(rows):
            m = np.zeros((len(rows), chunk), np.float32)
            for k, c in enumerate(rows):
                lo, hi = np.searchsorted(c, [begin, begin + chunk])
                m[k, c[lo:hi] - begin] = 1
            return m
        x = dense(a)
        out += x @ (x if right is None else dense(b)).T
    return out


def _forest(alike: np.ndarray) -> np.ndarray:
    """For each row of a symmetric matrix, the first member of its component."""
    root = np.full(len(alike), -1)
    for k in range(len(alike)):
        if root[k] >= 0:
            continue
        seen = np.zeros(len(alike), bool)
        seen[k] = True
        edge = seen
        while edge.any():
            reach = alike[edge].any(axis=0) & ~seen
            seen |= reach
            edge = reach
        root[seen] = k
    return root


def _check(rows: dict[str, list], threshold: Fraction) -> tuple[list, list, list]:
    """Links of one pair of blocks: (set, set it is joined to, linked documents)."""
    side = np.array(rows["side"])
    same = rows["lo"][0] == rows["hi"][0]
    if len(side) < 2 or not same and (side.all() or not side.any()):
        return [], [], []
    rep, copies = np.array(rows["rep"]), np.array(rows["copies"])
    grams = [np.frombuffer(g, np.uint64) for g in rows["grams"]]
    size = np.array([len(g) for g in grams])
    x = np.arange(len(rep)) if same else np.flatnonzero(side == 0)
    y = x if same else np.flatnonzero(side == 1)
    both = overlaps([grams[k] for k in x], None if same else [grams[k] for k in y])
    alike = threshold.denominator * both >= threshold.numerator * (size[x][:, None] + size[y][None, :] - both)
    if same:
        np.fill_diagonal(alike, False)
        whole, links = alike, alike @ copies
    else:
        whole = np.zeros((len(rep), len(rep)), bool)
        whole[np.ix_(x, y)] = alike
        whole |= whole.T
        links = whole @ copies
    root = _forest(whole)
    hit = np.flatnonzero(links)
    return rep[hit].tolist(), rep[root[hit]].tolist(), links[hit].tolist()


def _checked(batches, threshold: Fraction):
    """Run _check on every run of rows with the same (component, lo, hi)."""
    key, held = None, None
    for batch in batches:
        rows = batch.to_pydict()
        for k in range(batch.num_rows):
            now = (rows["component"][k], rows["lo"][k], rows["hi"][k])
            if now != key:
                if held:
                    yield _links(_check(held, threshold))
                key, held = now, {c: [] for c in rows}
            for c in rows:
                held[c].append(rows[c][k])
    if held:
        yield _links(_check(held, threshold))


def _links(found) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in found], names=["a", "b", "links"])


def join(docs: DataFrame, threshold: float = THRESHOLD, n: int = NGRAM, recall: float = RECALL) -> DataFrame:
    """One row per row of ``docs``: doc_id, class_id (the least key of the texts
    that links and copies connect), n_links (other rows with similarity of at
    least ``threshold``, copies among them), n_copies and n_grams."""
    bands, rows = banding(threshold, recall)
    feats = stage(features(docs, n, bands, rows), "ngram-features")
    known = feats.where("doc_id is not null")
    sets = known.groupBy("set_key").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies"))
    sets = stage(sets, "ngram-sets")
    reps = (known.withColumnRenamed("doc_id", "rep").join(sets, ["set_key", "rep"])
            .dropDuplicates(["set_key", "rep"]))
    keys = reps.select("rep", F.explode("bands").alias("band"))
    hubs = keys.groupBy("band").agg(F.min("rep").alias("hub"), F.count(F.lit(1)).alias("n")).where("n > 1")
    near = components(keys.join(hubs, "band").where("rep <> hub").select(F.col("rep").alias("a"), F.col("hub").alias("b")))
    groups = near.withColumnRenamed("node", "rep").join(reps.select("rep", "set_key", "n_grams", "copies"), "rep")
    blocks = (groups.groupBy("component").agg(F.count(F.lit(1)).alias("n"), F.sum("n_grams").alias("grams"))
              .select("component", F.greatest(F.ceil(F.col("n") / BLOCK_SETS), F.ceil(F.col("grams") / BLOCK_GRAMS))
                      .cast("int").alias("n_blocks")))
    members = groups.join(blocks, "component").select(
        "rep", "set_key", "copies", "component", "n_blocks",
        F.pmod(F.xxhash64("rep"), F.col("n_blocks")).cast("int").alias("block"))
    texts = docs.select(F.col("doc_id").cast("long").alias("rep"), "text").join(members, "rep")
    full = (_sets(texts, n).where("text_key = set_key").drop("text_key", "set_key")
            .withColumn("other", F.explode(F.expr("sequence(0, n_blocks - 1)")))
            .select("component", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"),
                    F.expr("cast(block > other as int)").alias("side"), "rep", "copies", "grams"))
    limit = Fraction(str(threshold))
    parts = docs.sparkSession.conf.get("spark.sql.shuffle.partitions")
    checked = (full.repartition(int(parts), "component", "lo", "hi")
               .sortWithinPartitions("component", "lo", "hi", "rep", "side")
               .mapInArrow(lambda b: _checked(b, limit), "a long, b long, links long"))
    checked = stage(checked, "ngram-links")
    classes = components(checked.select("a", "b"))
    links = (checked.groupBy(F.col("a").alias("rep")).agg(F.sum("links").alias("links"))
             .join(classes.withColumnRenamed("node", "rep"), "rep", "left"))
    found = sets.join(links, "rep", "left")
    return feats.join(found, "set_key", "left").select(
        "doc_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "rep")).alias("class_id"),
        F.when(F.col("doc_id").isNull(), F.lit(0)).otherwise(F.coalesce("links", F.lit(0)) + F.col("copies") - 1)
        .cast("long").alias("n_links"), F.coalesce("copies", F.lit(0)).cast("long").alias("n_copies"), "n_grams")


def one_of_each(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with one row of each class, that of the least key; rows with a
    null key stay. Of rows that share that key the one whose text, then whose
    other columns as text, sort first stays."""
    kept = f"kept_{uuid.uuid4().hex}"
    found = join(docs, **options).where("doc_id = class_id").select(F.col("doc_id").alias(kept)).distinct()
    null = docs.where(docs["doc_id"].isNull())
    rows = docs.join(found, docs["doc_id"] == F.col(kept), "left_semi")
    # a key with one row, as nearly all have, is no more than counted
    again = rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias(kept)).where(F.col(kept) > 1).select(F.col("doc_id").alias(kept))
    again = cut_lineage(again)
    if again.isEmpty():
        return rows.unionByName(null)
    single = rows.join(again, rows["doc_id"] == F.col(kept), "left_anti")
    several = rows.join(again, rows["doc_id"] == F.col(kept), "left_semi")
    order = F.struct(F.col("text"), F.to_json(F.struct(*docs.columns)).alias("rest"))
    first = several.groupBy("doc_id").agg(F.min_by(F.struct(*docs.columns), order).alias(kept)).select(f"{kept}.*")
    return single.unionByName(first).unionByName(null)


#: All pairs by shared grams, for small tables.
ORACLE = r"""
WITH RECURSIVE d AS (
    SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
s AS (
    SELECT doc_id, CASE WHEN len(w) = 0 THEN [] ELSE list_distinct(list_transform(range(1, greatest(len(w) - 4, 1) + 1),
        lambda i: array_to_string(list_slice(w, i, i + 4), ' '))) END AS g FROM d),
k AS (SELECT doc_id, g, len(g) AS n_grams, md5(array_to_string(list_sort(g), '|')) AS set_key FROM s),
c AS (
    SELECT *, min(doc_id) OVER (PARTITION BY set_key, n_grams) AS rep,
        count(*) OVER (PARTITION BY set_key, n_grams) AS n_copies FROM k),
e AS (SELECT doc_id AS rep, n_grams, n_copies, unnest(g) AS gram FROM c WHERE doc_id = rep),
l AS (
    SELECT a.rep AS a, b.rep AS b, b.n_copies AS links
    FROM e a JOIN e b ON a.gram = b.gram AND a.rep <> b.rep
    GROUP BY a.rep, b.rep, a.n_grams, b.n_grams, b.n_copies
    HAVING 5 * count(*) >= 4 * (a.n_grams + b.n_grams - count(*))),
r(node, root) AS (
    SELECT rep, rep FROM c
    UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.node),
classes AS (SELECT node, min(root) AS class_id FROM r GROUP BY node),
linked AS (SELECT a, sum(links) AS n FROM l GROUP BY a)
SELECT c.doc_id, m.class_id, CAST(coalesce(x.n, 0) + c.n_copies - 1 AS BIGINT) AS n_links,
    CAST(c.n_copies AS BIGINT) AS n_copies, CAST(c.n_grams AS BIGINT) AS n_grams
FROM c JOIN classes m ON m.node = c.rep LEFT JOIN linked x ON x.a = c.rep
"""
