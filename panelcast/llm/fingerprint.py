"""Document fingerprints: threshold-scaled sketches of word shingles.

A sketch keeps every shingle hash below a fixed fraction (1/``scale``) of the
hash range, so its size follows the text and sketches of very unequal texts
stay comparable: the union of two sketches gives the sketch of the union, and
the share of one's hashes in the other estimates containment without bias.
So that short texts have one too, a sketch keeps at least the ``least``
smallest hashes, or all if there are no more. Two sketches are compared up to
the hash that both are complete to. Only DataFrame and SQL functions are used.

Words are runs of letters and digits of the lower-cased text; a text of fewer
than ``n`` words but some has one shingle, all its words. A fingerprint is the
sorted distinct kept hashes in hexadecimal, joined by commas, behind the MD5 of
the text, so equal texts have equal fingerprints and texts without a word still
differ from others. The likeness is 1 for equal texts, else the estimated
Jaccard similarity of the shingles (0 where there are none), exact for texts
of fewer than ``least`` shingles.

The next document is that of the next lower id, and after the last comes the
first; rows of the same id are ordered by text, a null id is the lowest, a
single document is its own next. Null text is empty. Repeated rows are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

NGRAM = 5
BITS = 44    # of a shingle's hash
SCALE = 8    # one shingle hash in so many is kept, and
LEAST = 64   # at least so many of a text
COARSE = 256           # ranges of ids by quantiles, and
RANGE_BYTES = 32 << 20  # text in one of their even parts


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once a row, also where lambdas use it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def shingle_hashes(text: Column, n: int = NGRAM) -> Column:
    """``BITS``-bit hashes of all word shingles of a text."""
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")

    def of(h: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(h) - n + 1, F.lit(1)))
        return F.when(F.size(h) == 0, F.array().cast("array<bigint>")).otherwise(
            F.transform(starts, lambda i: F.shiftrightunsigned(F.xxhash64(F.slice(h, i, n)), 64 - BITS)))

    return _let(F.transform(words, lambda w: F.xxhash64(w)), of)


def _bound(scale: int) -> Column:
    return F.lit((1 << BITS) // scale)


def _kept(hashes: Column, scale: int, least: int) -> Column:
    """Sorted distinct hashes below 1/scale of the range, or the ``least`` smallest."""
    def sized(low: Column) -> Column:
        return F.when(F.size(low) >= least, low).otherwise(
            F.slice(F.sort_array(F.array_distinct(hashes)), 1, least))

    return _let(F.sort_array(F.array_distinct(F.filter(hashes, lambda h: h < _bound(scale)))), sized)


def _complete_to(a: Column, scale: int, least: int) -> Column:
    """The hash up to which a sketch holds every hash of its text."""
    return F.when(F.size(a) < least, F.lit(1 << BITS)).otherwise(
        F.greatest(_bound(scale) - 1, F.element_at(a, -1)))


def _compared(a: Column, b: Column, scale: int, least: int, body) -> Column:
    """``body(a, b, top)``: two sketches and the hash that both are complete to."""
    def inner(pair: Column) -> Column:
        x, y = pair["x"], pair["y"]
        top = F.least(_complete_to(x, scale, least), _complete_to(y, scale, least))
        return _let(top, lambda t: body(x, y, t))

    return _let(F.struct(a.alias("x"), b.alias("y")), inner)


def _up_to(a: Column, top: Column) -> Column:
    return F.size(F.filter(a, lambda h: h <= top))


def sketch(text: Column, n: int = NGRAM, scale: int = SCALE, least: int = LEAST) -> Column:
    """Sorted distinct shingle hashes below 1/scale of the hash range, at least the ``least`` smallest."""
    return _let(shingle_hashes(text, n), lambda found: _kept(found, scale, least))


def merge(a: Column, b: Column, scale: int = SCALE, least: int = LEAST) -> Column:
    """The sketch of two texts' shingles together."""
    return _compared(a, b, scale, least, lambda x, y, top: _let(
        F.filter(F.array_union(x, y), lambda h: h <= top), lambda both: _kept(both, scale, least)))


def containment(a: Column, b: Column, scale: int = SCALE, least: int = LEAST) -> Column:
    """Estimated share of a's shingles that b has (null: no hash of a can be compared)."""
    return _compared(a, b, scale, least, lambda x, y, top: F.try_divide(
        F.size(F.array_intersect(x, y)), _up_to(x, top)))


def jaccard(a: Column, b: Column, scale: int = SCALE, least: int = LEAST) -> Column:
    """Estimated Jaccard similarity (0 where there is nothing to compare)."""
    return _compared(a, b, scale, least, lambda x, y, top: _let(
        F.size(F.array_intersect(x, y)), lambda both: F.coalesce(
            F.try_divide(both, _up_to(x, top) + _up_to(y, top) - both), F.lit(0.0))))


def likeness(text_a: Column, a: Column, text_b: Column, b: Column) -> Column:
    return F.when(text_a == text_b, F.lit(1.0)).otherwise(jaccard(a, b))


def render(digest: Column, a: Column) -> Column:
    return F.concat_ws(":", digest, F.array_join(F.transform(a, F.hex), ","))


def add_sketch(df: DataFrame, text: str = "text", to: str = "sketch", n: int = NGRAM, scale: int = SCALE,
               least: int = LEAST) -> DataFrame:
    """Add the sketch of every whole text."""
    return df.withColumn(to, sketch(F.coalesce(F.col(f"`{text}`"), F.lit("")), n, scale, least))


def id_ranges(df: DataFrame, coarse: int = COARSE, range_bytes: int = RANGE_BYTES) -> tuple[Column, int]:
    """Number of each row's range of doc_id, 0 for the highest, and how many
    there are: about one for ``range_bytes`` of text.

    Quantiles cut the ids into ``coarse`` ranges, and each of them is cut evenly.
    """
    cuts = F.lit([k / coarse for k in range(1, coarse)])
    r = df.agg(F.percentile_approx("doc_id", cuts, 100 * coarse).alias("cuts"), F.min("doc_id").alias("low"),
               F.max("doc_id").alias("high"), F.sum(F.octet_length("text").cast("double")).alias("size")).first()
    if r["high"] is None:
        return F.lit(0), 1
    fine = max(1, -(-int(r["size"] or 0) // (coarse * range_bytes)))
    falling = sorted(set(r["cuts"]) - {r["low"]}, reverse=True)
    tops = F.array(*[F.lit(float(x)) for x in [r["high"] + 1, *falling]])
    ends = F.array(*[F.lit(float(x)) for x in [*falling, r["low"]]])
    at = F.size(F.filter(ends, lambda x: x > F.col("doc_id")))
    top, end = F.get(tops, at), F.get(ends, at)
    inner = F.floor((top - 1 - F.col("doc_id")) * fine / (top - end))
    n = fine * (len(falling) + 1)
    return F.when(F.col("doc_id").isNull(), F.lit(n)).otherwise(
        at * fine + F.greatest(F.lit(0), F.least(inner, F.lit(fine - 1)))).cast("int"), n + 1


def with_next(df: DataFrame, coarse: int = COARSE, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(doc_id, text, next) of every row; ``next`` is a struct (text) of the next
    row by falling doc_id. Sketches are left to the reader of the shuffled texts.

    Rows are dealt to ranges of ids, and a window orders each range. The first
    row of a range is also shown, as a guest, to the range above it, whose last
    row it follows. That list has one id for ``range_bytes`` of text.
    """
    spark = df.sparkSession
    df = df.select("doc_id", "text")
    part, _ = id_ranges(df, coarse, range_bytes)
    placed = df.withColumn("part", part)
    tops = sorted((r["part"], r["top"]) for r in placed.groupBy("part").agg(F.max("doc_id").alias("top")).collect())
    follows = [(tops[k][0], tops[(k + 1) % len(tops)][1]) for k in range(len(tops))]
    heads = spark.createDataFrame(follows, "part int, head long")
    guests = (df.join(F.broadcast(heads), df["doc_id"].eqNullSafe(heads["head"]))
              .groupBy("part", "doc_id").agg(F.max("text").alias("text")).select("doc_id", "text", "part"))
    rows = placed.withColumn("guest", F.lit(0)).unionByName(guests.withColumn("guest", F.lit(1)))
    order = W.partitionBy("part").orderBy("guest", F.desc_nulls_last("doc_id"), F.desc("text"))
    return (rows.withColumn("next", F.lead(F.struct("text")).over(order))
            .where("guest = 0").drop("guest", "part"))


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited and near_next of every document."""
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    cut = F.expr("length(text) div 3").cast("int")
    both = (with_next(base).withColumn("n_chars", F.length("text").cast("long"))
            .withColumn("edited", F.concat(F.expr("substring(text, 1, cast(length(text) - length(text) div 3 as int))"),
                                           F.substring(F.col("next.text"), F.lit(1), cut))))
    both = add_sketch(add_sketch(both), "edited", "edited_sketch").withColumn("next_sketch", sketch(F.col("next.text")))
    return both.select(
        "doc_id", "n_chars", F.sha2(F.encode("edited", "utf-8"), 256).alias("edited_sha256"),
        render(F.md5("text"), F.col("sketch")).alias("fingerprint"),
        render(F.md5("edited"), F.col("edited_sketch")).alias("edited_fingerprint"),
        likeness(F.col("text"), F.col("sketch"), F.col("edited"), F.col("edited_sketch")).alias("near_edited"),
        likeness(F.col("text"), F.col("sketch"), F.col("next.text"), F.col("next_sketch")).alias("near_next"))
