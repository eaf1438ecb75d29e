"""Token ids in files of frequency-ranked, byte-aligned variable-length codes.

File format: a shard holds blocks, each followed by one line feed. A block is

    4 bytes   magic ``RKV1``
    u32       documents in the block
    u32       ids in the block
    u32       data bytes
    i64       place of the block's first id among all ids
    per document: u8 1 if the key is not null, i64 key, u32 number of ids
    control bytes: 2 bits an id, four ids a byte, low bits first: bytes - 1
    data bytes: each id's frequency rank, little-endian, in 1 to 4 bytes

with little-endian integers. Rank 0 is the most frequent id of all files;
``ranks/`` beside the shards holds the table (rank, id). Shards are ranges of
ascending keys and are named in that order. A reader needs one table lookup
for each control byte, which gives the sizes of four ids.

Null text is one end id. Null keys come first; rows with the same key are
ordered by their ids. Every row, also a repeated one, is written and read back.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import binary_files, bpe
from .common import extended, stage, with_columns, work_path

MAGIC = b"RKV1"
HEAD = struct.Struct("<4sIIIq")
DOC = np.dtype([("known", "u1"), ("key", "<i8"), ("n", "<u4")])
BLOCK_IDS = 1 << 18
SHARD_IDS = 1 << 21
CUTS = 16                # parts of a range with too many ids

#: Sizes of the four ids of each control byte.
SIZES = ((np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3) + 1


def pack(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control and data bytes of a run of ranks."""
    ranks = ranks.astype("<u4")
    size = 1 + (ranks > 0xFF) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    code = np.zeros(-(-len(ranks) // 4) * 4, np.uint8)
    code[: len(ranks)] = size - 1
    quads = code.reshape(-1, 4)
    control = quads[:, 0] | quads[:, 1] << 2 | quads[:, 2] << 4 | quads[:, 3] << 6
    data = ranks.view(np.uint8).reshape(-1, 4)[np.arange(4) < size[:, None]]
    return control.tobytes(), data.tobytes()


def unpack(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The ranks of control and data bytes."""
    size = SIZES[np.frombuffer(control, np.uint8)].reshape(-1)[:n]
    start = np.cumsum(size) - size
    flat = np.concatenate([np.frombuffer(data, np.uint8), np.zeros(3, np.uint8)])
    out = flat[start].astype(np.uint32)
    for k in (1, 2, 3):
        more = np.flatnonzero(size > k)
        if not more.size:
            break
        out[more] |= flat[start[more] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


def block(first: int, keys: list[int | None], counts: np.ndarray, ranks: np.ndarray) -> bytes:
    docs = np.zeros(len(keys), DOC)
    docs["known"] = [k is not None for k in keys]
    docs["key"] = [k or 0 for k in keys]
    docs["n"] = counts
    control, data = pack(ranks)
    return HEAD.pack(MAGIC, len(keys), len(ranks), len(data), first) + docs.tobytes() + control + data


def blocks(content: bytes):
    """Read a shard in order: (first, documents, ranks) of every block."""
    at = 0
    while at < len(content):
        magic, n_docs, n_ids, n_data, first = HEAD.unpack_from(content, at)
        if magic != MAGIC:
            raise ValueError(f"no block at byte {at}")
        at += HEAD.size
        docs = np.frombuffer(content, DOC, n_docs, at)
        at += docs.nbytes
        control = content[at: (at := at + -(-n_ids // 4))]
        data = content[at: (at := at + n_data)]
        if len(data) != n_data or content[at: at + 1] != b"\n":
            raise ValueError("a block is cut short")
        at += 1
        yield first, docs, unpack(control, data, n_ids)


def _flat(col: pa.Array, kind) -> tuple[np.ndarray, np.ndarray]:
    """All values of a binary column, and how many each row has."""
    col = pa.concat_arrays([col, col.slice(0, 0)])
    offsets = np.frombuffer(col.buffers()[1], np.int32, len(col) + 1, col.offset * 4)
    data = col.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[offsets[0]: offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    size = np.dtype(kind).itemsize
    return np.frombuffer(raw.tobytes(), kind), np.diff(offsets) // size


def _compact(df: DataFrame, ids: str, end_id: int, kind: str) -> DataFrame:
    """``ids`` with the end id, in the narrowest width of the vocabulary."""
    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            values, counts = _flat(batch.column(batch.schema.get_field_index(ids)), np.uint32)
            ends = np.cumsum(counts)
            narrow = np.insert(values, ends, end_id).astype(kind)
            offsets = np.concatenate([[0], np.cumsum(counts + 1)]) * narrow.itemsize
            col = pa.Array.from_buffers(pa.binary(), len(counts), [
                None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(narrow)])
            yield with_columns(batch, {ids: col, "n_ids": pa.array(counts.astype(np.int64) + 1)})

    return df.mapInArrow(run, extended(df, [T.StructField(ids, T.BinaryType()), T.StructField("n_ids", T.LongType())]))


def frequency_ranks(coded: DataFrame, kind: str) -> DataFrame:
    """(rank, id) by falling count, then id; at most the vocabulary's rows."""
    def counts(batches):
        total = np.zeros(0, np.int64)
        for batch in batches:
            found = np.bincount(_flat(batch.column(0), kind)[0])
            if len(found) > len(total):
                total = np.concatenate([total, np.zeros(len(found) - len(total), np.int64)])
            total[: len(found)] += found
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"id": pa.array(seen, pa.int64()), "n": pa.array(total[seen], pa.int64())})

    found = (coded.select("ids").mapInArrow(counts, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
             .orderBy(F.desc("n"), "id").collect())
    return coded.sparkSession.createDataFrame([(k, r["id"]) for k, r in enumerate(found)], "rank long, id long")


def shard_bounds(coded: DataFrame, shard_ids: int) -> list[int]:
    """Keys that end the shards but the last, each of about ``shard_ids`` ids.

    Ranges of keys that hold more than half a shard's ids are cut at quantiles
    of their rows, again until none is left or it is a single key; ranges in a
    row are then joined until the next would go beyond ``shard_ids``. So long
    documents make no larger shards, and their number may be any. The passes
    read two numbers of a row and grow with the logarithm of the shards.
    """
    narrow = coded.select("doc_id", "n_ids")
    cuts = F.array(*[F.lit(k / CUTS) for k in range(1, CUTS)])
    ends: list[int] = []
    while True:
        found = (with_shard(narrow, ends).groupBy("shard")
                 .agg(F.sum("n_ids").alias("n"), F.percentile_approx("doc_id", cuts, 100 * CUTS).alias("cuts")).collect())
        new = {x for r in found if 2 * r["n"] > shard_ids for x in r["cuts"] or []} - set(ends)
        if not new or len(found) == 1 and found[0]["n"] <= shard_ids:
            break
        ends = sorted(new | set(ends))
    sums = {r["shard"]: r["n"] for r in found}
    bounds, held = [], 0
    for k, end in enumerate(ends):
        held += sums.get(k, 0)
        if held + sums.get(k + 1, 0) > shard_ids:
            bounds.append(end)
            held = 0
    return bounds


def with_shard(coded: DataFrame, bounds: list[int]) -> DataFrame:
    """Add ``shard``: how many bounds are below the key (null keys: 0)."""
    if not bounds:
        return coded.withColumn("shard", F.lit(0))

    def run(batches):
        edges = np.array(bounds, np.int64)
        for batch in batches:
            keys = batch.column(batch.schema.get_field_index("doc_id"))
            low = pc.fill_null(keys, np.iinfo(np.int64).min).to_numpy(zero_copy_only=False)
            yield with_columns(batch, {"shard": pa.array(np.searchsorted(edges, low).astype(np.int32))})

    return coded.mapInArrow(run, extended(coded, [T.StructField("shard", T.IntegerType())]))


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int, text: str = "text",
          shard_ids: int = SHARD_IDS) -> None:
    """Write the ids of every text, each with ``end_id`` behind, under ``path``."""
    spark = docs.sparkSession
    spec = bpe.tokenizer_spec(spark, tokenizer)
    kind = "<u2" if bpe.Codec(spec.value).id_bytes == 2 and end_id < 1 << 16 else "<u4"
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    coded = _compact(bpe.encode(own, tokenizer, keep=["doc_id"]), "ids", end_id, kind)
    coded = stage(coded, "ids")
    ranks = frequency_ranks(coded, kind)
    ranks.coalesce(1).write.parquet(f"{path}/ranks")
    table = np.zeros(1 << 8 * np.dtype(kind).itemsize if kind == "<u2" else
                     int(ranks.agg(F.max("id")).first()[0] or 0) + 1, np.uint32)
    for r in ranks.collect():
        table[r["id"]] = r["rank"]
    rank_of = spark.sparkContext.broadcast(table)
    bounds = shard_bounds(coded, shard_ids)
    sharded = with_shard(coded, bounds)
    narrow = with_shard(coded.select("doc_id", "n_ids"), bounds)
    sizes = {r["shard"]: r["n"] for r in narrow.groupBy("shard").agg(F.sum("n_ids").alias("n")).collect()}
    base, total = {}, 0
    for s in sorted(sizes):
        base[s] = total
        total += sizes[s]
    base_of = spark.sparkContext.broadcast(base)

    def encoded(batches):
        shard, place, keys, counts, parts, held = None, 0, [], [], [], 0

        def flush():
            nonlocal place, keys, counts, parts, held
            ranks = np.concatenate(parts) if parts else np.zeros(0, np.uint32)
            out = pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "record": [
                block(place, keys, np.array(counts, np.int64), ranks)]})
            place, keys, counts, parts, held = place + held, [], [], [], 0
            return out

        for batch in batches:
            values, sizes = _flat(batch.column(2), kind)
            ranked, ends = rank_of.value[values], np.cumsum(sizes)
            for s, key, n, end in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), sizes, ends, strict=True):
                if s != shard:
                    if keys:
                        yield flush()
                    shard, place = s, base_of.value[s]
                keys.append(key)
                counts.append(n)
                parts.append(ranked[end - n: end])
                held += int(n)
                if held >= BLOCK_IDS:
                    yield flush()
        if keys:
            yield flush()

    rows = (sharded.select("shard", "doc_id", "ids").repartition(max(2 * len(base), 1), "shard")
            .sortWithinPartitions("shard", F.asc_nulls_first("doc_id"), "ids")
            .mapInArrow(encoded, "shard int, record binary")
            .withColumn("shard", F.format_string("%08d", "shard")))
    binary_files.write_rows(rows, f"{path}/shards", b"\n", partition_by="shard")


def read(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of every document in the files."""
    rows = spark.read.schema("rank long, id long").parquet(f"{path}/ranks").orderBy("rank").collect()
    ids_of = spark.sparkContext.broadcast(np.array([r["id"] for r in rows], "<u4"))

    def decoded(batches):
        for batch in batches:
            for content in batch.column(0):
                for first, docs, ranks in blocks(content.as_py()):
                    ids = ids_of.value[ranks]
                    offsets = np.concatenate([[0], np.cumsum(docs["n"].astype(np.int64))])
                    yield pa.RecordBatch.from_arrays([
                        pa.array(docs["key"].astype(np.int64), mask=docs["known"] == 0),
                        pa.array(first + offsets[:-1]), pa.array(docs["n"].astype(np.int64)),
                        pa.Array.from_buffers(pa.binary(), len(docs), [
                            None, pa.py_buffer((offsets * 4).astype(np.int32)), pa.py_buffer(ids)])],
                        names=["doc_id", "start", "n_tokens", "ids"])

    return (binary_files.read_files(spark, f"{path}/shards").select("content")
            .mapInArrow(decoded, "doc_id long, start long, n_tokens long, ids binary"))


def round_trip(docs: DataFrame, tokenizer: str, end_id: int = 2) -> DataFrame:
    """Write the files, read them back: doc_id, start, n_tokens, ids_crc32."""
    spark = docs.sparkSession
    path = work_path(spark, "token-files")
    write(docs, path, tokenizer, end_id)
    return read(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
