"""WARC archives: written from pages, and read back record by record.

An archive is a row of gzip members, one for each record. Spark's writer puts
an empty member behind each record, which readers of such files skip. The
reader walks through an archive in order: it inflates one member at a time in
bounded steps, takes the header up to the blank line, frames the block by
Content-Length, and checks the digests of block and payload.

Records of equal payloads of at least ``least_bytes`` become one ``response``
and ``revisit`` records that refer to it (identical-payload-digest profile);
rows that share the largest id and the payload are all responses. A null
payload is empty. A null id is never the largest, and such a row is always a
response. Every row becomes one record, also repeated ones. An empty table
gives an archive folder without records.
"""

from __future__ import annotations

import base64
import hashlib
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import binary_files
from .common import stage, work_path

LEAST_BYTES = 1000
STEP = 1 << 16
EMPTY_MEMBER = bytes([31, 139, 8, 0, 0, 0, 0, 0, 0, 255, 3, 0, 0, 0, 0, 0, 0, 0, 0, 0])
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
READ = ("page_id long, url string, record_type string, refers_to long, payload_digest string, "
        "payload_bytes long, payload binary")


def sha1_label(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def page_of(urn: str | None) -> int | None:
    found = (urn or "").removeprefix("<urn:page:").removesuffix(">")
    return int(found) if found else None


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One record as a gzip member."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    http += b"Content-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
             f"WARC-Record-ID: {record_id(page_id)}", "WARC-Date: 1970-01-01T00:00:00Z",
             f"WARC-Payload-Digest: {sha1_label(payload)}", f"WARC-Block-Digest: {sha1_label(block)}",
             "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + " ".join(url.split()))
    if refers_to is not None:
        lines += [f"WARC-Refers-To: {record_id(refers_to)}", f"WARC-Profile: {PROFILE}"]
    packer = zlib.compressobj(4, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + packer.flush()


def members(content: bytes):
    """The inflated gzip members of an archive, in order, empty ones left out."""
    at, view = 0, memoryview(content)
    while at < len(content):
        inflate, parts = zlib.decompressobj(31), []
        while not inflate.eof:
            if at >= len(content):
                raise ValueError("the archive ends inside a member")
            parts.append(inflate.decompress(view[at: at + STEP]))
            at += min(STEP, len(content) - at)
        at -= len(inflate.unused_data)
        if any(parts):
            yield b"".join(parts)


def parse(raw: bytes) -> dict:
    """Type, ids, digest and payload of a record; raises where it is damaged."""
    end = raw.index(b"\r\n\r\n")
    lines = raw[:end].decode().split("\r\n")
    if not lines[0].startswith("WARC/1."):
        raise ValueError("no WARC record")
    head = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    size = int(head["content-length"])
    block = raw[end + 4: end + 4 + size]
    if len(block) != size or raw[end + 4 + size:] != b"\r\n\r\n":
        raise ValueError("the block doesn't have its Content-Length")
    if sha1_label(block) != head["warc-block-digest"]:
        raise ValueError("the block doesn't have its digest")
    response = head["warc-type"] == "response"
    payload = block[block.index(b"\r\n\r\n") + 4:] if response else None
    if response and sha1_label(payload) != head["warc-payload-digest"]:
        raise ValueError("the payload doesn't have its digest")
    return {"page_id": page_of(head["warc-record-id"]), "url": head.get("warc-target-uri"),
            "record_type": head["warc-type"], "refers_to": page_of(head.get("warc-refers-to")),
            "payload_digest": base64.b32decode(head["warc-payload-digest"].removeprefix("sha1:")).hex(),
            "payload_bytes": len(payload) if response else None, "payload": payload}


def write(pages: DataFrame, path: str, least_bytes: int = LEAST_BYTES) -> None:
    """Write a record of every row (page_id, url, html) under ``path``."""
    payload = F.coalesce(F.encode("html", "utf-8"), F.lit(b""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                        payload.alias("payload"), F.sha1(payload).alias("digest"))
    large = rows.where(F.octet_length("payload") >= least_bytes).select("page_id", "digest")
    first = large.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n")).where("n > 1")
    # only narrow rows are joined by digest; where one is very common, Spark splits its side
    again = (large.join(first, "digest").where("page_id < refers_to")
             .select(F.col("page_id").alias("own"), F.col("digest").alias("same"), "refers_to").distinct())
    whole = rows.join(again, (rows["page_id"] == again["own"]) & (rows["digest"] == again["same"]), "left")

    def packed(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"record": [
                record(*x) for x in zip(*[c.to_pylist() for c in batch.columns], strict=True)]},
                schema=pa.schema([("record", pa.binary())]))

    binary_files.write_rows(whole.select("page_id", "url", "payload", "refers_to").mapInArrow(packed, "record binary"),
                            path, EMPTY_MEMBER)


def read(spark: SparkSession, path: str) -> DataFrame:
    """All records of the archives under ``path``; revisits have no payload."""
    names = ["page_id", "url", "record_type", "refers_to", "payload_digest", "payload_bytes", "payload"]
    types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]

    def unpacked(batches):
        def rows(found):
            return pa.RecordBatch.from_arrays(
                [pa.array([r[n] for r in found], t) for n, t in zip(names, types, strict=True)], names=names)

        for batch in batches:
            for content in batch.column(0):
                held, size = [], 0
                for raw in members(content.as_py()):
                    held.append(parse(raw))
                    size += len(raw)
                    if size > 4 << 20:
                        yield rows(held)
                        held, size = [], 0
                yield rows(held)

    return binary_files.read_files(spark, path).select("content").mapInArrow(unpacked, READ)


def round_trip(pages: DataFrame) -> DataFrame:
    """Write the archives and read them back: page_id, payload_bytes,
    payload_digest, record_type and refers_to. The size of a revisit's payload
    is that of the response it refers to, if the digests agree."""
    spark = pages.sparkSession
    path = work_path(spark, "warc")
    write(pages, path)
    found = stage(read(spark, path).drop("payload", "url"), "warc-records")
    again = found.where("record_type = 'revisit'")
    wanted = again.select(F.col("refers_to").alias("page_id"), "payload_digest").distinct()
    sizes = (found.where("record_type = 'response'").join(wanted, ["page_id", "payload_digest"], "left_semi")
             .groupBy(F.col("page_id").alias("refers_to"), "payload_digest")
             .agg(F.first("payload_bytes").alias("full_bytes")))
    revisits = again.join(sizes, ["refers_to", "payload_digest"], "left").select(
        "page_id", F.col("full_bytes").alias("payload_bytes"), "payload_digest", "record_type", "refers_to")
    return found.where("record_type = 'response'").select(revisits.columns).unionByName(revisits)


ORACLE = """
WITH p AS (
    SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes,
        sha1(coalesce(html, '')) AS payload_digest FROM pages),
f AS (
    SELECT payload_digest, max(page_id) AS latest FROM p WHERE payload_bytes >= 1000 GROUP BY payload_digest)
SELECT page_id, payload_bytes, payload_digest,
    CASE WHEN page_id < latest THEN 'revisit' ELSE 'response' END AS record_type,
    CASE WHEN page_id < latest THEN latest END AS refers_to
FROM p LEFT JOIN f USING (payload_digest)
"""
