"""Helpers shared by the training-data operators."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from panelcast.session import configure, ensure_checkpoint_dir

#: Text handled at once inside a Python task; a longer single document is handled alone.
SLICE_BYTES = 1 << 20


#: Rows of an Arrow batch: texts are long, and a batch is held by both sides.
BATCH_ROWS = 2000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given parquet tables."""
    configure(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def work_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder that the session names."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/panelcast-{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    The columnar form is far smaller than a row checkpoint and cuts lineage in
    the same way: any executor can read it after another is lost.
    """
    path = work_path(df.sparkSession, name)
    df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_slices(batches: Iterator[pa.RecordBatch], column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches into runs of rows of at most ``most`` bytes of ``column``."""
    for batch in batches:
        col = batch.column(batch.schema.get_field_index(column))
        if batch.num_rows == 0 or col.nbytes <= most:
            yield batch
            continue
        lengths = pc.fill_null(pc.binary_length(col), 0).to_pylist()
        start = size = 0
        for i, n in enumerate(lengths):
            if i > start and size + n > most:
                yield batch.slice(start, i - start)
                start, size = i, 0
            size += n
        yield batch.slice(start)


def non_null_text(col) -> pa.Array:
    """A string column without nulls (null: empty) and with a zero offset."""
    col = pc.fill_null(col, "")
    return pa.concat_arrays([col]) if col.offset == 0 else pa.concat_arrays([col, col.slice(0, 0)])


def extended(df: DataFrame, fields: list[T.StructField]) -> T.StructType:
    """The schema of ``df`` with ``fields`` at its end (same-named ones replaced)."""
    new = {f.name.lower() for f in fields}
    return T.StructType([f for f in df.schema.fields if f.name.lower() not in new] + fields)


def with_columns(batch: pa.RecordBatch, columns: dict[str, pa.Array]) -> pa.RecordBatch:
    """``batch`` without same-named columns, then ``columns``."""
    new = {c.lower() for c in columns}
    keep = [(n, batch.column(i)) for i, n in enumerate(batch.schema.names) if n.lower() not in new]
    return pa.RecordBatch.from_arrays([c for _, c in keep] + list(columns.values()),
                                      names=[n for n, _ in keep] + list(columns))


def tokenizer_spec(spark: SparkSession, path: str):
    """Broadcast a tokenizer's JSON text (a file of a few MB, whatever the data)."""
    with open(path, encoding="utf-8") as f:
        text = f.read()
    json.loads(text)
    return spark.sparkContext.broadcast(text)

