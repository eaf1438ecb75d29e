"""Raw binary files through Spark's own writer and reader.

Rows of bytes are written by the text writer, so commits, retries and any
file system that Spark can reach work as for other tables. The writer puts a
separator behind each row; formats here choose one that is valid in them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_rows(df: DataFrame, path: str, separator: bytes, partition_by: str | None = None) -> None:
    """Write the binary column ``record`` of every row, in row order."""
    rows = df.select(*([F.col(partition_by)] if partition_by else []), F.col("record").cast("string").alias("value"))
    writer = rows.write.option("encoding", "ISO-8859-1").option("lineSep", separator.decode("latin-1"))
    (writer.partitionBy(partition_by) if partition_by else writer).text(path)


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """One row (path, content) for each file that write_rows made."""
    return (spark.read.format("binaryFile").option("recursiveFileLookup", "true")
            .option("pathGlobFilter", "part-*").load(path).select("path", "content"))
