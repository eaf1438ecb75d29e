"""Writers (K1-K6). Outputs are partitioned parquet by default; CSV only for
small report exports. Empty results are refused, as the pipeline did."""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class EmptyResultError(ValueError):
    pass


class _Folder:
    """Hadoop's file system calls on paths beside one table."""

    def __init__(self, spark: SparkSession, path: str):
        self.path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self.fs = self.path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def exists(self, path: str) -> bool:
        return self.fs.exists(self.path(path))

    def remove(self, path: str) -> None:
        self.fs.delete(self.path(path), True)

    def rename(self, old: str, new: str) -> None:
        self.fs.mkdirs(self.path(new).getParent())
        if not self.fs.rename(self.path(old), self.path(new)):
            raise OSError(f"{old} can't be renamed to {new}")

    def names(self, path: str, folders: bool = True) -> list[str]:
        found = self.fs.listStatus(self.path(path)) if self.exists(path) else []
        return sorted(f.getPath().getName() for f in found if f.isDirectory() == folders)

    def leaves(self, path: str, depth: int, under: str = "") -> list[str]:
        """Partition folders ``depth`` levels below ``path``."""
        if not depth:
            return [under]
        own = [n for n in self.names(f"{path}/{under}".rstrip("/")) if "=" in n]
        return [x for n in own for x in self.leaves(path, depth - 1, f"{under}/{n}".lstrip("/"))]


def recover(spark: SparkSession, path: str) -> None:
    """Put back a table whose writer died between its two renames."""
    path = path.rstrip("/")
    folder = _Folder(spark, path)
    if folder.exists(path):
        return
    parent, _, name = path.rpartition("/")
    aside = [n for n in folder.names(parent) if n.startswith(f"{name}.old-")]
    if aside:
        folder.rename(f"{parent}/{aside[-1]}", path)


def read_table(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """A table of ``write_table``: its last whole version."""
    recover(spark, path)
    return spark.read.option("header", "true").format(fmt).load(path)


def write_table(df: DataFrame, path: str, partition_by: Sequence[str] = (), fmt: str = "parquet",
                refuse_empty: bool = True, one_file: bool = False, replace: str = "table") -> str:
    """K1/K2/K3: write a panel table, partitioned (e.g. by ticker).

    The data is written once, beside ``path``, and then takes its place by
    renames: the old version is moved aside, the new one in, and the old one is
    removed. If anything fails, the old version goes back, and an empty result
    is refused before ``path`` is touched. With ``replace='partitions'`` only
    the partitions in the result are replaced, each in this way, all or none;
    else partitions that left the result are gone. ``one_file`` gathers a small
    table in one file. Renames of a folder must be atomic, as on HDFS and local
    disks; ``read_table`` also mends what a killed writer left.
    """
    if replace not in ("table", "partitions"):
        raise ValueError("replace must be 'table' or 'partitions'")
    spark, path = df.sparkSession, path.rstrip("/")
    folder, mark = _Folder(spark, path), uuid.uuid4().hex
    fresh, old = f"{path}.new-{mark}", f"{path}.old-{mark}"
    recover(spark, path)
    moved: list[tuple[str, str]] = []

    def move(a: str, b: str) -> None:
        folder.rename(a, b)
        moved.append((a, b))

    try:
        w = (df.repartition(1) if one_file else df).write.option("header", "true")
        (w.partitionBy(*partition_by) if partition_by else w).format(fmt).save(fresh)
        written = spark.read.option("header", "true").schema(df.schema).format(fmt).load(fresh)
        if refuse_empty and written.isEmpty():
            raise EmptyResultError(f"refusing to write an empty table to {path}")
        parts = folder.leaves(fresh, len(partition_by)) if replace == "partitions" and folder.exists(path) else [""]
        for part in parts:
            here = f"{path}/{part}".rstrip("/")
            if folder.exists(here):
                move(here, f"{old}/{part}".rstrip("/"))
            move(f"{fresh}/{part}".rstrip("/"), here)
    except BaseException:
        for a, b in reversed(moved):
            folder.rename(b, a)
        raise
    finally:
        folder.remove(fresh)
        if folder.exists(path):
            folder.remove(old)
    return path


def save_combined(df: DataFrame, root: str, experiment: str) -> str:
    """K1: aligned table of an experiment."""
    return write_table(df, f"{root.rstrip('/')}/combined/{experiment}", ["ticker"])


def save_features(df: DataFrame, root: str, experiment: str) -> str:
    """K2: feature table of an experiment."""
    return write_table(df, f"{root.rstrip('/')}/features/{experiment}", ["ticker"])


def save_backtest(df: DataFrame, root: str) -> str:
    """K3: backtest rows, partitioned by run (experiment, model, horizon).

    Re-running a run replaces its partitions; other runs stay untouched.
    """
    parts = [c for c in ("experiment", "model", "horizon") if c in df.columns]
    return write_table(df, f"{root.rstrip('/')}/backtest", parts, replace="partitions")


def save_metrics(df: DataFrame, root: str, csv_export: bool = False) -> str:
    """K4: metrics summary; the optional CSV export is one small file."""
    path = f"{root.rstrip('/')}/metrics_summary"
    if csv_export:
        return write_table(df, path, fmt="csv", one_file=True)
    return write_table(df, path)


def save_top(df: DataFrame, root: str, name: str = "top_10_forecasts_by_r2") -> str:
    """K5: a top-k table (already limited by its query)."""
    return write_table(df, f"{root.rstrip('/')}/{name}", fmt="csv", one_file=True)


def log_run(spark: SparkSession, root: str, run_name: str,
            params: Mapping[str, object] | None = None,
            metrics: Mapping[str, float] | None = None,
            tags: Mapping[str, object] | None = None) -> DataFrame:
    """K6: append run records (run_name, kind, key, value, ts) to a runs table."""
    now = dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)
    rows = []
    for kind, items in (("param", params), ("metric", metrics), ("tag", tags)):
        for k, v in (items or {}).items():
            # List parameters (feature names) are stored joined by ", "
            text = ", ".join(map(str, v)) if isinstance(v, (list, tuple)) else str(v)
            rows.append((run_name, kind, str(k), text, now))
    df = spark.createDataFrame(rows, "run_name string, kind string, key string, value string, ts timestamp")
    df.write.mode("append").parquet(f"{root.rstrip('/')}/runs")
    return df


def log_metrics_table(metrics_df: DataFrame, root: str, run_col: str = "run_name") -> str:
    """K6 for whole metric tables: one record per (run, metric) without a
    driver loop."""
    cols = [c for c in ("rmse", "mae", "r2", "bias", "directional_accuracy")
            if c in metrics_df.columns]
    long = metrics_df.unpivot([run_col], cols, "key", "v").select(
        run_col, F.lit("metric").alias("kind"), "key", F.col("v").cast("string").alias("value"),
        F.current_timestamp().alias("ts"))
    long.write.mode("append").parquet(f"{root.rstrip('/')}/runs")
    return f"{root.rstrip('/')}/runs"
