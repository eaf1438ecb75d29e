"""Spark session and lineage helpers.

The library never creates its own cluster settings on a real cluster: the
session is taken as given, and only the knobs a local test run lacks are set.
"""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession

# Settings the engine relies on. AQE turns sort-merge joins into broadcast
# joins only after a shuffle stage has measured the real size of a side, so
# no broadcast is ever decided on a guess.
ENGINE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "panelcast") -> SparkSession:
    """Return the active session, or build a local one (tests, bench)."""
    active = SparkSession.getActiveSession()
    if active is not None:
        configure(active)
        return active
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    if master and master.startswith("local"):
        # local runs (tests, bench) own the driver JVM; on a cluster these
        # come from the submit configuration and are left alone
        builder = (builder
                   # many distinct generated query classes in one long-lived
                   # driver: a larger JIT code cache keeps later queries compiled
                   .config("spark.driver.extraJavaOptions",
                           os.environ.get("PANELCAST_DRIVER_JAVA_OPTIONS",
                                          "-XX:ReservedCodeCacheSize=1g"))
                   .config("spark.driver.memory",
                           os.environ.get("PANELCAST_DRIVER_MEMORY", "16g")))
    builder = (builder
               .config("spark.ui.enabled", "false")
               .config("spark.ui.showConsoleProgress", "false"))
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in ENGINE_CONF.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    configure(spark)
    return spark


def configure(spark: SparkSession) -> None:
    """Apply engine settings that are safe to change at runtime."""
    for key, value in ENGINE_CONF.items():
        try:
            spark.conf.set(key, value)
        except Exception:  # static conf on a shared session: leave it
            pass
    ensure_checkpoint_dir(spark)
    ship_package(spark)


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``panelcast`` importable in Python workers (pandas UDFs).

    The package is zipped once per application and added with ``addPyFile``,
    the same way ``--py-files`` distributes it to every executor.
    """
    sc = spark.sparkContext
    app = sc.applicationId
    if app in _SHIPPED:
        return
    pkg_dir = os.path.dirname(os.path.abspath(__file__))
    out_dir = tempfile.mkdtemp(prefix="panelcast-pyfiles-")
    archive = shutil.make_archive(os.path.join(out_dir, "panelcast"), "zip",
                                  root_dir=os.path.dirname(pkg_dir),
                                  base_dir=os.path.basename(pkg_dir))
    sc.addPyFile(archive)
    _SHIPPED.add(app)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Use the cluster's shared ``spark.checkpoint.dir``; set one only if unset.

    On a cluster the setting names a shared, fault-tolerant folder, and there is
    an error without it. Only a local master gets a folder of its own (tests);
    it is removed when the process ends.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="panelcast-ckpt-")
        atexit.register(shutil.rmtree, configured, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", configured)
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def cut_lineage(df: DataFrame, eager: bool = True) -> DataFrame:
    """Materialise ``df`` into the shared checkpoint folder.

    Reliable checkpoints survive executor loss (unlike local checkpoints),
    and reused intermediates are not recomputed from the raw scans.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=eager)
