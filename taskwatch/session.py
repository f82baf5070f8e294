"""Session helpers: building a session for local runs and finding the shared
checkpoint folder.

On a cluster the checkpoint folder is whatever the cluster names in
``spark.checkpoint.dir`` (a shared file system path). Only when it is unset,
as in tests and local runs, do we create one under ``/tmp``.
"""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8,
                  app: str = "taskwatch") -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "16g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``taskwatch`` importable in Python workers (pandas UDFs unpickle
    its model classes there): zip the package once per application and add
    it with ``addPyFile``, which distributes it to every executor."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    import zipfile
    pkg = os.path.dirname(os.path.abspath(__file__))
    target = os.path.join(tempfile.mkdtemp(prefix="taskwatch-pkg-"), "taskwatch.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for root, _, files in os.walk(pkg):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(root, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(pkg)))
    sc.addPyFile(target)
    _SHIPPED.add(sc.applicationId)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the session's checkpoint folder, creating a local one only if unset."""
    ship_package(spark)
    sc = spark.sparkContext
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="taskwatch-ckpt-", dir="/tmp")
    sc.setCheckpointDir(configured)
    return sc._jsc.sc().getCheckpointDir().get()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared checkpoint folder for written tables."""
    base = ensure_checkpoint_dir(spark)
    return os.path.join(base, f"{name}-{uuid.uuid4().hex[:12]}")


_PIN_LOGS: list[list[str]] = []


class pinned_scope:
    """Collect the paths pinned inside a block, e.g. one stream micro-batch,
    so they can be dropped once the block's outputs are written."""

    def __enter__(self) -> list[str]:
        self.paths: list[str] = []
        _PIN_LOGS.append(self.paths)
        return self.paths

    def __exit__(self, *exc) -> None:
        _PIN_LOGS.remove(self.paths)


def drop_paths(spark: SparkSession, paths: list[str]) -> None:
    """Delete pinned tables through the Hadoop FileSystem of their location."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(conf).delete(path, True)


def pin(df: DataFrame, name: str = "pinned") -> DataFrame:
    """Cut lineage with a table written to the shared checkpoint folder.

    Used where a result is read twice and must be identical both times
    (for example after range partitioning) or where recomputation after a
    lost executor would be expensive. Written as Parquet and read back: the
    plan runs once (``Dataset.checkpoint`` on an unpersisted plan runs it
    twice), survives executor loss, and the reader gets real file sizes.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.mode("overwrite").parquet(path)
    for log in _PIN_LOGS:
        log.append(path)
    return spark.read.parquet(path)


def broadcast_model(model):
    """Broadcast a fitted model to the executors (the package is shipped first)."""
    spark = SparkSession.getActiveSession()
    ship_package(spark)
    return spark.sparkContext.broadcast(model)


def parts_for(spark: SparkSession, rows: int, rows_per_task: int = 20_000) -> int:
    """Partitions for an explicit repartition of ``rows`` measured rows: enough
    for every core, about ``rows_per_task`` rows each, at most the configured
    shuffle partitions (so a large input keeps the cluster's setting)."""
    shuffle = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cores = spark.sparkContext.defaultParallelism
    return max(1, min(shuffle, max(cores, -(-int(rows) // rows_per_task))))
