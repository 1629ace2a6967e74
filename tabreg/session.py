"""Session helpers: one place that builds a SparkSession and resolves the shared folder.

On a cluster the shared folder is whatever ``spark.checkpoint.dir`` names; we never invent a
machine-local one there. Only a ``local[...]`` master (tests, the bench) may fall back to a fresh
temporary folder, and only when the setting is absent.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession


def get_spark(master: str | None = None, app: str = "tabreg", shuffle_partitions: int | None = None,
              driver_memory: str = "16g", extra: dict | None = None) -> SparkSession:
    """Build (or reuse) a session with the settings every job here assumes."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    conf = {
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.driver.memory": driver_memory,
    }
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def _is_local(spark: SparkSession) -> bool:
    return spark.sparkContext.master.startswith("local")


def shared_dir(spark: SparkSession, *parts: str) -> str:
    """Folder for written tables and checkpoints, under the session's ``spark.checkpoint.dir``.

    If the setting is unset and the master is local, a fresh temporary folder is made and
    registered as the checkpoint folder; on a cluster an unset setting is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        sc = spark.sparkContext
        base = sc.getConf().get("spark.checkpoint.dir", None)
    if not base:
        if not _is_local(spark):
            raise RuntimeError("spark.checkpoint.dir is not set; point it at a shared folder")
        base = tempfile.mkdtemp(prefix="tabreg-")
        spark.conf.set("spark.checkpoint.dir", base)
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(os.path.join(base, "rdd-checkpoints"))
    path = os.path.join(base, "tabreg", *parts) if parts else os.path.join(base, "tabreg")
    return path


def fresh_dir(spark: SparkSession, name: str) -> str:
    """A new, unique folder under the shared folder (one per run, never reused)."""
    return shared_dir(spark, f"{name}-{uuid.uuid4().hex[:12]}")


def delete_dir(spark: SparkSession, path: str) -> None:
    """Remove a folder that ``fresh_dir`` named, through the file system it lies on."""
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)

