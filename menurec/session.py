"""Spark session defaults and the shared checkpoint folder.

The library never builds its own session inside an operator; callers (tests,
bench, the entry module) use :func:`build_session`.  On a cluster the session
comes from the platform and only :func:`checkpoint_dir` is used.
"""

from __future__ import annotations

import os
import tempfile
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

# Settings every run wants.  AQE re-plans joins from real shuffle sizes
# (broadcast only below the size threshold, skew splitting for hot keys) and
# coalesces tiny shuffle partitions.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
    # Size-checked broadcast: the planner broadcasts a join side only when its
    # estimated (static) or measured (AQE) size is below these limits and
    # falls back to a sort-merge join otherwise.
    "spark.sql.autoBroadcastJoinThreshold": "32m",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "32m",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "4096",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(master: str | None = None, app: str = "menurec",
                  shuffle_partitions: int | None = None,
                  extra: dict | None = None) -> SparkSession:
    """Build (or reuse) a session with the library defaults."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in the Python workers of the session.

    Jobs that run numpy code in tasks refer to the package by name, so it has
    to be on the executors too.  It is sent once per context as a zip file;
    a package installed on the executors is the alternative (pyproject.toml).
    """
    sc = spark.sparkContext
    if getattr(sc, "_menurec_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    target = os.path.join(tempfile.mkdtemp(prefix="menurec-pkg-"), "menurec.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as out:
        for folder, _, names in os.walk(root):
            for name in sorted(n for n in names if n.endswith(".py")):
                path = os.path.join(folder, name)
                out.write(path, os.path.join("menurec", os.path.relpath(path, root)))
    sc.addPyFile(target)
    sc._menurec_shipped = True


@contextmanager
def open_files(spark: SparkSession, n: int) -> Iterator[None]:
    """Let a partitioned write keep up to ``n`` files open in a task, so that it
    does not sort its rows by folder first (Spark does from the ``n + 1``-th on)."""
    name = "spark.sql.maxConcurrentOutputFileWriters"
    before = spark.conf.get(name, None)
    spark.conf.set(name, str(n))
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder, setting it up if needed.

    The cluster names it in ``spark.checkpoint.dir``; that value always wins.
    Only a local-mode session (tests, bench) without the setting gets a fresh
    folder under /tmp.  A cluster session without it is an error: a
    machine-local folder would lose checkpoints with the executor.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
        return sc.getCheckpointDir()
    if sc.master.startswith("local"):
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="menurec-ckpt-", dir="/tmp"))
        return sc.getCheckpointDir()
    raise RuntimeError(
        "spark.checkpoint.dir is not set; name a shared folder for checkpoints")
