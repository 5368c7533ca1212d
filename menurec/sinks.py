"""Sinks: saved tables, recommendation output and the model metric log.

A saved table is a folder of snapshots and a manifest.  A save writes a new
snapshot and publishes it by one manifest row, written last; readers scan the
snapshot of the newest row, so they never see a half-written table, keep their
files while a new one is written, and a save that failed left nothing to read.
A save that names its run publishes once: repeating it (a retried job) changes
nothing.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

METRIC_SCHEMA = ("run_id string, model_name string, version string, metric string, value double, "
                 "logged_at double")
MANIFEST = "save_no long, run_id string, folder string, rows long, schema string"


def _read_if_there(spark: SparkSession, path: str, schema: str) -> DataFrame:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)


def saves(spark: SparkSession, path: str) -> DataFrame:
    """The published saves of the table at ``path``, one row each."""
    return _read_if_there(spark, f"{path}/manifest", MANIFEST)


def save_table(df: DataFrame, path: str, partition_by: Sequence[str] = (),
               run_id: str | None = None) -> DataFrame:
    """Create-table-as-select, overwriting: publish ``df`` as the newest
    snapshot of the table at ``path`` and return a scan of it.  With a
    ``run_id`` that has already published, nothing is written."""
    spark = df.sparkSession
    known = saves(spark, path).agg(F.max("save_no").alias("last"), F.max(
        F.col("run_id") == F.lit(run_id)).alias("done")).first()
    if known["done"]:
        return read_table(spark, path)
    folder = f"data-{uuid.uuid4().hex}"
    writer = df.write.partitionBy(*partition_by) if partition_by else df.write
    writer.parquet(f"{path}/{folder}")
    rows = spark.read.schema(df.schema).parquet(f"{path}/{folder}").count()   # from the footers
    entry = ((known["last"] or 0) + 1, run_id, folder, rows, df.schema.json())
    spark.createDataFrame([entry], MANIFEST).coalesce(1).write.mode("append").parquet(f"{path}/manifest")
    return read_table(spark, path)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A scan of the newest published snapshot, columns as they were saved."""
    newest = saves(spark, path).orderBy(F.desc("save_no"), "folder").first()
    if newest is None:
        raise FileNotFoundError(f"no table was saved at {path}")
    schema = T.StructType.fromJson(json.loads(newest["schema"]))
    return spark.read.schema(schema).parquet(f"{path}/{newest['folder']}").select(*schema.names)


def vacuum_table(spark: SparkSession, path: str) -> int:
    """Remove the snapshots that no reader of the newest save needs (older and
    unpublished ones) and return how many; call it when no save is running."""
    newest = saves(spark, path).orderBy(F.desc("save_no"), "folder").first()
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    old = [f.getPath() for f in (fs.listStatus(where) if fs.exists(where) else [])
           if f.getPath().getName().startswith("data-") and (newest is None or f.getPath().getName() != newest["folder"])]
    for folder in old:
        fs.delete(folder, True)
    return len(old)


def save_as_table(df: DataFrame, name: str, mode: str = "overwrite") -> DataFrame:
    """Same through the session catalog (``saveAsTable``)."""
    df.write.mode(mode).saveAsTable(name)
    return df.sparkSession.table(name)


def write_recommendations(recs: DataFrame, path: str, run_id: str | None = None) -> DataFrame:
    """Overwrite the recommendation table; list columns stay arrays."""
    return save_table(recs, path, run_id=run_id)


def log_metrics(spark: SparkSession, path: str, model_name: str, version: str,
                metrics: Mapping[str, float], digits: int = 4, run_id: str | None = None) -> DataFrame:
    """Append one row per metric (rounded to ``digits``) to the metric log and
    return the log.  A metric that ``run_id`` has logged for this model version
    is not logged again; without one the call is a run of its own."""
    run_id, now = run_id or uuid.uuid4().hex, time.time()
    of_run = ((F.col("run_id") == run_id) & (F.col("model_name") == model_name) & (F.col("version") == version))
    logged = {r["metric"] for r in _read_if_there(spark, path, METRIC_SCHEMA).filter(of_run).select("metric").collect()}
    rows = [(run_id, model_name, version, k, None if v is None else round(float(v), digits), now)
            for k, v in metrics.items() if k not in logged]
    if rows:
        spark.createDataFrame(rows, METRIC_SCHEMA).coalesce(1).write.mode("append").parquet(path)
    return _read_if_there(spark, path, METRIC_SCHEMA)
