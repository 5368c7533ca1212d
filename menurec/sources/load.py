"""Bulk load: typed point-of-sale tables, written once and scanned by queries.

The source loads its eight raw tables once (``COPY INTO`` typed tables) and
then runs every view and feature query over them.  :func:`load_domain` does
the same for the driver's tables: it maps them to the domain schema
(:mod:`menurec.sources.adapter`) and writes each table as parquet under a
shared folder -- ``<target>`` if given, else ``<spark.checkpoint.dir>/domain``
-- keyed by a fingerprint of the input files and of the loading code.  Later calls (in this session
or another one sharing the folder) only scan the written tables, with their
schemas given explicitly so no footer-reading job runs.

The two fact tables are stored bucketed (and sorted) by ``order_id``, the
key of the join between order lines and headers that every view starts
with: Spark then joins them bucket by bucket with no shuffle.  They are
registered as external bucketed tables in the session catalog (re-attached
from the written files in a new session).

A load is written to a fresh sub-folder and published by a ``complete``
marker written last, so a half-finished load is never read.
"""

from __future__ import annotations

import hashlib
import os
import uuid

from pyspark.sql import SparkSession
from pyspark.sql.utils import AnalysisException

from menurec import schemas
from menurec.session import checkpoint_dir
from menurec.sources.adapter import DomainTables, adapt
from menurec.sources.bulk_load import staged

DRIVER_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")
BUCKETED = ("order_detail", "order_header")    # bucketed by BUCKET_KEY
BUCKET_KEY = "order_id"
BUCKET_BYTES = 128 << 20    # of compressed input, a few times that in memory
_LOADED: dict[tuple[str, str], tuple[str, int]] = {}


def _code_version() -> bytes:
    """Source of the modules that define the loaded tables, so a changed
    mapping or schema never reuses an older load."""
    from menurec import schemas as _schemas
    from menurec.sources import adapter as _adapter
    h = hashlib.sha1()
    for mod in (_schemas, _adapter):
        with open(mod.__file__, "rb") as f:
            h.update(f.read())
    h.update(f"{BUCKETED}{BUCKET_KEY}".encode())
    return h.digest()


def _fingerprint(spark: SparkSession, base: str) -> str:
    """Path, size and time of every input file as Spark's file system lists
    them (local or remote), and the version of the loading code."""
    h = hashlib.sha1(os.path.abspath(base).encode() if "://" not in base else base.encode())
    h.update(_code_version())
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for t in DRIVER_TABLES:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{base}/{t}.parquet")
        fs = path.getFileSystem(conf)
        if not fs.exists(path):
            continue
        files, seen = fs.listFiles(path, True), []
        while files.hasNext():
            f = files.next()
            seen.append(f"{f.getPath()}:{f.getLen()}:{f.getModificationTime()}")
        h.update("\n".join(sorted(seen)).encode())
    return h.hexdigest()[:16]


def _tables_root(spark: SparkSession) -> str:
    """A folder that outlives the application: below the configured shared
    folder, not the per-application folder Spark makes in it."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or checkpoint_dir(spark)
    return f"{shared.rstrip('/')}/menurec-domain"


def _published(spark: SparkSession, root: str) -> tuple[str, int] | None:
    try:
        rows = spark.read.schema("path string, buckets int").parquet(f"{root}/complete").collect()
    except AnalysisException:
        return None
    if not rows or rows[0]["buckets"] is None:
        return None
    return rows[0]["path"], rows[0]["buckets"]


def _table_name(path: str, name: str) -> str:
    return f"menurec_{hashlib.sha1(path.encode()).hexdigest()[:12]}_{name}"


def _attach(spark: SparkSession, path: str, name: str, buckets: int) -> str:
    """Register the bucketed files at ``path/name`` as an external table."""
    table = _table_name(path, name)
    if not spark.catalog.tableExists(table):
        cols = ", ".join(f"`{f.name}` {f.dataType.simpleString()}"
                         for f in schemas.RAW_TABLES[name].fields)
        spark.sql(f"CREATE TABLE IF NOT EXISTS {table} ({cols}) USING parquet "
                  f"CLUSTERED BY ({BUCKET_KEY}) SORTED BY ({BUCKET_KEY}) "
                  f"INTO {buckets} BUCKETS LOCATION '{path}/{name}'")
    return table


def load_domain(spark: SparkSession, base: str, target: str | None = None,
                buckets: int | None = None) -> DomainTables:
    """Typed domain tables for the driver tables under ``base``.

    ``buckets`` sets the bucket count of the fact tables; by default one per
    ``BUCKET_BYTES`` of their input files, but not fewer than
    ``spark.sql.shuffle.partitions``.  A published load keeps the count it was
    written with.
    """
    root = (target or _tables_root(spark)).rstrip("/") + "/" + _fingerprint(spark, base)
    key = (spark.sparkContext.applicationId, root)
    found = _LOADED.get(key) or _published(spark, root)
    if found is None:
        path = f"{root}/{uuid.uuid4().hex}"
        size = sum(staged(spark, f"{base}/{t}.parquet")[1] for t in ("orders", "lineitem"))
        n = buckets or max(-(-size // BUCKET_BYTES), int(spark.conf.get("spark.sql.shuffle.partitions")))
        tables = adapt(spark, base)
        for name in schemas.RAW_TABLES:
            df = getattr(tables, name)
            if name in BUCKETED:
                # Hash-partition into the bucket count first: Spark's bucket of
                # a row equals its hash partition, so each task writes exactly
                # one bucket file instead of tasks x buckets small files.
                df.repartition(n, BUCKET_KEY).write.mode("overwrite") \
                    .bucketBy(n, BUCKET_KEY).sortBy(BUCKET_KEY) \
                    .option("path", f"{path}/{name}").saveAsTable(_table_name(path, name))
            else:
                df.write.mode("overwrite").parquet(f"{path}/{name}")
        spark.createDataFrame([(path, n)], "path string, buckets int").coalesce(1).write.mode(
            "overwrite").parquet(f"{root}/complete")
        found = (path, n)
    _LOADED[key] = found
    path, n = found
    out = {}
    for name in schemas.RAW_TABLES:
        if name in BUCKETED:
            out[name] = spark.table(_attach(spark, path, name, n))
        else:
            out[name] = spark.read.schema(schemas.RAW_TABLES[name]).parquet(f"{path}/{name}")
    return DomainTables(**out)
