"""Bulk load of all raw tables from staged CSV files.

:func:`bulk_load` reads ``<stage>/<table>`` (a folder of CSV files, searched
with its sub-folders) for each of the eight raw tables, writes typed parquet
below ``<target>/<table>/<load id>``, and publishes the load by its manifest,
written last: one row per table with its files, bytes, rows, buckets and path.
:func:`loaded_tables` scans the tables of the newest manifest, so a load that
did not finish is never read and a running reader keeps its files.

The two fact tables are dealt into buckets by ``order_id``, so many that a
bucket holds about ``BUCKET_BYTES`` of staged text: tasks grow with the input.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from menurec import schemas
from menurec.sources.csv import read_csv

FACTS = ("order_detail", "order_header")
FACT_KEY = "order_id"
BUCKET_BYTES = 256 << 20
MANIFEST = ("load_no long, load_id string, table_name string, files long, bytes long, rows long, "
            "buckets int, path string")


def staged(spark: SparkSession, path: str) -> tuple[int, int]:
    """Number and bytes of the data files below ``path``, as Spark's file system lists them."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files = size = 0
    if fs.exists(where):
        found = fs.listFiles(where, True)
        while found.hasNext():
            f = found.next()
            if not f.getPath().getName().startswith(("_", ".")):
                files, size = files + 1, size + f.getLen()
    return files, size


def manifests(spark: SparkSession, target: str) -> DataFrame:
    """Every published load of ``target``."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{target}/manifest")
    if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        return spark.createDataFrame([], MANIFEST)
    return spark.read.schema(MANIFEST).parquet(f"{target}/manifest")


def bulk_load(spark: SparkSession, stage: str, target: str, tables: dict | None = None,
              bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """Load every table of ``tables`` (name -> schema; default: the eight raw
    tables) and return the rows of the new manifest.  A missing folder is an
    error, as is a row that does not fit its table."""
    tables = schemas.RAW_TABLES if tables is None else tables
    load_id = uuid.uuid4().hex
    number = (manifests(spark, target).agg(F.max("load_no")).first()[0] or 0) + 1
    entries = []
    for name, schema in tables.items():
        files, size = staged(spark, f"{stage}/{name}")
        if not files:
            raise FileNotFoundError(f"no staged files for {name} below {stage}")
        path, buckets = f"{target}/{name}/{load_id}", 0
        rows = read_csv(spark, f"{stage}/{name}", schema, recursive=True, multiline=None)
        if name in FACTS:
            buckets = max(1, -(-size // bucket_bytes))
            rows = rows.repartition(buckets, FACT_KEY).sortWithinPartitions(FACT_KEY)
        rows.write.parquet(path)
        n = spark.read.schema(schema).parquet(path).count()   # from the footers
        entries.append((number, load_id, name, files, size, n, buckets, path))
    manifest = spark.createDataFrame(entries, MANIFEST).coalesce(1)
    manifest.write.mode("append").parquet(f"{target}/manifest")
    return manifests(spark, target).filter(F.col("load_id") == load_id)


def loaded_tables(spark: SparkSession, target: str, tables: dict | None = None) -> dict[str, DataFrame]:
    """Scans of the tables of the newest load."""
    tables = schemas.RAW_TABLES if tables is None else tables
    all_loads = manifests(spark, target)
    newest = all_loads.orderBy(F.desc("load_no"), "load_id").limit(1).select("load_id")
    paths = {r["table_name"]: r["path"] for r in all_loads.join(newest, "load_id").collect()}   # a row per table
    return {name: spark.read.schema(schema).parquet(paths[name]) for name, schema in tables.items()}
