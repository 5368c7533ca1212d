"""Incremental load: copy only the CSV files not loaded before.

The source's bulk copy keeps a load history and skips files it already loaded.
Here a stream of the staged text finds new files and :func:`load_csv_incremental`
handles each batch of them:

1. one pass over the batch's lines gives each file's size and checksum (an
   order-free hash of its lines) and whether it holds quoted line breaks;
2. files whose name, size and checksum the ledger already has are dropped (an
   empty file has no lines and is never met);
3. the remaining files are read as CSV and written below
   ``<target>/rows/load=<id>``;
4. the batch commits by one file added to ``<target>/ledger``.

Readers (:func:`loaded_rows`) take only the loads that the ledger names, so rows
and ledger appear together, and what a failed batch wrote is never read.  A
batch that is replayed, or a new stream over the same folder (its checkpoint
lost), finds its files in the ledger and adds nothing.  A file whose content
changed counts as new, as in the source's history.  One writer at a time per
target.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from menurec.sources.csv import FILE_PATH, FILE_SIZE, has_line_break, read_csv_files

LEDGER = ("file string, size long, checksum string, lines long, load string, load_no long, "
          "load_rows long")
FILES_PER_BATCH = 1000


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def ledger(spark: SparkSession, target: str) -> DataFrame:
    """One row per loaded file."""
    if not _exists(spark, f"{target}/ledger"):
        return spark.createDataFrame([], LEDGER)
    return spark.read.schema(LEDGER).parquet(f"{target}/ledger")


def described(lines: DataFrame) -> DataFrame:
    """file, size, checksum, lines, broken (holds a quoted line break) of the
    files whose lines (path, size, value) are given."""
    h = F.xxhash64("value")
    return (lines.groupBy(F.col("path").alias("file"), "size")
            .agg(F.count(F.lit(1)).alias("lines"), F.bit_xor(h).alias("x"),
                 F.sum(h.cast("decimal(20,0)")).alias("s"), has_line_break().alias("broken"))
            .select("file", "size", F.concat_ws("-", F.hex("x"), F.col("s").cast("string"), "lines").alias("checksum"),
                    "lines", "broken"))


def load_batch(lines: DataFrame, schema: T.StructType, target: str) -> None:
    """Load the files of one batch of staged lines that are not in the ledger."""
    spark = lines.sparkSession
    known = ledger(spark, target)
    # a row per new file of the batch, which FILES_PER_BATCH bounds
    new = described(lines).join(known, ["file", "size", "checksum"], "left_anti").collect()
    if not new:
        return
    load = uuid.uuid4().hex
    path = f"{target}/rows/load={load}"
    read_csv_files(spark, sorted(r["file"] for r in new if not r["broken"]),
                   sorted(r["file"] for r in new if r["broken"]), schema).write.parquet(path)
    rows = spark.read.schema(schema).parquet(path).count()
    number = (known.agg(F.max("load_no")).first()[0] or 0) + 1
    entries = [(r["file"], r["size"], r["checksum"], r["lines"], load, number, rows) for r in new]
    spark.createDataFrame(entries, LEDGER).coalesce(1).write.mode("append").parquet(f"{target}/ledger")


def loaded_rows(spark: SparkSession, target: str, schema: T.StructType) -> DataFrame:
    """The rows of all committed loads, with their ``load``."""
    with_load = T.StructType([*schema.fields, T.StructField("load", T.StringType())])
    if not _exists(spark, f"{target}/rows"):
        return spark.createDataFrame([], with_load)
    committed = ledger(spark, target).select("load").distinct()
    rows = spark.read.schema(with_load).parquet(f"{target}/rows")
    return rows.join(committed, "load", "left_semi")


def load_csv_incremental(spark: SparkSession, source: str, schema: T.StructType,
                         target: str, checkpoint: str, wait: bool = True,
                         max_files_per_trigger: int = FILES_PER_BATCH) -> StreamingQuery:
    """Load the CSV files under ``source`` that ``target`` has not loaded yet,
    then stop.  ``checkpoint`` and ``target`` must be on shared storage."""
    lines = (spark.readStream.schema("value string").format("text")
             .option("recursiveFileLookup", "true")
             .option("maxFilesPerTrigger", str(max_files_per_trigger)).load(source)
             .select(F.col(FILE_PATH).alias("path"), F.col(FILE_SIZE).alias("size"), "value"))
    query = (lines.writeStream.option("checkpointLocation", checkpoint)
             .trigger(availableNow=True)
             .foreachBatch(lambda batch, _: load_batch(batch, schema, target))
             .start())
    if wait:
        query.awaitTermination()
    return query
