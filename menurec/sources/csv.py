"""CSV bulk load into typed tables.

The source's file format: comma separated, one header line skipped, fields
optionally enclosed in double quotes (a doubled quote inside is a quote),
and the texts ``NULL``, ``null`` and the empty string read as NULL.  Columns
are matched by position.  Spark's ``nullValue`` takes a single string, so
every column is read as text, the three markers become NULL, and the
columns are cast to the declared types.  Under ANSI casting, a value that
does not fit its type fails the load (the source aborts on the first bad
row); malformed lines, including a line with more or fewer fields than
the table has columns, fail too (``FAILFAST``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed format values of the source file format.
NULL_MARKERS = ("NULL", "null", "")
READER_OPTIONS = {
    "header": "true",
    "quote": '"',
    "escape": '"',
    "mode": "FAILFAST",
    "enforceSchema": "true",
}


def text_schema(schema: T.StructType) -> T.StructType:
    return T.StructType([T.StructField(f.name, T.StringType(), True) for f in schema.fields])


def to_typed(raw: DataFrame, schema: T.StructType) -> DataFrame:
    """NULL markers to NULL, then cast every column to its declared type."""
    cols = []
    for f in schema.fields:
        c = F.col(f.name)
        c = F.when(c.isin(*NULL_MARKERS), F.lit(None)).otherwise(c)
        if not isinstance(f.dataType, T.StringType):
            c = c.cast(f.dataType)
        cols.append(c.alias(f.name))
    return raw.select(*cols)


# Fixed names of the file columns Spark adds to a scan.
FILE_PATH, FILE_SIZE = "_metadata.file_path", "_metadata.file_size"


def has_line_break() -> Column:
    """Whether a file's lines (``value``, aggregated) hold a quoted line break: a
    quoted field that is not closed on its line leaves an odd number of quotes
    (a doubled quote counts twice)."""
    return F.max(F.regexp_count(F.col("value"), F.lit('"')) % 2) == 1


def _reader(spark: SparkSession, schema: T.StructType, recursive: bool, multiline: bool):
    reader = spark.read.schema(text_schema(schema)).options(**READER_OPTIONS)
    if recursive:
        reader = reader.option("recursiveFileLookup", "true")
    return reader.option("multiLine", "true") if multiline else reader


def read_csv_files(spark: SparkSession, plain: list[str], broken: list[str],
                   schema: T.StructType) -> DataFrame:
    """The typed rows of files without (``plain``) and with quoted line breaks."""
    parts = [_reader(spark, schema, False, multi).csv(paths)
             for paths, multi in ((plain, False), (broken, True)) if paths]
    if not parts:
        return to_typed(spark.createDataFrame([], text_schema(schema)), schema)
    return to_typed(parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1]), schema)


def read_csv(spark: SparkSession, path: str, schema: T.StructType,
             recursive: bool = False, multiline: bool | None = False) -> DataFrame:
    """Read every CSV file under ``path`` (a file, folder or glob).

    Quoted line breaks need ``multiline``, but a file read that way is one
    task's work however large it is.  ``None`` looks first (one more scan of
    the text): only the files that hold a quoted line break are read so, all
    others are split as usual.
    """
    if multiline is not None:
        return to_typed(_reader(spark, schema, recursive, multiline).csv(path), schema)
    text = spark.read.option("recursiveFileLookup", str(recursive).lower()).text(path)
    # one row per file
    files = {r["path"]: r["broken"] for r in text.groupBy(F.col(FILE_PATH).alias("path"))
             .agg(has_line_break().alias("broken")).collect()}
    if not any(files.values()):
        return to_typed(_reader(spark, schema, recursive, False).csv(path), schema)
    return read_csv_files(spark, sorted(f for f, b in files.items() if not b),
                          sorted(f for f, b in files.items() if b), schema)


def load_csv_table(spark: SparkSession, path: str, schema: T.StructType, target: str,
                   mode: str = "overwrite", recursive: bool = False,
                   multiline: bool | None = False) -> DataFrame:
    """Bulk load: read the CSV files under ``path`` and write them as a typed
    parquet table at ``target``; returns a scan of the table."""
    read_csv(spark, path, schema, recursive, multiline).write.mode(mode).parquet(target)
    return spark.read.schema(schema).parquet(target)
