"""Parquet scans of the input tables and schema conforming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_table(spark: SparkSession, base: str, name: str) -> DataFrame:
    """Scan ``<base>/<name>.parquet`` (a file or a folder of files).

    Column pruning and filter pushdown reach the scan because callers only
    select and filter afterwards.
    """
    return spark.read.parquet(f"{base.rstrip('/')}/{name}.parquet")


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Project ``df`` onto ``schema``: cast present columns, NULL-fill the rest."""
    present = {c.lower() for c in df.columns}
    cols = []
    for field in schema.fields:
        if field.name.lower() in present:
            cols.append(F.col(field.name).cast(field.dataType).alias(field.name))
        else:
            cols.append(F.lit(None).cast(field.dataType).alias(field.name))
    return df.select(*cols)
