"""SQL-text source: parameterised ``spark.sql`` over named DataFrames.

A text names its DataFrames in braces (``FROM {orders}``): they are passed as
arguments of the statement, so no view of the session is made or replaced.
Values are named parameters (``:name``), never pasted into the text; a list
parameter is an array (use ``array_contains(:values, col)``).
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession


def run_sql(spark: SparkSession, text: str, frames: Mapping[str, DataFrame] | None = None,
            args: Mapping[str, object] | None = None) -> DataFrame:
    """Run ``text`` over ``frames`` with ``args``."""
    return spark.sql(text, args=dict(args or {}), **dict(frames or {}))
