"""Exact running totals without a single-partition window.

``sum(x) OVER (ORDER BY k)`` without ``PARTITION BY`` moves every row into
one task.  :func:`prefix_sums` computes the same totals in parallel:

1. range-partition the rows by (group, key) into ``buckets`` ranges and tag
   each row with its range number; the tagged rows are checkpointed so every
   later read sees the same tags (also after a lost executor);
2. a window per (range, group) gives the running total inside a range;
3. the per-(range, group) totals -- at most ``buckets + groups`` rows -- get
   their own running total (the offset of each range) and are broadcast back.

The input (typically an aggregate: distinct scores, a vocabulary) is
checkpointed once, so the lineage behind it runs a single time.  The plan is
the same at every size.

Rows must be unique on (group, key); sums are exact for integral and decimal
values.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from menurec.session import checkpoint_dir

_BUCKET = "__range"


def prefix_sums(df: DataFrame, key: str, values: Sequence[str],
                groups: Sequence[str] = (), buckets: int | None = None,
                materialize: bool = True) -> DataFrame:
    """Add ``<v>_before``: the sum of ``v`` over rows of the same group with a
    smaller ``key``, for each ``v`` in ``values``.

    ``materialize=False`` skips the input checkpoint, for an input that is
    already a cheap read (e.g. a filter over a checkpointed table).
    """
    spark = df.sparkSession
    checkpoint_dir(spark)
    groups = list(groups)
    if materialize:
        df = df.checkpoint(eager=True)
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = (df.repartitionByRange(n, *[F.col(g) for g in groups], F.col(key))
              .withColumn(_BUCKET, F.spark_partition_id())
              .checkpoint(eager=True))

    part = [_BUCKET] + groups
    running = Window.partitionBy(*part).orderBy(key).rowsBetween(
        Window.unboundedPreceding, -1)
    local = ranged.select("*", *[
        F.coalesce(F.sum(v).over(running), F.lit(0)).alias(f"__local_{v}")
        for v in values])

    totals = ranged.groupBy(*part).agg(*[F.sum(v).alias(f"__total_{v}") for v in values])
    earlier = Window.partitionBy(*groups).orderBy(_BUCKET).rowsBetween(
        Window.unboundedPreceding, -1)
    offsets = totals.select(*part, *[
        F.coalesce(F.sum(f"__total_{v}").over(earlier), F.lit(0)).alias(f"__offset_{v}")
        for v in values])
    # At most buckets + groups rows: a proven bound, so broadcast.
    out = local.join(F.broadcast(offsets), part)
    return out.select(*df.columns, *[
        (F.col(f"__offset_{v}") + F.col(f"__local_{v}")).alias(f"{v}_before")
        for v in values])
