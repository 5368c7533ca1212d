"""Global row numbers without a single-partition window.

:func:`numbered` range-partitions the rows by the order, sorts each range and
checkpoints it.  A row's number is the count of the rows in earlier ranges plus
its place in its own, so it depends on the order alone: not on the input's
partitions, the number of ranges, or the order in which tasks end.  Rows that
tie on the whole order should be equal where the numbers are used.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from menurec.session import checkpoint_dir

# monotonically_increasing_id() holds the partition above these bits and the
# row's place in its partition below them.
_PLACE_BITS = 33


def numbered(df: DataFrame, order: Sequence[Column | str], name: str = "pos",
             ranges: int | None = None) -> DataFrame:
    """Add ``name``: the 0-based number of every row in ``order``."""
    spark = df.sparkSession
    checkpoint_dir(spark)
    n = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    sorted_rows = (df.repartitionByRange(n, *order).sortWithinPartitions(*order)
                   .checkpoint(eager=True))
    mid = F.monotonically_increasing_id()
    placed = sorted_rows.select(
        "*", F.shiftright(mid, _PLACE_BITS).cast("int").alias("__range"),
        mid.bitwiseAND(F.lit((1 << _PLACE_BITS) - 1)).alias(name))
    sizes = placed.groupBy("__range").agg(F.count(F.lit(1)).alias("n")).collect()
    before, offsets = 0, []
    for r in sorted(sizes, key=lambda r: r["__range"]):   # one row per range
        offsets.append((r["__range"], before))
        before += r["n"]
    table = spark.createDataFrame(offsets, "__range int, __before long")
    # one row per range: a proven bound, so broadcast
    return (placed.join(F.broadcast(table), "__range")
            .withColumn(name, F.col(name) + F.col("__before")).drop("__range", "__before"))
