"""Join helpers that keep big joins balanced.

Broadcast policy: no operator hints ``broadcast()`` on a side whose size is
not bounded.  Dimension joins are left to the planner, which broadcasts a side
only under ``spark.sql.autoBroadcastJoinThreshold`` (static estimate) or
``spark.sql.adaptive.autoBroadcastJoinThreshold`` (measured at run time by
AQE) and otherwise plans a sort-merge join.  :func:`bounded_broadcast` is the
explicit form for the few places that need the hint: it counts at most
``max_rows + 1`` rows and hints only below the bound.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F



def bounded_broadcast(df: DataFrame, max_rows: int) -> DataFrame:
    """Hint ``df`` for broadcast only after checking it holds at most
    ``max_rows`` rows.

    The check reads at most ``max_rows + 1`` rows (the limit stops the scan).
    A larger input is returned unhinted, so the planner falls back to a
    shuffle-based join (sort-merge, or a partition-wise product for a cross
    join) instead of shipping it to every executor.
    """
    if df.limit(max_rows + 1).count() <= max_rows:
        return F.broadcast(df)
    return df


def left_join_spread_nulls(left: DataFrame, right: DataFrame, left_key: str,
                           right_key: str, salt_cols: list[str],
                           buckets: int | None = None) -> DataFrame:
    """``left LEFT JOIN right ON left.left_key = right.right_key``, spreading NULLs.

    A NULL key never matches, but a hash-partitioned join still sends every
    NULL-key row to one partition; anonymous orders can be a third of all
    rows.  A salt column, 0 for real keys and a content hash for NULL keys,
    joins with the right side's constant 0 salt: matches are unchanged and the
    NULL rows spread over ``buckets`` salts (default: four per shuffle
    partition, so hashing them reaches nearly every partition).  The salt hashes
    ``salt_cols`` (columns the plan reads anyway, so column pruning is kept),
    so a retried task puts every row in the same place again.  Both key
    columns are kept (the right one is NULL where nothing matched).
    """
    salt = "__null_salt"
    if buckets is None:
        buckets = 4 * int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    l_df = left.withColumn(salt, F.when(
        F.col(left_key).isNull(),
        F.pmod(F.xxhash64(*[F.col(c) for c in salt_cols]), F.lit(buckets)),
    ).otherwise(F.lit(0)).cast("long"))
    # The right salt is 0 for every row, but it must not be a constant the
    # optimizer can prove: it would fold "salt = 0" into a filter and drop
    # the salt from the join keys.  pmod(hash, 1) is always 0 yet opaque.
    r_df = right.withColumn(salt + "_r", F.pmod(F.xxhash64(F.col(right_key)), F.lit(1)))
    cond = (l_df[left_key] == r_df[right_key]) & (l_df[salt] == r_df[salt + "_r"])
    return l_df.join(r_df, cond, "left").drop(salt, salt + "_r")


def and_all(predicates: list[Column]) -> Column:
    """Conjunction of predicates; ``TRUE`` when there are none."""
    out = F.lit(True)
    for p in predicates:
        out = out & p
    return out
