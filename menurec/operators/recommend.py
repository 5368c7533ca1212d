"""Top-k items per customer and the recommendation report."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def top_k(scored: DataFrame, k: int = 3, score: str = "prediction",
          by: str = "customer_id") -> DataFrame:
    """Rows ranked ``<= k`` by ``score`` (descending, NULLs first as in the
    source warehouse) within ``by``; ``rank`` keeps ties, so a customer can
    get more than ``k`` rows.

    Catalyst plans the rank filter as a ``WindowGroupLimit``: each task keeps
    only the top rows of every customer before the shuffle, so the shuffle
    and the window see at most about ``k`` rows per customer and task.
    """
    w = Window.partitionBy(by).orderBy(F.col(score).desc_nulls_first())
    return scored.withColumn("rank", F.rank().over(w)).filter(F.col("rank") <= k)


def purchase_history(interactions: DataFrame, customers: DataFrame | None = None) -> DataFrame:
    """Sorted list of purchased items per customer (duplicates kept).

    ``customers`` restricts the result with a semi join (the source pastes
    the ids into an IN list).  The list is bounded by the number of menu
    items times the trucks selling each.
    """
    bought = interactions.filter(F.col("purchased") == 1)
    if customers is not None:
        bought = bought.join(customers.select("customer_id"), "customer_id", "left_semi")
    return bought.groupBy("customer_id").agg(
        F.array_sort(F.collect_list("menu_item_name")).alias("purchase_history"))


def recommendations(scored: DataFrame, interactions: DataFrame, k: int = 3,
                    score: str = "prediction") -> DataFrame:
    """Per customer: city, purchase history and the top-k items.

    ``scored`` carries ``customer_id, city, menu_item_name`` and the score.
    The item list is ordered by rank, then name; a customer without
    purchases gets an empty history, not NULL.  Only the purchased rows of
    ``interactions`` are used, so ``interactions.purchased_interactions`` (no
    customer x item product) gives the same report as the whole table; the
    left join from the ranked customers drops every other history.
    """
    top = top_k(scored, k, score)
    grouped = top.groupBy("customer_id").agg(
        F.min("city").alias("city"),
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "menu_item_name"))),
                    lambda s: s["menu_item_name"]).alias("menu_item_name"))
    history = purchase_history(interactions)
    empty = F.array().cast("array<string>")
    return grouped.join(history, "customer_id", "left").select(
        "customer_id", "city",
        F.coalesce(F.col("purchase_history"), empty).alias("purchase_history"),
        "menu_item_name")
