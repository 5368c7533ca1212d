"""Customer x item interaction table (the model's training spine)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from menurec.operators.features import BEVERAGE, menu_features
from menurec.plans.joins import bounded_broadcast

MAX_ITEMS = 100_000


def purchased_items(orders: DataFrame) -> DataFrame:
    """Per known customer and item: how many distinct trucks sold it to them.

    This is ``SELECT DISTINCT customer_id, menu_item_name, truck_id`` counted
    per (customer, item), a NULL truck counting as one value like DISTINCT
    does.  Spark plans the distinct count as a partial aggregate on
    (customer, item, truck), a shuffle on those keys, and a second shuffle of
    the de-duplicated rows on (customer, item): both carry aggregated rows, so
    a customer with a huge share of the order lines still sends at most one
    row per item and truck from each map task, spread over many partitions.
    """
    known = orders.filter(F.col("customer_id").isNotNull())
    return known.groupBy("customer_id", "menu_item_name").agg(
        (F.count_distinct("truck_id")
         + F.max(F.col("truck_id").isNull().cast("int"))).alias("n_trucks"))


def purchased_interactions(customers: DataFrame, menu: DataFrame, orders: DataFrame,
                           excluded_category: str | None = BEVERAGE) -> DataFrame:
    """The ``purchased = 1`` rows of :func:`interactions`, without building the
    customer x item product: the purchased pairs joined to the listed items and
    the loyalty customers, one row per selling truck."""
    items = menu_features(menu, excluded_category).select("menu_item_name")
    bought = purchased_items(orders).join(items, "menu_item_name").join(
        customers.select("customer_id"), "customer_id")
    return bought.select("customer_id", "menu_item_name", F.explode(
        F.array_repeat(F.lit(1), F.col("n_trucks").cast("int"))).alias("purchased"))


def interactions(customers: DataFrame, menu: DataFrame, orders: DataFrame,
                 excluded_category: str | None = BEVERAGE, dedupe: bool = False,
                 max_items: int = MAX_ITEMS) -> DataFrame:
    """Every loyalty customer x every non-excluded menu item, with
    ``purchased`` = 1 if the customer bought it, else 0.

    Faithful to the source view, an item bought from ``n`` different trucks
    yields ``n`` identical rows (the truck is part of its DISTINCT);
    ``dedupe=True`` gives one row per (customer, item) instead.

    Plan.  The output is the full customer x item product, so its size is
    fixed by the inputs; the work is arranged so that only customer-sized data
    is shuffled:

    1. ``purchased_items`` aggregates the orders to (customer, item) counts;
    2. those are folded into one map per customer (at most one entry per
       menu item, so bounded by the checked menu size) and left-joined to the
       customers on ``customer_id`` -- one shuffle of customer-sized rows,
       into ``spark.sql.shuffle.partitions`` partitions (not coalesced: the
       rows are about to grow by the menu size);
    3. the menu is broadcast when a count shows at most ``max_items`` rows
       (a larger menu falls back to a partition-wise product) and every
       customer row is expanded against it in the same task, looking up its
       count in the map.  No shuffle touches the expanded rows, and the
       output stays partitioned by ``customer_id`` for later joins, windows
       and aggregations on that key.
    """
    items = menu_features(menu, excluded_category).select("menu_item_name")
    items = bounded_broadcast(items, max_items)

    # A NULL item name never equals a menu item, so it cannot mark a purchase.
    bought = purchased_items(orders).filter(
        F.col("menu_item_name").isNotNull()).groupBy("customer_id").agg(
        F.map_from_entries(F.collect_list(
            F.struct("menu_item_name", "n_trucks"))).alias("bought"))
    # The expansion multiplies every customer row by the menu size, so the
    # customer-level partitioning must not be coalesced by its (small)
    # pre-expansion size: an explicit partition count is kept as is by AQE.
    n_parts = int(customers.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spine = customers.select("customer_id").repartition(n_parts, "customer_id").join(
        bought, "customer_id", "left")

    expanded = spine.crossJoin(items)
    n = F.coalesce(F.try_element_at(F.col("bought"), F.col("menu_item_name")),
                   F.lit(0)).cast("int")
    flag = F.when(n > 0, F.lit(1)).otherwise(F.lit(0))
    if dedupe:
        return expanded.select("customer_id", "menu_item_name", flag.alias("purchased"))
    return expanded.select(
        "customer_id", "menu_item_name",
        F.explode(F.array_repeat(flag, F.greatest(n, F.lit(1)))).alias("purchased"))
