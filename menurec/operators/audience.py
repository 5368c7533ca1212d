"""Audience selection: never-visited brands, filtered audiences, filter lists."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from menurec.functions.prefix import prefix_sums
from menurec.plans.joins import and_all, bounded_broadcast

MAX_ITEMS = 100_000
# The item columns of the source's feature table.
ITEM_COLUMNS = ["menu_type", "truck_brand_name", "menu_item_name", "item_category",
                "item_subcategory", "sale_price_usd"]


def never_visited(interactions: DataFrame, items: DataFrame,
                  max_items: int = MAX_ITEMS) -> DataFrame:
    """The (customer, brand) pairs of an interaction table without a purchase,
    with every ``purchased`` value they have, times the brand's items.

    One grouping on (customer, brand) gathers the pair's values; a pair stays
    unless one of them is 1.  A NULL customer equals nobody, so no purchase
    hides its pairs.  For the interactions of loyalty customers
    :func:`unvisited` gives the same rows without the interaction table.
    """
    listed = bounded_broadcast(items.select(*ITEM_COLUMNS), max_items)
    brand_of = listed.select("menu_item_name", "truck_brand_name")
    pairs = interactions.join(brand_of, "menu_item_name").groupBy("customer_id", "truck_brand_name").agg(
        F.collect_set(F.struct("purchased")).alias("seen"))
    bought = F.coalesce(F.exists("seen", lambda s: s["purchased"] == 1), F.lit(False))
    kept = pairs.filter(F.col("customer_id").isNull() | ~bought)
    return _with_items(kept.select("customer_id", "truck_brand_name", F.inline("seen")), listed)


def unvisited(customers: DataFrame, orders: DataFrame, items: DataFrame,
              max_items: int = MAX_ITEMS) -> DataFrame:
    """Every loyalty customer's brands without a purchase of one of their items,
    times the brand's items: :func:`never_visited` of the full interaction
    table, from the orders alone.

    A customer's visited brands are a set, and the others are its complement in
    the set of all brands (one value for the whole plan), so nothing is
    expanded by items before the pairs are known, and the only shuffles carry
    distinct (customer, item) pairs and one row per customer.
    """
    listed = bounded_broadcast(items.select(*ITEM_COLUMNS), max_items)
    brand_of = listed.select("menu_item_name", "truck_brand_name")
    visited = (orders.filter(F.col("customer_id").isNotNull())
               .select("customer_id", "menu_item_name").distinct().join(brand_of, "menu_item_name")
               .groupBy("customer_id").agg(F.collect_set("truck_brand_name").alias("visited")))
    brands = items.agg(F.collect_set("truck_brand_name")).scalar()
    others = F.array_except(brands, F.coalesce("visited", F.array().cast("array<string>")))
    pairs = customers.select("customer_id").distinct().join(visited, "customer_id", "left").select(
        "customer_id", F.explode(others).alias("truck_brand_name"), F.lit(0).alias("purchased"))
    return _with_items(pairs, listed)


def _with_items(pairs: DataFrame, listed: DataFrame) -> DataFrame:
    """The pairs with each item that their brand lists."""
    offered = listed.select(*[F.col(c).alias("item_truck_brand_name" if c == "truck_brand_name" else c)
                              for c in ITEM_COLUMNS])
    return pairs.join(offered, F.col("truck_brand_name") == F.col("item_truck_brand_name"))


def ordered_page(df: DataFrame, order: Sequence[str], limit: int) -> DataFrame:
    """``df.orderBy(order).limit(limit)`` (ascending, NULLs last) without
    merging ``limit`` rows from every partition in one task.

    The rows per value of the first order column are counted (one row per value,
    checkpointed) and their running totals give the exact bound: the first value
    at which ``limit`` rows are reached.  Rows below the bound are in the page
    and fewer than ``limit``; of the rows at the bound as many as are missing are
    chosen by the next order columns in the same way, so a value that holds a
    large share of all rows is not gathered.  NULLs come after every value, so
    they are looked at only when the values give too few rows.  The bound is a
    literal and reaches the scans.
    """
    from menurec.session import checkpoint_dir
    checkpoint_dir(df.sparkSession)
    sort = [F.asc_nulls_last(c) for c in order]
    return _first_rows(df, list(order), limit).orderBy(*sort).limit(limit)


def _first_rows(df: DataFrame, order: list[str], limit: int) -> DataFrame:
    """The ``limit`` first rows of ``df``, and no more than as many again."""
    if not order:
        return df.limit(limit)   # equal in every order column
    key, rest = order[0], order[1:]
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).checkpoint()
    rows = counts.agg(F.sum("n")).first()[0] or 0
    if rows <= 2 * limit:
        return df
    totals = prefix_sums(counts.filter(F.col(key).isNotNull()), key, ["n"], materialize=False)
    at = totals.filter(F.col("n_before") + F.col("n") >= limit).orderBy("n_before").first()
    if at is None:
        none = F.col(key).isNull()
        found = rows - counts.filter(none).first()["n"]
        return df.filter(~none).unionByName(_first_rows(df.filter(none), rest, limit - found))
    if at["n_before"] + at["n"] <= 2 * limit:
        return df.filter(F.col(key) <= F.lit(at[key]))
    tied = _first_rows(df.filter(F.col(key) == F.lit(at[key])), rest, limit - at["n_before"])
    return df.filter(F.col(key) < F.lit(at[key])).unionByName(tied)


def audience_filter(countries: Sequence[str] | None = None,
                    cities: Sequence[str] | None = None,
                    brands: Sequence[str] | None = None,
                    only_not_ordered: bool = False):
    """Conjunction of the app's filters; empty or None lists are skipped.

    Values are bound as literals (``isin``), never pasted into SQL text, so a
    name such as ``O'Brien`` filters like any other.
    """
    preds = []
    if countries:
        preds.append(F.col("country").isin(list(countries)))
    if cities:
        preds.append(F.col("city").isin(list(cities)))
    if brands:
        preds.append(F.col("truck_brand_name").isin(list(brands)))
    if only_not_ordered:
        preds.append(F.col("purchased") == 0)
    return and_all(preds)


def select_customers(customer_loyalty: DataFrame, countries: Sequence[str] | None = None,
                     cities: Sequence[str] | None = None) -> DataFrame:
    """The loyalty rows an audience filter can reach.

    Building the order view, the interactions and the spend averages on these
    rows gives the audience of the filter without expanding anyone else: the
    filter reaches the customer scan, and order lines of other customers count
    as anonymous.  ``customer_id`` is the table's key."""
    return customer_loyalty.filter(audience_filter(countries, cities))


def select_items(menu: DataFrame, brands: Sequence[str] | None = None) -> DataFrame:
    """The menu rows whose item is sold by one of ``brands`` (all without a
    list).  An item that other brands sell too keeps their rows, as the
    interactions have one row per menu row; :func:`audience` still filters the
    brands."""
    if not brands:
        return menu
    names = menu.filter(audience_filter(brands=brands)).select("menu_item_name")
    return menu.join(names, "menu_item_name", "left_semi").select(*menu.columns)


def audience(interactions: DataFrame, items: DataFrame, customers: DataFrame,
             averages: DataFrame, countries: Sequence[str] | None = None,
             cities: Sequence[str] | None = None, brands: Sequence[str] | None = None,
             only_not_ordered: bool = False, only_never_visited: bool = False,
             limit: int | None = None, never: DataFrame | None = None) -> DataFrame:
    """Interactions (or never-visited rows; ``never`` gives them if they are at
    hand, see :func:`unvisited`) with item, customer and spend
    features, filtered, then the first ``limit`` rows by customer.

    Left joins as in the source; a filter on a customer column lets Catalyst
    turn its left join into an inner join and push the filter to the scan of
    ``customers``.  It can't reach below the customer x item product, so build
    ``interactions`` and ``averages`` from :func:`select_customers` and
    :func:`select_items` with the same lists.  Ordering is by customer, item and brand (the source orders by customer only,
    which leaves the cut at ``limit`` arbitrary); ``limit=None`` returns every
    row.  The page is cut by :func:`ordered_page` (a bounded, pushed-down
    filter before the final sort) rather than a single-task top-k merge.  Customer and spend features join on ``customer_id``, the key the
    interaction rows are already partitioned by.
    """
    if only_never_visited:
        df = never_visited(interactions, items) if never is None else never
    else:
        df = interactions.join(items.select(*ITEM_COLUMNS), "menu_item_name", "left")
    df = (df.join(customers, "customer_id", "left")
          .join(averages, "customer_id", "left")
          .filter(audience_filter(countries, cities, brands, only_not_ordered)))
    if limit is not None:
        # all that tells two rows of a customer apart
        order = ["customer_id", "menu_item_name", "truck_brand_name", "purchased", "menu_type",
                 "item_category", "item_subcategory", "sale_price_usd"]
        df = ordered_page(df, order, limit)
    return df


def filter_options(customers: DataFrame, items: DataFrame,
                   countries: Sequence[str] | None = None) -> dict[str, DataFrame]:
    """Sorted distinct values for the app's three pickers.  Cities are
    restricted to ``countries`` when given (the cascading picker)."""
    city_src = customers
    if countries:
        city_src = customers.filter(F.col("country").isin(list(countries)))
    return {
        "country": customers.select("country").distinct().orderBy("country"),
        "city": city_src.select("city").distinct().orderBy("city"),
        "truck_brand_name": items.select("truck_brand_name").distinct()
                                 .orderBy("truck_brand_name"),
    }


def filter_lists(customers: DataFrame, items: DataFrame,
                 countries: Sequence[str]) -> DataFrame:
    """All picker lists as one table ``(kind, position, value)``: ``position``
    is the 1-based place in the sorted list (NULL last), ``city_in_country``
    the cities of ``countries``.  The rows are distinct before they are
    numbered, so a list is as long as its picker."""
    within = customers.filter(F.col("country").isin(list(countries)))
    sources = {"country": customers.select("country"), "city": customers.select("city"),
               "truck_brand_name": items.select("truck_brand_name"),
               "city_in_country": within.select("city")}
    parts = [df.toDF("value").distinct().select(F.lit(kind).alias("kind"), "value")
             for kind, df in sources.items()]
    order = Window.partitionBy("kind").orderBy(F.col("value").asc_nulls_last())
    return reduce(DataFrame.unionByName, parts).select(
        "kind", F.row_number().over(order).alias("position"), "value")
