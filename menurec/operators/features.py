"""Customer, menu-item and purchase features."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from menurec.functions.dates import (age_in_years, months_between_boundaries,
                                     weeks_between, years_between)
from menurec.functions.money import rounded_average

BEVERAGE = "Beverage"


def customer_features(customers: DataFrame, as_of=None) -> DataFrame:
    """Demographic features with ``age`` = year boundaries up to ``as_of``."""
    return customers.select(
        "customer_id", "city", "country", "gender", "marital_status",
        "birthday_date", age_in_years("birthday_date", as_of).alias("age"))


def menu_features(menu: DataFrame, excluded_category: str | None = BEVERAGE) -> DataFrame:
    """Item features.  ``item_category != excluded`` also drops NULL categories
    (three-valued logic), as the source filter does; ``None`` keeps all rows
    (the stored feature table)."""
    items = menu.select("menu_type", "truck_brand_name", "menu_item_name",
                        "item_category", "item_subcategory", "sale_price_usd")
    if excluded_category is not None:
        items = items.filter(F.col("item_category") != F.lit(excluded_category))
    return items


def purchase_spans(orders: DataFrame, grain: str = "line") -> DataFrame:
    """Per known customer: spend, first/last order date and the boundary
    counts between them.

    ``grain="line"`` sums ``order_total`` once per order line, as the source
    does (an order with three lines counts three times); ``grain="order"``
    counts each order once.  One aggregation computes everything; partial
    aggregation runs before the shuffle, so a customer holding a large share
    of the lines costs one partial row per map task.
    """
    known = orders.filter(F.col("customer_id").isNotNull())
    if grain == "order":
        known = known.groupBy("customer_id", "order_id").agg(
            F.max("order_total").alias("order_total"), F.min("date").alias("date"))
    elif grain != "line":
        raise ValueError(f"grain must be 'line' or 'order', not {grain!r}")
    return with_spans(spend_state(known))


# How the partial states of the same customer merge.
SPEND_MERGE = {"total_spend": "sum", "first_date": "min", "last_date": "max"}


def spend_state(orders: DataFrame) -> DataFrame:
    """Spend, first and last order date per known customer: all that the averages
    need, and mergeable (:data:`SPEND_MERGE`) with the state of other orders."""
    return orders.filter(F.col("customer_id").isNotNull()).groupBy("customer_id").agg(
        F.sum("order_total").alias("total_spend"),
        F.min("date").alias("first_date"),
        F.max("date").alias("last_date"))


def with_spans(state: DataFrame) -> DataFrame:
    """The state with the boundaries between its dates counted."""
    return state.select(
        "customer_id", "total_spend", "first_date", "last_date",
        months_between_boundaries("first_date", "last_date").alias("months"),
        weeks_between("first_date", "last_date").alias("weeks"),
        years_between("first_date", "last_date").alias("years"))


def purchase_averages(orders: DataFrame, grain: str = "line") -> DataFrame:
    """Average spend per calendar month, week and year of activity:
    ``ROUND(SUM(total) / (boundaries(first, last) + 1), 2)``.

    The source computes three aggregates and inner-joins them on customer;
    one aggregate gives the same rows (the NULL customer, which that join
    drops, is filtered first).
    """
    return span_averages(purchase_spans(orders, grain))


def span_averages(spans: DataFrame) -> DataFrame:
    """Average spend per period of counted spans."""
    return spans.select(
        "customer_id",
        rounded_average("total_spend", F.col("months") + 1).alias("avg_monthly_purchase_amount"),
        rounded_average("total_spend", F.col("weeks") + 1).alias("avg_weekly_purchase_amount"),
        rounded_average("total_spend", F.col("years") + 1).alias("avg_yearly_purchase_amount"))
