"""The denormalised order-line view (harmonized + analytics ``orders_v``)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from menurec.plans.joins import left_join_spread_nulls

# The harmonized view's output columns, in the source's order.
ORDERS_V_COLUMNS = [
    "order_id", "truck_id", "order_ts", "order_detail_id", "line_number",
    "truck_brand_name", "menu_type", "primary_city", "region", "country",
    "franchise_flag", "franchise_id", "franchisee_first_name",
    "franchisee_last_name", "location_id", "customer_id", "first_name",
    "last_name", "e_mail", "phone_number", "children_count", "gender",
    "marital_status", "menu_item_id", "menu_item_name", "quantity",
    "unit_price", "price", "order_amount", "order_tax_amount",
    "order_discount_amount", "order_total",
]


def harmonized_orders(order_detail: DataFrame, order_header: DataFrame,
                      truck: DataFrame, menu: DataFrame, franchise: DataFrame,
                      location: DataFrame, customers: DataFrame) -> DataFrame:
    """Order lines joined to header, truck, menu, franchise, location (inner)
    and loyalty customer (left).

    Inner joins commute, so the header is first reduced by its three small
    dimensions and the detail by the menu; only then do the two fact tables
    meet on ``order_id`` (the one large shuffle).  Orders whose truck, menu
    item, franchise or location is unknown drop out, as in the source view.
    """
    t = truck.select("truck_id", "primary_city", "region", "country",
                     "franchise_flag", F.col("franchise_id").alias("t_franchise_id"))
    f = franchise.select(
        F.col("franchise_id").alias("t_franchise_id"),
        F.col("first_name").alias("franchisee_first_name"),
        F.col("last_name").alias("franchisee_last_name"))
    loc = location.select(F.col("location_id").alias("l_location_id"))
    header = (order_header
              .select("order_id", "truck_id", "order_ts",
                      F.col("customer_id").alias("oh_customer_id"),
                      F.col("location_id").alias("oh_location_id"),
                      "order_amount", "order_tax_amount",
                      "order_discount_amount", "order_total")
              .join(t, "truck_id")
              .join(f, "t_franchise_id")
              .join(loc, F.col("oh_location_id") == F.col("l_location_id"))
              .withColumnRenamed("t_franchise_id", "franchise_id")
              .withColumnRenamed("l_location_id", "location_id")
              .drop("oh_location_id"))

    m = menu.select("menu_item_id", "truck_brand_name", "menu_type", "menu_item_name")
    lines = order_detail.select(
        "order_id", "order_detail_id", "line_number", "menu_item_id",
        "quantity", "unit_price", "price").join(m, "menu_item_id")

    facts = lines.join(header, "order_id")
    c = customers.select("customer_id", "first_name", "last_name", "e_mail",
                         "phone_number", "children_count", "gender", "marital_status")
    # The view shows the loyalty record's id: NULL for unknown customers.
    joined = left_join_spread_nulls(facts, c, "oh_customer_id", "customer_id",
                                    salt_cols=["order_id"])
    return joined.select(*ORDERS_V_COLUMNS)


def orders_v(order_detail: DataFrame, order_header: DataFrame, truck: DataFrame,
             menu: DataFrame, franchise: DataFrame, location: DataFrame,
             customers: DataFrame) -> DataFrame:
    """Analytics view: ``DATE(order_ts) AS date`` followed by every column."""
    h = harmonized_orders(order_detail, order_header, truck, menu, franchise,
                          location, customers)
    return h.select(F.to_date("order_ts").alias("date"), "*")
