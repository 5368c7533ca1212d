"""Typed schemas of the raw point-of-sale and loyalty tables.

Ids are ``long`` (cheap joins), money is ``decimal(18,4)``, money that the
source keeps as text stays ``string`` and is cast where used.  ``TIME``
columns are kept as strings (Spark's time type is off by default) and the
nested health-metrics object is held as JSON text (``parse_json`` turns it
into a variant when needed); neither is queried.
"""

from __future__ import annotations

from pyspark.sql import types as T

MONEY = T.DecimalType(18, 4)


def _schema(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, dtype, True) for name, dtype in fields])


COUNTRY = _schema(
    ("country_id", T.LongType()), ("country", T.StringType()),
    ("iso_currency", T.StringType()), ("iso_country", T.StringType()),
    ("city_id", T.LongType()), ("city", T.StringType()),
    ("city_population", T.LongType()),
)

MENU = _schema(
    ("menu_id", T.LongType()), ("menu_type_id", T.LongType()),
    ("menu_type", T.StringType()), ("menu_item_id", T.LongType()),
    ("menu_item_name", T.StringType()), ("item_category", T.StringType()),
    ("item_subcategory", T.StringType()), ("cost_of_goods_usd", MONEY),
    ("sale_price_usd", MONEY), ("menu_item_health_metrics_obj", T.StringType()),
    ("truck_brand_name", T.StringType()),
)

LOCATION = _schema(
    ("location_id", T.LongType()), ("placekey", T.StringType()),
    ("location", T.StringType()), ("city", T.StringType()),
    ("region", T.StringType()), ("iso_country_code", T.StringType()),
    ("country", T.StringType()),
)

ORDER_DETAIL = _schema(
    ("order_detail_id", T.LongType()), ("order_id", T.LongType()),
    ("menu_item_id", T.LongType()), ("discount_id", T.StringType()),
    ("line_number", T.LongType()), ("quantity", T.IntegerType()),
    ("unit_price", MONEY), ("price", MONEY),
    ("order_item_discount_amount", T.StringType()),
)

ORDER_HEADER = _schema(
    ("order_id", T.LongType()), ("truck_id", T.LongType()),
    ("location_id", T.DoubleType()), ("customer_id", T.LongType()),
    ("discount_id", T.StringType()), ("shift_id", T.LongType()),
    ("shift_start_time", T.StringType()), ("shift_end_time", T.StringType()),
    ("order_channel", T.StringType()), ("served_ts", T.StringType()),
    ("order_currency", T.StringType()), ("order_amount", MONEY),
    ("order_tax_amount", T.StringType()), ("order_discount_amount", T.StringType()),
    ("order_total", MONEY), ("order_ts", T.TimestampNTZType()),
)

TRUCK = _schema(
    ("truck_id", T.LongType()), ("menu_type_id", T.LongType()),
    ("primary_city", T.StringType()), ("region", T.StringType()),
    ("iso_region", T.StringType()), ("country", T.StringType()),
    ("iso_country_code", T.StringType()), ("franchise_flag", T.LongType()),
    ("year", T.LongType()), ("make", T.StringType()), ("model", T.StringType()),
    ("ev_flag", T.LongType()), ("franchise_id", T.LongType()),
    ("truck_opening_date", T.DateType()),
)

FRANCHISE = _schema(
    ("franchise_id", T.LongType()), ("first_name", T.StringType()),
    ("last_name", T.StringType()), ("city", T.StringType()),
    ("country", T.StringType()), ("e_mail", T.StringType()),
    ("phone_number", T.StringType()),
)

CUSTOMER_LOYALTY = _schema(
    ("customer_id", T.LongType()), ("first_name", T.StringType()),
    ("last_name", T.StringType()), ("city", T.StringType()),
    ("country", T.StringType()), ("postal_code", T.StringType()),
    ("preferred_language", T.StringType()), ("gender", T.StringType()),
    ("favourite_brand", T.StringType()), ("marital_status", T.StringType()),
    ("children_count", T.StringType()), ("sign_up_date", T.DateType()),
    ("birthday_date", T.DateType()), ("e_mail", T.StringType()),
    ("phone_number", T.StringType()),
)

RAW_TABLES = {
    "country": COUNTRY,
    "menu": MENU,
    "location": LOCATION,
    "order_detail": ORDER_DETAIL,
    "order_header": ORDER_HEADER,
    "truck": TRUCK,
    "franchise": FRANCHISE,
    "customer_loyalty": CUSTOMER_LOYALTY,
}

# Model inputs, in one fixed order used for training and scoring alike.
SPARSE_FEATURES = [
    "menu_item_name", "menu_type", "truck_brand_name", "item_category",
    "item_subcategory", "city", "country", "gender", "marital_status",
]
DENSE_FEATURES = [
    "sale_price_usd", "age", "avg_monthly_purchase_amount",
    "avg_weekly_purchase_amount", "avg_yearly_purchase_amount",
]
LABEL = "purchased"
# Inputs the app keeps next to their codes.
KEEP_WITH_CODES = ("city", "truck_brand_name", "menu_item_name")
