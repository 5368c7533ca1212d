"""Build the eight point-of-sale / loyalty tables from the driver's tables.

The driver ships a TPC-H-like star schema; the library works on the
point-of-sale domain.  The mapping is deterministic and fixed (FIXTURES.md
§2) so that the DuckDB oracle SQL in :mod:`menurec.plans.oracle` can build
the very same rows:

* menu: one item per distinct part name; id, brand, type and price come from
  the lowest part key of that name; category is the name's second word and
  subcategory its first.  Category ``bolt`` plays the excluded category.
* order_detail: one line per lineitem, item id resolved through the part name.
* order_header: one header per order; the truck is the order's lowest
  supplier key, the location is ``custkey % 25``.
* truck: supplier with nation (city) and region (country); franchise = nation.
* franchise: nations below 24, so one nation's trucks find no franchise.
* location: nation with its region; country: the nations as cities, with the
  region as country and its first two letters as code.
* customer_loyalty: customers except every tenth (``custkey % 10 = 9``), whose
  orders become anonymous; gender and birthday follow fixed rules.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from menurec import schemas
from menurec.sources.tables import conform, read_table

# Fixed values of the fixture mapping (must equal the oracle SQL).
LOCATION_MODULUS = 25           # location_id = custkey % 25
FRANCHISE_NATION_LIMIT = 24     # franchises exist for nations below this key
ANONYMOUS_MODULUS = 10          # custkey % 10 = 9 has no loyalty record
ANONYMOUS_REMAINDER = 9
BIRTHDAY_BASE = "1950-01-01"    # birthday = base + (custkey * 37 % 18000) days
BIRTHDAY_STEP = 37
BIRTHDAY_SPAN = 18000
EXCLUDED_CATEGORY = "bolt"      # the category standing in for beverages
AS_OF = "2001-08-01"            # "today" for ages, the last order date


@dataclass
class DomainTables:
    country: DataFrame
    menu: DataFrame
    order_detail: DataFrame
    order_header: DataFrame
    truck: DataFrame
    franchise: DataFrame
    location: DataFrame
    customer_loyalty: DataFrame


def _geo(nation: DataFrame, region: DataFrame) -> DataFrame:
    return nation.join(region, nation.n_regionkey == region.r_regionkey).select(
        "n_nationkey", "n_name", "r_name")


def adapt(spark: SparkSession, base: str) -> DomainTables:
    """Lazily map the driver tables under ``base`` to domain tables."""
    part = read_table(spark, base, "part")
    lineitem = read_table(spark, base, "lineitem")
    orders = read_table(spark, base, "orders")
    supplier = read_table(spark, base, "supplier")
    customer = read_table(spark, base, "customer")
    geo = _geo(read_table(spark, base, "nation"), read_table(spark, base, "region"))

    menu = part.groupBy("p_name").agg(
        F.min("p_partkey").alias("menu_item_id"),
        F.min_by("p_brand", "p_partkey").alias("truck_brand_name"),
        F.min_by("p_type", "p_partkey").alias("menu_type"),
        F.min_by("p_retailprice", "p_partkey").alias("sale_price_usd"),
    ).select(
        F.col("menu_item_id").alias("menu_id"),
        "menu_type",
        "menu_item_id",
        F.col("p_name").alias("menu_item_name"),
        F.split_part("p_name", F.lit(" "), F.lit(2)).alias("item_category"),
        F.split_part("p_name", F.lit(" "), F.lit(1)).alias("item_subcategory"),
        "sale_price_usd",
        "truck_brand_name",
    )

    part_item = part.select("p_partkey", "p_name").join(
        menu.select(F.col("menu_item_name").alias("p_name"), "menu_item_id"), "p_name")
    order_detail = lineitem.join(
        part_item, lineitem.l_partkey == part_item.p_partkey).select(
        (F.col("l_orderkey") * 1000 + F.col("l_linenumber")).alias("order_detail_id"),
        F.col("l_orderkey").alias("order_id"),
        "menu_item_id",
        F.col("l_linenumber").alias("line_number"),
        F.col("l_quantity").alias("quantity"),
        F.col("l_extendedprice").alias("price"),
    )

    first_supplier = lineitem.groupBy("l_orderkey").agg(
        F.min("l_suppkey").alias("truck_id"))
    order_header = orders.join(
        first_supplier, orders.o_orderkey == first_supplier.l_orderkey).select(
        F.col("o_orderkey").alias("order_id"),
        "truck_id",
        (F.col("o_custkey") % LOCATION_MODULUS).cast("double").alias("location_id"),
        F.col("o_custkey").alias("customer_id"),
        F.col("o_totalprice").alias("order_total"),
        F.col("o_orderdate").cast("timestamp_ntz").alias("order_ts"),
    )

    truck = supplier.join(geo, supplier.s_nationkey == geo.n_nationkey).select(
        F.col("s_suppkey").alias("truck_id"),
        F.col("n_name").alias("primary_city"),
        F.col("r_name").alias("region"),
        F.col("r_name").alias("country"),
        F.lit(1).alias("franchise_flag"),
        F.col("s_nationkey").alias("franchise_id"),
    )

    franchise = geo.filter(F.col("n_nationkey") < FRANCHISE_NATION_LIMIT).select(
        F.col("n_nationkey").alias("franchise_id"),
        F.col("n_name").alias("last_name"),
    )

    location = geo.select(
        F.col("n_nationkey").alias("location_id"),
        F.col("n_name").alias("city"),
        F.col("r_name").alias("country"),
    )

    key = F.col("c_custkey")
    country = geo.select(
        F.col("n_nationkey").alias("city_id"),
        F.col("n_name").alias("city"),
        F.col("r_name").alias("country"),
        F.substring("r_name", 1, 2).alias("iso_country"),
    )

    customer_loyalty = customer.filter(
        key % ANONYMOUS_MODULUS != ANONYMOUS_REMAINDER).join(
        geo, customer.c_nationkey == geo.n_nationkey).select(
        key.alias("customer_id"),
        F.col("c_name").alias("first_name"),
        F.col("n_name").alias("city"),
        F.col("r_name").alias("country"),
        F.when(key % 3 == 0, F.lit("M")).when(key % 3 == 1, F.lit("F")).alias("gender"),
        F.col("c_mktsegment").alias("marital_status"),
        F.date_add(F.lit(BIRTHDAY_BASE).cast("date"),
                   (key * BIRTHDAY_STEP % BIRTHDAY_SPAN).cast("int")).alias("birthday_date"),
    )

    return DomainTables(
        country=conform(country, schemas.COUNTRY),
        menu=conform(menu, schemas.MENU),
        order_detail=conform(order_detail, schemas.ORDER_DETAIL),
        order_header=conform(order_header, schemas.ORDER_HEADER),
        truck=conform(truck, schemas.TRUCK),
        franchise=conform(franchise, schemas.FRANCHISE),
        location=conform(location, schemas.LOCATION),
        customer_loyalty=conform(customer_loyalty, schemas.CUSTOMER_LOYALTY),
    )
