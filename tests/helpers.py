"""Tiny hand-written domain tables for edge-case tests."""

import datetime as dt
from decimal import Decimal

from menurec import schemas


def make(spark, schema, records):
    """DataFrame of ``schema`` from dicts; missing fields are NULL."""
    return spark.createDataFrame(
        [tuple(r.get(f.name) for f in schema.fields) for r in records], schema)


def d(s):
    return dt.date.fromisoformat(s)


def ts(s):
    return dt.datetime.fromisoformat(s)


def money(x):
    return Decimal(str(x))


def small_domain(spark):
    """Trucks 1-2 (franchise 1), truck 3 (no franchise); location 1;
    items 10 Taco (Food), 11 Soda (Beverage), 12 Mystery (NULL category),
    13 Wrap (Food, brand B); customers 1 and 2.

    Orders: 100 customer 1 at truck 1 (Taco), 101 anonymous (Taco),
    102 customer 1 at truck 3 (dropped: no franchise), 103 customer 1 at
    location 999 (dropped), 104 customer 1 at truck 2 (Taco again),
    105 customer 1, three lines, total 10.
    """
    truck = make(spark, schemas.TRUCK, [
        {"truck_id": 1, "franchise_id": 1, "primary_city": "A", "country": "X"},
        {"truck_id": 2, "franchise_id": 1, "primary_city": "A", "country": "X"},
        {"truck_id": 3, "franchise_id": None, "primary_city": "A", "country": "X"},
    ])
    franchise = make(spark, schemas.FRANCHISE, [{"franchise_id": 1, "last_name": "F"}])
    location = make(spark, schemas.LOCATION, [{"location_id": 1, "city": "A"}])
    menu = make(spark, schemas.MENU, [
        {"menu_item_id": 10, "menu_item_name": "Taco", "item_category": "Food",
         "item_subcategory": "Hot", "truck_brand_name": "A", "menu_type": "Mex",
         "sale_price_usd": money(5)},
        {"menu_item_id": 11, "menu_item_name": "Soda", "item_category": "Beverage",
         "item_subcategory": "Cold", "truck_brand_name": "A", "menu_type": "Mex",
         "sale_price_usd": money(2)},
        {"menu_item_id": 12, "menu_item_name": "Mystery", "item_category": None,
         "truck_brand_name": "A", "menu_type": "Mex", "sale_price_usd": money(1)},
        {"menu_item_id": 13, "menu_item_name": "Wrap", "item_category": "Food",
         "item_subcategory": "Cold", "truck_brand_name": "B", "menu_type": "Deli",
         "sale_price_usd": money(7)},
    ])
    customers = make(spark, schemas.CUSTOMER_LOYALTY, [
        {"customer_id": 1, "city": "A", "country": "X", "gender": "F",
         "marital_status": "S", "birthday_date": d("1990-06-01")},
        {"customer_id": 2, "city": "B", "country": "Y", "gender": None,
         "marital_status": "M", "birthday_date": d("1980-12-31")},
    ])
    h = lambda o, c, t, loc, total, when: {
        "order_id": o, "customer_id": c, "truck_id": t, "location_id": loc,
        "order_total": money(total), "order_ts": ts(when)}
    header = make(spark, schemas.ORDER_HEADER, [
        h(100, 1, 1, 1.0, 5, "2024-01-31 10:00:00"),
        h(101, None, 1, 1.0, 5, "2024-01-31 11:00:00"),
        h(102, 1, 3, 1.0, 5, "2024-02-01 10:00:00"),
        h(103, 1, 1, 999.0, 5, "2024-02-01 10:00:00"),
        h(104, 1, 2, 1.0, 5, "2024-02-01 12:00:00"),
        h(105, 1, 1, 1.0, 10, "2024-02-01 13:00:00"),
    ])
    line = lambda o, n, item: {"order_id": o, "line_number": n, "menu_item_id": item,
                                "quantity": 1, "price": money(1)}
    detail = make(spark, schemas.ORDER_DETAIL, [
        line(100, 1, 10), line(101, 1, 10), line(102, 1, 10), line(103, 1, 10),
        line(104, 1, 10), line(105, 1, 11), line(105, 2, 11), line(105, 3, 11),
    ])
    return dict(order_detail=detail, order_header=header, truck=truck, menu=menu,
                franchise=franchise, location=location, customers=customers)
