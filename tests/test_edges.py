"""Hand-written edge rows (FIXTURES.md section 4)."""

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from conftest import rows
from helpers import d, make, small_domain
from menurec import schemas
from menurec.functions.dates import (age_in_years, months_between_boundaries,
                                     weeks_between, years_between)
from menurec.functions.money import rounded_average
from menurec.operators import audience as aud
from menurec.operators import evaluate, features, harmonize, recommend
from menurec.operators.interactions import interactions
from menurec.operators.preprocess import Preprocessor, apply_min_max, fit_min_max


@pytest.fixture(scope="module")
def dom(spark):
    t = small_domain(spark)
    t["orders"] = harmonize.orders_v(t["order_detail"], t["order_header"], t["truck"],
                                     t["menu"], t["franchise"], t["location"],
                                     t["customers"])
    return t


def test_orders_view_keeps_anonymous_and_drops_unmatched(dom):
    got = rows(dom["orders"], "order_id", "customer_id")
    assert got == sorted([(100, 1), (101, None), (104, 1), (105, 1), (105, 1), (105, 1)],
                         key=lambda r: (r[0], r[1] or 0))
    assert dom["orders"].columns[0] == "date"
    assert len(dom["orders"].columns) == 33


def test_interactions_truck_duplicates_and_dedupe(dom):
    inter = interactions(dom["customers"], dom["menu"], dom["orders"])
    assert rows(inter) == [(1, "Taco", 1), (1, "Taco", 1), (1, "Wrap", 0),
                           (2, "Taco", 0), (2, "Wrap", 0)]
    dd = interactions(dom["customers"], dom["menu"], dom["orders"], dedupe=True)
    assert rows(dd) == [(1, "Taco", 1), (1, "Wrap", 0), (2, "Taco", 0), (2, "Wrap", 0)]


def test_anonymous_absent_from_averages_and_grains(dom):
    line = features.purchase_averages(dom["orders"])
    assert rows(line) == [(1, Decimal("20.00"), Decimal("40.00"), Decimal("40.00"))]
    order = features.purchase_averages(dom["orders"], grain="order")
    assert rows(order) == [(1, Decimal("10.00"), Decimal("20.00"), Decimal("20.00"))]


def test_null_category_dropped(dom):
    items = features.menu_features(dom["menu"])
    assert sorted(r.menu_item_name for r in items.collect()) == ["Taco", "Wrap"]
    assert features.menu_features(dom["menu"], None).count() == 4


@pytest.mark.parametrize("a,b,months,weeks,years", [
    ("2024-01-31", "2024-02-01", 1, 0, 0),
    ("2024-01-07", "2024-01-08", 0, 1, 0),
    ("2024-01-06", "2024-01-07", 0, 0, 0),
    ("2023-12-31", "2024-01-01", 1, 1, 1),   # Sunday -> Monday: a week boundary too
])
def test_boundary_date_diffs(spark, a, b, months, weeks, years):
    df = spark.createDataFrame([(d(a), d(b))], "a date, b date")
    r = df.select(months_between_boundaries("a", "b").alias("m"),
                  weeks_between("a", "b").alias("w"),
                  years_between("a", "b").alias("y")).first()
    assert (r.m, r.w, r.y) == (months, weeks, years)


def test_age_ignores_birthday(spark):
    df = spark.createDataFrame([(d("1990-12-31"),)], "b date")
    assert df.select(age_in_years("b", "2001-01-01")).first()[0] == 11


def test_rounding_tie_half_up(spark):
    df = spark.createDataFrame([(Decimal("100.01"), 2)], "t decimal(18,4), n int")
    assert df.select(rounded_average("t", "n")).first()[0] == Decimal("50.01")


def test_tied_scores_keep_ties(spark):
    df = spark.createDataFrame([(1, f"i{i}", s) for i, s in enumerate([.9, .8, .8, .8, .1])],
                               "customer_id long, menu_item_name string, prediction double")
    top = recommend.top_k(df, 3)
    assert sorted(r["rank"] for r in top.collect()) == [1, 2, 2, 2]


def test_auc_with_ties_and_one_class(spark):
    df = spark.createDataFrame([(0, .1), (1, .4), (0, .4), (1, .8)],
                               "purchased int, prediction double")
    assert evaluate.roc_auc(df).first()["auc"] == pytest.approx(0.875)
    one = spark.createDataFrame([(1, .3), (1, .5)], "purchased int, prediction double")
    assert evaluate.roc_auc(one).first()["auc"] is None


def test_no_positive_prediction(spark):
    df = spark.createDataFrame([(0, .1), (1, .4)], "purchased int, prediction double")
    r = evaluate.binary_metrics(df, threshold=0.9).first()
    assert (r.tp, r.fp, r.fn, r.tn) == (0, 0, 1, 1)
    assert (r.precision, r.recall, r.f1) == (0.0, 0.0, 0.0)


def test_encoder_unseen_quoted_and_null(spark):
    train = spark.createDataFrame([("F", 1.0), ("O'Brien", 2.0), (None, 3.0)],
                                  "gender string, age double")
    st = Preprocessor(["gender"], ["age"]).fit(train)
    assert rows(st.encoders, "value", "code") == [("F", 0), ("O'Brien", 1)]
    test = spark.createDataFrame([("F",), ("O'Brien",), (None,), ("X",)], "gender string")
    from menurec.operators.preprocess import apply_label_encoders
    out = apply_label_encoders(test, st.encoders, ["gender"], keep=("gender",))
    got = {r.gender: r.gender_encoded for r in out.collect()}
    assert got == {"F": 0, "O'Brien": 1, None: None, "X": None}


def test_constant_and_null_dense(spark):
    df = spark.createDataFrame([(5.0, 1.0), (5.0, None), (5.0, 3.0)], "c double, n double")
    out = apply_min_max(df, fit_min_max(df, ["c", "n"]))
    assert [r.c for r in out.collect()] == [0.0, 0.0, 0.0]
    assert sorted(out.collect(), key=lambda r: (r.n is None, r.n))[2].n is None
    assert sorted(r.n for r in out.collect() if r.n is not None) == [0.0, 1.0]


def test_no_history_gives_empty_list(dom):
    inter = interactions(dom["customers"], dom["menu"], dom["orders"])
    cust = features.customer_features(dom["customers"], "2024-06-01")
    scored = inter.join(cust.select("customer_id", "city"), "customer_id").withColumn(
        "prediction", F.lit(0.5))
    rec = {r.customer_id: r for r in recommend.recommendations(scored, inter).collect()}
    assert rec[2].purchase_history == []
    assert rec[1].purchase_history == ["Taco", "Taco"]
    assert rec[1].city == "A"


def test_empty_audience(dom):
    inter = interactions(dom["customers"], dom["menu"], dom["orders"])
    items = features.menu_features(dom["menu"])
    cust = features.customer_features(dom["customers"], "2024-06-01")
    avgs = features.purchase_averages(dom["orders"])
    out = aud.audience(inter, items, cust, avgs, countries=["Nowhere"])
    assert out.count() == 0
    quoted = aud.audience(inter, items, cust, avgs, brands=["O'Brien"])
    assert quoted.count() == 0


def literal_never_visited(inter, items):
    """The definition word for word: pairs of all interactions, minus the pairs
    with a purchase by an anti join, times the brand's items."""
    pairs = inter.join(items.select("menu_item_name", "truck_brand_name"), "menu_item_name").drop("menu_item_name")
    bought = pairs.filter("purchased = 1").select("customer_id", "truck_brand_name")
    never = pairs.distinct().join(bought, ["customer_id", "truck_brand_name"], "left_anti")
    return never.join(items.withColumnRenamed("truck_brand_name", "item_truck_brand_name"),
                      F.col("truck_brand_name") == F.col("item_truck_brand_name"))


def test_unvisited_with_odd_rows(spark, dom):
    """NULL and repeated customers, an item of two brands, a NULL brand, a brand
    without listed items, an item that is not on the menu."""
    menu = dom["menu"].unionByName(make(spark, schemas.MENU, [
        {"menu_item_id": 20, "menu_item_name": "Taco", "item_category": "Food", "truck_brand_name": "C"},
        {"menu_item_id": 21, "menu_item_name": "Nameless", "item_category": "Food"},
        {"menu_item_id": 22, "menu_item_name": "Juice", "item_category": "Beverage", "truck_brand_name": "D"}]))
    people = dom["customers"].unionByName(make(spark, schemas.CUSTOMER_LOYALTY, [
        {"customer_id": None}, {"customer_id": None}, {"customer_id": 2}, {"customer_id": 9}]))
    orders = dom["orders"].unionByName(dom["orders"].limit(1).withColumn("menu_item_name", F.lit("gone")))
    items = features.menu_features(menu)
    want = rows(literal_never_visited(interactions(people, menu, orders), items), "truck_brand_name", "menu_item_name", "purchased")
    got = aud.unvisited(people, orders, items)
    assert rows(got, "truck_brand_name", "menu_item_name", "purchased") == want
    assert rows(got.filter("customer_id is not null")) == rows(aud.never_visited(
        interactions(people, menu, orders), items).filter("customer_id is not null").select(*got.columns))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Cross" not in plan and "ScalarSubquery" in plan or "scalar-subquery" in plan


def test_never_visited_both_methods(dom):
    inter = interactions(dom["customers"], dom["menu"], dom["orders"])
    items = features.menu_features(dom["menu"])
    a = aud.never_visited(inter, items)
    for b in (literal_never_visited(inter, items), aud.unvisited(dom["customers"], dom["orders"], items)):
        assert rows(a) == rows(b.select(*a.columns))
    assert rows(a, "customer_id", "truck_brand_name", "menu_item_name") == [
        (1, "B", "Wrap"), (2, "A", "Taco"), (2, "B", "Wrap")]


def test_csv_null_markers_and_quotes(spark, tmp_dir):
    from menurec.sources.csv import read_csv
    path = f"{tmp_dir}/t.csv"
    with open(path, "w") as f:
        f.write("A,B,C,D,E\n")
        f.write('NULL,null,,"a ""q"" x",7\n')
    schema = schemas._schema(("a", schemas.T.StringType()), ("b", schemas.T.StringType()),
                             ("c", schemas.T.StringType()), ("d", schemas.T.StringType()),
                             ("e", schemas.T.LongType()))
    r = read_csv(spark, path, schema).first()
    assert (r.a, r.b, r.c, r.d, r.e) == (None, None, None, 'a "q" x', 7)


def test_csv_bad_value_fails(spark, tmp_dir):
    from menurec.sources.csv import read_csv
    path = f"{tmp_dir}/bad.csv"
    with open(path, "w") as f:
        f.write("A\nnot-a-number\n")
    schema = schemas._schema(("a", schemas.T.LongType()))
    with pytest.raises(Exception):
        read_csv(spark, path, schema).collect()


@pytest.mark.parametrize("line", ["1,2,3", "1,2,", "1"])
def test_csv_column_count_mismatch_fails(spark, tmp_dir, line):
    """Like the source's load, a line with more or fewer fields than the
    table has columns aborts the load (FAILFAST)."""
    from menurec.sources.csv import read_csv
    path = f"{tmp_dir}/count.csv"
    with open(path, "w") as f:
        f.write("A,B\n1,2\n" + line + "\n")
    schema = schemas._schema(("a", schemas.T.LongType()), ("b", schemas.T.LongType()))
    with pytest.raises(Exception):
        read_csv(spark, path, schema).collect()
