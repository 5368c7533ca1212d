"""Properties of splits, prefix sums, encoders, scalers and joins."""

import random

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL, rows
from menurec.functions.prefix import prefix_sums
from menurec.functions.hashing import pair_key
from menurec.operators import split
from menurec.operators.feature_store import retrieve
from menurec.operators.preprocess import Preprocessor, apply_label_encoders
from menurec.plans.queries import Context


def test_split_parts_partition_the_spine(spark):
    inter = Context(spark, SF_SMALL).interactions
    keys = ["customer_id", "menu_item_name"]
    parts = split.hash_split(inter, keys)
    assert sum(p.count() for p in parts) == inter.count()
    tagged = inter.withColumn("part", split.split_index(keys))
    assert tagged.groupBy(*keys).agg(F.countDistinct("part").alias("n")).filter(
        "n > 1").count() == 0
    assert split.split_bounds([0.1, 0.1, 0.8]) == [1000, 2000, 10000]


def test_sample_n_is_exact_and_deterministic(spark):
    inter = Context(spark, SF_SMALL).interactions
    a = split.sample_n(inter, ["customer_id", "menu_item_name"], 100)
    b = split.sample_n(inter.repartition(3), ["customer_id", "menu_item_name"], 100)
    assert a.count() == 100
    assert rows(a) == rows(b)


@pytest.mark.parametrize("buckets", [1, 5])
def test_prefix_sums_equal_running_totals(spark, buckets):
    rnd = random.Random(7)
    data = [(g, k, rnd.randint(0, 5)) for g in ("a", "b", "c") for k in rnd.sample(range(1000), 200)]
    df = spark.createDataFrame(data, "g string, k long, v long")
    out = prefix_sums(df, "k", ["v"], ["g"], buckets)
    got = {(r.g, r.k): r.v_before for r in out.collect()}
    for g in ("a", "b", "c"):
        acc = 0
        for _, k, v in sorted(x for x in data if x[0] == g):
            assert got[(g, k)] == acc
            acc += v


def test_encode_decode_identity_and_scaled_range(spark):
    ctx = Context(spark, SF_SMALL)
    ds = ctx.train_dataset
    st = Preprocessor().fit(ds)
    enc = apply_label_encoders(ds, st.encoders, ["city"], keep=("city",))
    back = enc.join(st.encoders.filter("feature = 'city'"),
                    enc.city_encoded == F.col("code"), "left")
    assert back.filter(F.col("city") != F.col("value")).count() == 0
    assert back.filter(F.col("city").isNotNull() & F.col("value").isNull()).count() == 0
    scaled = st.transform(ds)
    for c in st.numeric:
        lo, hi = scaled.agg(F.min(c), F.max(c)).first()
        assert 0.0 <= lo <= hi <= 1.0 + 1e-12


def test_codes_are_dense_sorted_positions(spark):
    ds = Context(spark, SF_SMALL).train_dataset
    st = Preprocessor().fit(ds)
    for feat in ("menu_item_name", "city", "gender"):
        got = [r.value for r in st.encoders.filter(F.col("feature") == feat).orderBy("code").collect()]
        want = sorted({r[0] for r in ds.select(feat).collect() if r[0] is not None})
        assert got == want
        codes = [r.code for r in st.encoders.filter(F.col("feature") == feat).collect()]
        assert sorted(codes) == list(range(len(want)))


def test_never_visited_disjoint_from_visited(spark):
    ctx = Context(spark, SF_SMALL)
    from menurec.operators.audience import never_visited
    nv = never_visited(ctx.interactions, ctx.items)
    visited = ctx.interactions.filter("purchased = 1").join(
        ctx.items.select("menu_item_name", "truck_brand_name"), "menu_item_name").select(
        "customer_id", "truck_brand_name").distinct()
    assert nv.join(visited, ["customer_id", "truck_brand_name"]).count() == 0
    from menurec.operators.audience import unvisited
    other = unvisited(ctx.tables.customer_loyalty, ctx.orders, ctx.items)
    assert rows(nv) == rows(other.select(*nv.columns))


def test_feature_join_keeps_spine_rows(spark):
    ctx = Context(spark, SF_SMALL)
    spine = ctx.interactions
    out = retrieve(spine, [(ctx.customers, ["customer_id"]), (ctx.items, ["menu_item_name"]),
                           (ctx.averages, ["customer_id"])])
    assert out.count() == spine.count()


def test_interactions_is_full_product(spark):
    ctx = Context(spark, SF_SMALL)
    dedup_pairs = ctx.interactions.select("customer_id", "menu_item_name").distinct().count()
    assert dedup_pairs == ctx.tables.customer_loyalty.count() * ctx.items.count()


def test_auc_equals_running_totals_in_one_window(spark):
    from menurec.operators.evaluate import roc_auc
    scored = Context(spark, SF_SMALL).scored
    below = neg = pos = twice = 0
    by_score = scored.groupBy("prediction").agg(F.sum("purchased").alias("p"), F.count(F.lit(1)).alias("n"))
    for r in sorted(by_score.collect()):
        twice += r.p * (2 * below + r.n - r.p)
        below += r.n - r.p
        pos, neg = pos + r.p, neg + r.n - r.p
    assert roc_auc(scored).first()["auc"] == twice / (2.0 * pos * neg)


def test_null_keys_spread_over_partitions(spark):
    """A third of the rows with a NULL key must not land in one partition."""
    from menurec.plans.joins import left_join_spread_nulls
    left = spark.range(30000).select(
        F.col("id").alias("order_id"),
        F.when(F.col("id") % 3 == 0, F.lit(None)).otherwise(F.col("id") % 100).alias("k"))
    right = spark.range(100).select(F.col("id").alias("rk"), F.lit("x").alias("v"))
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1",
            "spark.sql.adaptive.enabled": "false"}
    old = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        joined = left_join_spread_nulls(left, right, "k", "rk", salt_cols=["order_id"])
        assert joined.count() == 30000
        parts = joined.filter("k IS NULL").select(F.spark_partition_id().alias("p")).distinct()
        assert parts.count() > 4
        assert joined.filter("k IS NOT NULL AND v = 'x'").count() == 20000
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_menu_over_broadcast_bound_gives_same_rows(spark):
    from menurec.operators.audience import never_visited
    from menurec.operators.interactions import interactions
    ctx = Context(spark, SF_SMALL)
    t = ctx.tables
    small = interactions(t.customer_loyalty, t.menu, ctx.orders, "bolt", max_items=5)
    assert rows(small) == rows(ctx.interactions)
    assert rows(never_visited(ctx.interactions, ctx.items, max_items=5)) == rows(
        never_visited(ctx.interactions, ctx.items))


@pytest.mark.parametrize("limit", [1, 37, 500, 10_000, 10**6])
def test_ordered_page_equals_plain_top_k(spark, limit):
    from menurec.operators.audience import ordered_page
    ctx = Context(spark, SF_SMALL)
    df = ctx.interactions.withColumn(
        "customer_id", F.when(F.col("customer_id") % 7 == 0, F.lit(None)).otherwise(
            F.col("customer_id")))
    order = ["customer_id", "menu_item_name"]
    plain = df.orderBy(*[F.asc_nulls_last(c) for c in order]).limit(limit)
    got = ordered_page(df, order, limit)
    assert got.count() == plain.count()
    assert sorted(got.collect(), key=str) == sorted(plain.collect(), key=str)


@pytest.mark.parametrize("limit", [5, 400, 2000])
def test_ordered_page_narrows_inside_a_hot_value(spark, limit):
    """One value, or NULL, holds most rows: the next columns choose among them."""
    from menurec.operators.audience import _first_rows, ordered_page
    df = spark.range(3000).select(
        F.when(F.col("id") % 10 == 0, F.col("id")).when(F.col("id") % 2 == 0, F.lit(7)).alias("k"),
        F.when(F.col("id") % 3 > 0, F.concat(F.lit("s"), F.col("id") % 50)).alias("s"), F.col("id").alias("x"))
    order = ["k", "s", "x"]
    plain = df.orderBy(*[F.asc_nulls_last(c) for c in order]).limit(limit)
    assert ordered_page(df, order, limit).collect() == plain.collect()
    assert limit <= _first_rows(df, order, limit).count() <= 2 * limit


@pytest.mark.parametrize("n", [1, 250, 5000, 10**6])
def test_sample_n_equals_top_k_of_the_hash(spark, n):
    inter = Context(spark, SF_SMALL).interactions
    keys = ["customer_id", "menu_item_name"]
    plain = inter.orderBy(F.md5(pair_key(*keys)), *keys).limit(n)
    assert rows(split.sample_n(inter, keys, n)) == rows(plain)


def test_purchased_interactions_are_the_purchased_rows(spark):
    ctx = Context(spark, SF_SMALL)
    assert rows(ctx.purchased) == rows(ctx.interactions.filter("purchased = 1"))


@pytest.mark.parametrize("only_never_visited", [False, True])
def test_narrowed_audience_equals_filter_of_the_whole(spark, only_never_visited):
    from menurec.operators.audience import audience, audience_filter
    ctx = Context(spark, SF_SMALL)
    lists = {"countries": ["AMERICA"], "brands": ["Brand#1", "Brand#2", "O'Brien"]}
    whole = audience(ctx.interactions, ctx.items, ctx.customers, ctx.averages,
                     only_never_visited=only_never_visited)
    want = whole.filter(audience_filter(**lists))
    assert rows(ctx.audience(only_never_visited=only_never_visited, **lists)) == rows(want)


def test_item_of_two_brands_keeps_both_menu_rows(spark):
    from menurec.operators.audience import select_items
    menu = spark.createDataFrame([("a", "x"), ("b", "x"), ("b", "y"), (None, "x"), ("b", None)],
                                 "truck_brand_name string, menu_item_name string")
    got = select_items(menu, ["a"]).collect()
    assert sorted(map(tuple, got), key=str) == [("a", "x"), ("b", "x"), (None, "x")]
    assert select_items(menu).count() == 5


def test_large_vocabulary_is_shuffled_and_the_small_ones_are_broadcast(spark, monkeypatch):
    from menurec.operators import preprocess
    n = 300
    df = spark.range(n).select(
        "id", F.when(F.col("id") % 3 > 0, F.concat(F.lit("value "), F.col("id"))).alias("wide"),
        F.when(F.col("id") % 2 > 0, F.lit("m")).alias("narrow")).checkpoint()
    codes = preprocess.fit_label_encoders(df, ["wide", "narrow"]).checkpoint()
    want = rows(apply_label_encoders(df, codes, ["wide", "narrow"]))
    monkeypatch.setattr(preprocess, "MAX_BROADCAST_BYTES", 1000)
    out = apply_label_encoders(df, codes, ["wide", "narrow"])
    assert rows(out) == want and out.count() == n
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("strategy=broadcast") == 1
