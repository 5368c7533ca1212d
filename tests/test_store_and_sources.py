"""Feature store registry, saved state, sinks, CSV load and streaming load."""

import json
import os

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL, rows
from menurec import schemas, sinks
from menurec.operators.feature_store import Entity, FeatureStore
from menurec.operators.preprocess import PreprocessState, Preprocessor, read_classes_json
from menurec.plans.queries import Context
from menurec.sources.csv import load_csv_table


def test_feature_store_lifecycle(spark, tmp_dir):
    ctx = Context(spark, SF_SMALL)
    fs = FeatureStore(spark, f"{tmp_dir}/fs")
    cust = fs.register_entity(Entity("CustomerIds", ["Customer_ID"]))
    item = fs.register_entity(Entity("Menu_ItemNames", ["MENU_ITEM_NAME"]))
    fs.register_entity(Entity("CustomerIds", ["Customer_ID"]))   # no-op
    assert fs.list_entities().count() == 2
    cv = fs.register_view("CUSTOMER_FEATURES", [cust], ctx.customers, "V1", "1 day")
    with pytest.raises(ValueError):
        fs.register_view("CUSTOMER_FEATURES", [cust], ctx.customers, "V1")
    fs.register_view("CUSTOMER_FEATURES", [cust], ctx.customers, "V1", "1 day", overwrite=True)
    mv = fs.register_view("MENU_FEATURES", [item], ctx.items, "V1")
    pv = fs.register_view("PURCHASE_FEATURES", [cust], ctx.averages, "V1")
    assert fs.list_views().count() == 3
    assert fs.list_views("CustomerIds").count() == 2
    got = fs.get_view("customer_features", "V1")
    assert got.df.count() == ctx.customers.count() and got.refresh_freq == "1 day"
    spine = ctx.interactions
    ds = fs.dataset("train", spine, [cv, mv, pv], drop=["birthday_date"])
    assert ds.count() == spine.count() and "birthday_date" not in ds.columns
    assert {"city", "sale_price_usd", "avg_weekly_purchase_amount"} <= set(ds.columns)
    fs.refresh("MENU_FEATURES", "V1", ctx.all_items)
    assert fs.get_view("MENU_FEATURES", "V1").df.count() == ctx.all_items.count()
    with pytest.raises(ValueError):
        fs.delete_entity("Menu_ItemNames")
    fs.delete_view("MENU_FEATURES", "V1")
    fs.delete_entity("Menu_ItemNames")
    assert fs.list_entities().count() == 1
    with pytest.raises(KeyError):
        fs.get_view("MENU_FEATURES", "V1")


def _spend_store(spark, root):
    from menurec.plans.warehouse import SPEND
    fs = FeatureStore(spark, root, {"spend": SPEND})
    return fs, fs.register_entity(Entity("c", ["customer_id"]))


def test_refresh_from_new_rows_only(spark, tmp_dir):
    """A refresh merges states, twice the same refresh adds nothing, and the
    new rows are the only ones it is given."""
    from menurec.operators.features import purchase_averages
    orders = Context(spark, SF_SMALL).orders.cache()
    third = F.pmod(F.col("order_id"), F.lit(3))
    fs, c = _spend_store(spark, f"{tmp_dir}/fs")
    fs.register_mergeable("spend", [c], "spend", orders.filter(third == 0), "V1", upto=0)
    old = fs.get_view("spend", "V1")
    for k in (1, 1, 2, 1, 2):
        fs.refresh("spend", "V1", orders.filter(third == k), upto=k)
    assert rows(fs.get_view("spend", "V1").df) == rows(purchase_averages(orders))
    assert rows(old.df) == rows(purchase_averages(orders.filter(third == 0)))   # an old reader keeps its files
    with pytest.raises(ValueError):
        fs.refresh("spend", "V1", orders)
    fs.refresh("spend", "V1", orders.limit(0), upto=3)
    assert rows(fs.get_view("spend", "V1").df) == rows(purchase_averages(orders))
    with pytest.raises(KeyError):
        fs.refresh("spend", "V2", orders, upto=1)
    orders.unpersist()


def test_registry_follows_sequence_not_clock(spark, tmp_dir, monkeypatch):
    from menurec.operators import feature_store
    fs, c = _spend_store(spark, f"{tmp_dir}/fs")
    df = spark.createDataFrame([(1, 2.0)], "customer_id long, x double")
    fs.register_view("v", [c], df, "V1")
    monkeypatch.setattr(feature_store.time, "time", lambda: 0.0)   # the clock goes back
    fs.refresh("V", "V1", df.withColumn("x", F.lit(3.0)))
    assert fs.get_view("v", "V1").df.first()["x"] == 3.0
    fs.delete_view("v", "V1")
    assert fs.list_views().count() == 0


def test_datasets_in_parts_and_vacuum(spark, tmp_dir):
    fs, c = _spend_store(spark, f"{tmp_dir}/fs")
    people = spark.range(30).selectExpr("id as customer_id", "id * 2 as x", "id * 3 as y")
    v = fs.register_view("people", [c], people, "V1")
    fs.dataset("d", people.select("customer_id"), [v], ["y"], F.pmod("customer_id", F.lit(3)))
    assert fs.get_dataset("d").columns == ["customer_id", "x"] and fs.get_dataset("d").count() == 30
    one = fs.get_dataset("d", 1).select("x")
    assert rows(one) == [(2 * i,) for i in range(1, 30, 3)]
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(part" in plan and "ReadSchema: struct<x:bigint>" in plan
    fs.refresh("people", "V1", people)
    assert fs.vacuum() == 1 and fs.vacuum() == 0
    assert fs.get_view("people", "V1").df.count() == 30 and fs.get_dataset("d").count() == 30
    fs.delete_dataset("d")
    fs.delete_view("people", "V1")
    assert fs.vacuum() == 2 and fs.snapshots() == []
    with pytest.raises(KeyError):
        fs.get_dataset("d")


def test_preprocess_state_round_trips(spark, tmp_dir):
    ds = Context(spark, SF_SMALL).train_dataset
    st = Preprocessor().fit(ds)
    st.save(f"{tmp_dir}/state")
    back = PreprocessState.load(spark, f"{tmp_dir}/state")
    assert back.ranges == st.ranges
    assert rows(back.encoders) == rows(st.encoders)
    st.export_classes_json(f"{tmp_dir}/classes")
    assert rows(read_classes_json(spark, f"{tmp_dir}/classes")) == rows(st.encoders)
    st.export_classes_json(f"{tmp_dir}/parts", chunk=3)   # vocabularies over several lines
    assert spark.read.text(f"{tmp_dir}/parts").count() > len(st.categorical)
    assert rows(read_classes_json(spark, f"{tmp_dir}/parts")) == rows(st.encoders)


def test_encoder_file_of_one_object(spark, tmp_dir):
    """The source's file: one object with every feature; empty lists, quotes and
    line breaks inside values; a broken line is an error."""
    classes = {"city": ["Bonn", "O\"Hare", "São\nPaulo"], "gender": [], "country": ["", "é"]}
    os.makedirs(f"{tmp_dir}/file")
    with open(f"{tmp_dir}/file/label_encoders.json", "w") as f:
        json.dump({k: {"input_cols": [k], "output_cols": [k + "_encoded"], "classes_": v} for k, v in classes.items()}, f)
    got = read_classes_json(spark, f"{tmp_dir}/file")
    assert sorted(map(tuple, got.collect())) == sorted((k, x, i) for k, v in classes.items() for i, x in enumerate(v))
    with open(f"{tmp_dir}/file/broken.json", "w") as f:
        f.write('{"city": {"classes_": [')
    with pytest.raises(Exception, match="(?i)malformed"):
        read_classes_json(spark, f"{tmp_dir}/file").collect()


def test_saved_table_is_published_by_its_manifest(spark, tmp_dir):
    path = f"{tmp_dir}/table"
    with pytest.raises(FileNotFoundError):
        sinks.read_table(spark, path)
    first = sinks.save_table(spark.range(5), path, run_id="a")
    assert first.count() == 5
    spark.range(9).write.parquet(f"{path}/data-unfinished")   # a save that failed before its manifest row
    assert sinks.read_table(spark, path).count() == 5
    assert sinks.save_table(spark.range(7), path, run_id="a").count() == 5   # the run has published
    assert sinks.saves(spark, path).count() == 1
    second = sinks.save_table(spark.range(3), path, run_id="b")
    assert (first.count(), second.count()) == (5, 3)   # a reader keeps its files
    empty = sinks.save_table(spark.range(0).selectExpr("id", "cast(null as string) as k"), path, ["k"])
    assert empty.columns == ["id", "k"] and empty.count() == 0
    assert [r["rows"] for r in sinks.saves(spark, path).orderBy("save_no").collect()] == [5, 3, 0]
    assert sinks.vacuum_table(spark, path) == 3
    assert sinks.read_table(spark, path).columns == ["id", "k"]


def test_saved_partitions_keep_types_and_nulls(spark, tmp_dir):
    df = spark.createDataFrame([(1, "01", 2.5), (2, None, None), (None, "x/y=z", 0.0)], "k int, part string, v double")
    back = sinks.save_table(df, f"{tmp_dir}/parts", ["part"])
    assert back.schema.simpleString() == df.schema.simpleString()
    assert sorted(back.collect(), key=str) == sorted(df.collect(), key=str)


def test_metric_log_appends(spark, tmp_dir):
    path = f"{tmp_dir}/metrics"
    sinks.log_metrics(spark, path, "rec", "V1", {"AUC": 0.812345, "F1": 0.5})
    out = sinks.log_metrics(spark, path, "rec", "V1", {"Recall": 1 / 3})
    assert rows(out, "metric", "value") == [("AUC", 0.8123), ("F1", 0.5), ("Recall", 0.3333)]
    for _ in range(2):   # a repeated run adds nothing, a new metric of the run is added
        out = sinks.log_metrics(spark, path, "rec", "V2", {"AUC": 0.9}, run_id="r")
    assert out.count() == 4
    assert sinks.log_metrics(spark, path, "rec", "V2", {"AUC": 0.9, "F1": None}, run_id="r").count() == 5
    assert sinks.log_metrics(spark, path, "rec", "V3", {"AUC": 0.9}, run_id="r").count() == 6


def test_recommendations_written_with_arrays(spark, tmp_dir):
    import __spark_entry__ as entry
    from menurec.operators import recommend
    ctx = Context(spark, SF_SMALL)
    recs = recommend.recommendations(ctx.scored, ctx.interactions)
    back = sinks.write_recommendations(recs, f"{tmp_dir}/recs")
    assert back.count() == entry.entry(spark).count()
    assert dict(back.dtypes)["menu_item_name"] == "array<string>"


def _write_csv(path, lines):
    with open(path, "w") as f:
        f.write("LOCATION_ID,PLACEKEY,LOCATION,CITY,REGION,ISO,COUNTRY\n")
        f.write("\n".join(lines) + "\n")


def test_csv_table_load(spark, tmp_dir):
    src = f"{tmp_dir}/src"
    os.makedirs(src)
    _write_csv(f"{src}/a.csv", ['1,pk,"Main St, 1",Paris,IDF,FR,France', "2,NULL,,Lyon,null,FR,France"])
    t = load_csv_table(spark, src, schemas.LOCATION, f"{tmp_dir}/bulk")
    assert rows(t, "location_id", "placekey", "location") == [
        (1, "pk", "Main St, 1"), (2, None, None)]


def test_parameterised_sql_source(spark):
    from menurec.sources.sql import run_sql
    ctx = Context(spark, SF_SMALL)
    out = run_sql(spark, "SELECT DISTINCT city FROM {customer_features} "
                         "WHERE array_contains(:countries, country) ORDER BY city",
                  {"customer_features": ctx.customers}, {"countries": ["AMERICA", "O'Brien"]})
    from menurec.operators.audience import filter_options
    want = filter_options(ctx.customers, ctx.all_items, ["AMERICA"])["city"]
    assert [r.city for r in out.collect()] == [r.city for r in want.collect()]


def test_app_flow_end_to_end(spark, tmp_dir):
    import numpy as np
    from menurec.operators import split
    from menurec.operators.dlrm import DLRMConfig, dlrm_train, load_weights
    from menurec.operators.serving import recommend_audience
    ctx = Context(spark, SF_SMALL)
    st = Preprocessor().fit(ctx.train_dataset)
    cfg = DLRMConfig(num_embeddings=st.num_embeddings() + 1, embed_dim=8, bottom=(16, 8),
                     top=(16, 16), epochs=1)
    train = st.transform(ctx.train_dataset)
    res = dlrm_train(train, None, cfg, null_codes="reserve",
                     save_best=f"{tmp_dir}/best")
    saved = load_weights(spark, f"{tmp_dir}/best")
    assert all(np.array_equal(saved[k], res.params[k]) for k in res.params)
    aud = ctx.audience(countries=["AMERICA"], only_not_ordered=True, limit=None)
    recs = recommend_audience(aud, ctx.interactions, st, res.params, cfg,
                              null_codes="reserve", partitions=2)
    n_customers = aud.select("customer_id").distinct().count()
    got = recs.collect()
    assert len(got) == n_customers
    assert all(1 <= len(r.menu_item_name) for r in got)
    from menurec.operators.serving import evaluate_sample
    test = ctx.dataset.filter(split.split_index(["customer_id", "menu_item_name"]) == 2)
    metrics = evaluate_sample(test, st, res.params, cfg, n=100, null_codes="reserve")
    assert 0.0 <= metrics["AUC"] <= 1.0 and set(metrics) == {"AUC", "Precision", "Recall", "F1_Score"}
    logged = sinks.log_metrics(spark, f"{tmp_dir}/metrics", "menu_recommender", "V1", metrics)
    assert logged.count() == 4


def test_published_load_is_reattached(spark, tmp_dir):
    """A second session finds the published load and re-registers the
    bucketed fact tables from their files (external tables)."""
    from menurec.sources import load
    target = f"{tmp_dir}/domain"
    first = load.load_domain(spark, SF_SMALL, target=target, buckets=4)
    n_lines = first.order_detail.count()
    load._LOADED.clear()
    for t in [r.name for r in spark.catalog.listTables() if r.name.startswith("menurec_")]:
        spark.sql(f"DROP TABLE IF EXISTS {t}")   # external: files stay
    again = load.load_domain(spark, SF_SMALL, target=target)
    assert again.order_detail.count() == n_lines
    plan = again.order_detail.join(again.order_header, "order_id")._jdf.queryExecution() \
        .executedPlan().toString()
    assert "Exchange hashpartitioning(order_id" not in plan


def test_only_fitted_parts_are_written(spark, monkeypatch):
    """The rows of a split part that a query fits or trains on are written, not
    the whole dataset; the parts hold what the dataset holds of them."""
    from menurec.operators.feature_store import PART, write_parts
    from menurec.plans import queries
    wrote = []

    def seen(df, path, part=None):
        write_parts(df, path, part)
        wrote.append(sorted(r[0] for r in df.sparkSession.read.parquet(path).select(PART).distinct().collect()))

    monkeypatch.setattr(queries, "write_parts", seen)
    for name in ("encoder_file", "dlrm_forward", "dlrm_loss"):
        queries.QUERIES[name](spark, SF_SMALL)
    assert wrote == [[0], [0], [0, 1]]
    ctx = Context(spark, SF_SMALL)
    whole, part = ctx.dataset, ctx.part_table(0)
    assert part.dtypes == whole.dtypes
    assert rows(part.select(*[F.col(c).cast("string") for c in part.columns]).na.fill("")) == rows(
        ctx.train_dataset.select(*[F.col(c).cast("string") for c in part.columns]).na.fill(""))


def test_dataset_writes_keep_its_files_open(spark, tmp_dir):
    from menurec.operators import feature_store
    files = "spark.sql.maxConcurrentOutputFileWriters"
    before, seen = spark.conf.get(files), []

    class Rows:
        sparkSession = spark

        def withColumn(self, *_):
            return self

        def __getattr__(self, _):
            return self

        def __call__(self, *_):
            seen.append(spark.conf.get(files))
            return self

    feature_store.write_parts(Rows(), tmp_dir, F.lit(1))
    assert set(seen) == {str(feature_store.OPEN_PARTS)} and spark.conf.get(files) == before
