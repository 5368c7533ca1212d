"""Registered queries of the load, store and sink operators.

The sources of these jobs are staged files or spines that the driver's tables do
not have as such.  ``stage_*`` only writes the domain tables in the form the job
expects (CSV text with the source's NULL markers and quoting); the job itself
runs on that input through the library's own code.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from menurec import schemas
from menurec.operators import features, harmonize
from menurec.operators.feature_store import Entity, FeatureStore, MergeableView
from menurec.session import checkpoint_dir, open_files
from menurec.sources import adapter
from menurec.sources.bulk_load import bulk_load, loaded_tables
from menurec.sources.csv import NULL_MARKERS
from menurec.sources.load import load_domain
from menurec.streaming.incremental_load import ledger, load_csv_incremental, loaded_rows

FILES = 4   # staged files of the incremental load


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder below the shared folder."""
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def as_text(df: DataFrame) -> DataFrame:
    """Every column as text; a NULL becomes one of the source's markers."""
    marker = F.element_at(F.array(*[F.lit(m) for m in NULL_MARKERS]),
                          F.pmod(F.hash(*df.columns), F.lit(len(NULL_MARKERS))) + 1)
    return df.select(*[F.coalesce(F.col(c).cast("string"), marker).alias(c) for c in df.columns])


def write_csv(df: DataFrame, path: str, by: str | None = None) -> None:
    writer = df.write.mode("append").options(header="true", quote='"', escape='"', emptyValue="")
    (writer.partitionBy(by) if by else writer).csv(path)


def stage_tables(spark: SparkSession, base: str, path: str) -> None:
    """The eight raw tables as CSV folders; a location's text holds a line
    break and quotes."""
    tables = load_domain(spark, base)
    for name in schemas.RAW_TABLES:
        df = getattr(tables, name)
        if name == "location":
            df = df.withColumn("location", F.concat("city", F.lit('\n"'), "country", F.lit('"')))
        write_csv(as_text(df), f"{path}/{name}")


def digest(name: str, df: DataFrame) -> DataFrame:
    """One row: rows, NULLs, characters of text, sum of numbers, sum of days."""
    def total(cols, kind):
        parts = [F.coalesce(F.sum(c), F.lit(0)).cast(kind) for c in cols]
        return reduce(lambda a, b: a + b, parts) if parts else F.lit(0).cast(kind)

    fields = df.schema.fields
    text = [f.name for f in fields if isinstance(f.dataType, T.StringType)]
    days = [f.name for f in fields if isinstance(f.dataType, (T.DateType, T.TimestampNTZType))]
    numbers = [f.name for f in fields if isinstance(f.dataType, T.NumericType)]
    return df.agg(
        F.count(F.lit(1)).alias("rows"),
        total([F.col(f.name).isNull().cast("long") for f in fields], "long").alias("nulls"),
        total([F.length(c).cast("long") for c in text], "long").alias("chars"),
        total([F.col(c).cast("decimal(28,4)") for c in numbers], "decimal(38,4)").cast("double").alias("numbers"),
        total([F.datediff(F.col(c).cast("date"), F.lit("1970-01-01").cast("date")).cast("long") for c in days],
              "long").alias("days"),
    ).select(F.lit(name).alias("table_name"), "*")


def q_bulk_load(spark, base):
    """Bulk load of the eight tables from CSV: what the manifest counts and what
    the loaded tables hold."""
    folder = scratch(spark, "bulk")
    stage_tables(spark, base, f"{folder}/stage")
    manifest = bulk_load(spark, f"{folder}/stage", f"{folder}/tables")
    tables = loaded_tables(spark, f"{folder}/tables")
    held = reduce(DataFrame.unionByName, [digest(name, df) for name, df in tables.items()])
    return held.join(manifest.select("table_name", F.col("rows").alias("manifest_rows")), "table_name")


def q_incremental_load(spark, base):
    """Order lines staged as files: three are loaded, the load runs again, one
    more file comes and is loaded, and a stream without its checkpoint finds
    nothing new.  Per load of the ledger: its files, and the rows and the
    quantity that readers see of it."""
    folder = scratch(spark, "incremental")
    source, target = f"{folder}/stage", f"{folder}/table"
    lines = as_text(load_domain(spark, base).order_detail).withColumn(
        "part", F.pmod(F.col("order_id").cast("long"), F.lit(FILES)))

    def stage(which):
        # a file per part, streamed: sorting a part's rows would need memory for all of them
        with open_files(spark, FILES):
            write_csv(lines.filter(which).repartitionById(FILES, F.col("part").cast("int")), source, by="part")

    def load(checkpoint):
        load_csv_incremental(spark, source, schemas.ORDER_DETAIL, target, f"{folder}/{checkpoint}")

    stage(F.col("part") < FILES - 1)
    load("stream")
    load("stream")
    stage(F.col("part") == FILES - 1)
    load("stream")
    load("another-stream")
    files = ledger(spark, target).groupBy("load", "load_no").agg(F.count(F.lit(1)).alias("files"))
    rows = loaded_rows(spark, target, schemas.ORDER_DETAIL).groupBy("load").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("quantity").alias("quantity"))
    return files.join(rows, "load").select("load_no", "files", "rows", "quantity")


SPEND = MergeableView(("customer_id",), features.spend_state, features.SPEND_MERGE,
                      lambda state: features.span_averages(features.with_spans(state)))
FIRST_YEARS = "1997-01-01"   # the store is set up with the orders before


def order_lines(tables, which) -> DataFrame:
    """The order-line view of the orders that ``which`` (a condition on the
    order header) admits."""
    return harmonize.orders_v(tables.order_detail, tables.order_header.filter(which), tables.truck, tables.menu,
                              tables.franchise, tables.location, tables.customer_loyalty)


def spend_store(spark, base) -> FeatureStore:
    """A store whose purchase view was registered with the early orders and
    refreshed with the later ones alone (and refreshed again, which changes
    nothing)."""
    tables = load_domain(spark, base)
    store = FeatureStore(spark, scratch(spark, "store"), {"spend": SPEND})
    customer = store.register_entity(Entity("customer", ["customer_id"]))
    early = F.col("order_ts") < F.lit(FIRST_YEARS).cast("timestamp_ntz")
    store.register_mergeable("purchase_features", [customer], "spend", order_lines(tables, early), "V1", upto=1)
    new = order_lines(tables, ~early)
    store.refresh("purchase_features", "V1", new, upto=2)
    store.refresh("purchase_features", "V1", new, upto=2)
    return store


def doubles(df: DataFrame) -> DataFrame:
    """Decimals as doubles, for the comparison with SQL."""
    return df.select(*[F.col(f.name).cast("double") if isinstance(f.dataType, T.DecimalType) else F.col(f.name)
                       for f in df.schema.fields])


def q_refreshed_features(spark, base):
    """The purchase view after a refresh that read only the new orders."""
    return doubles(spend_store(spark, base).get_view("purchase_features", "V1").df)


def q_feature_store(spark, base):
    """A store's life, one row per step: register, get, list, refresh, dataset,
    delete, vacuum; ``rows`` of what the step shows, ``snapshots`` on disk after
    it."""
    tables = load_domain(spark, base)
    store = spend_store(spark, base)
    steps: list[tuple[DataFrame, int]] = []

    def step(name: str, shown: DataFrame) -> None:
        steps.append((shown.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(len(steps) + 1).cast("long").alias("step"),
                      F.lit(name).alias("name"), "rows").checkpoint(), len(store.snapshots())))

    customer = store.get_entity("customer")
    people = features.customer_features(tables.customer_loyalty, adapter.AS_OF)
    step("register view", store.register_view("customer_features", [customer], people.filter("country = 'ASIA'"), "V1").df)
    step("refresh view", store.refresh("customer_features", "V1", people).df)
    step("get view", store.get_view("CUSTOMER_FEATURES", "V1").df)
    step("list views", store.list_views("customer"))
    spine = tables.customer_loyalty.select("customer_id")
    views = [store.get_view(v, "V1") for v in ("customer_features", "purchase_features")]
    step("dataset", store.dataset("people", spine, views, ["birthday_date"], F.pmod("customer_id", F.lit(3))))
    step("part of the dataset", store.get_dataset("people", 1).filter("avg_monthly_purchase_amount is not null"))
    step("vacuum", spark.range(store.vacuum()))
    store.delete_view("purchase_features", "V1")
    step("list views after a delete", store.list_views())
    store.delete_dataset("people")
    store.delete_view("customer_features", "V1")
    store.delete_entity("customer")
    step("list entities after all deletes", store.list_entities())
    step("last vacuum", spark.range(store.vacuum()))
    return reduce(DataFrame.unionByName, [df.withColumn("snapshots", F.lit(n).cast("long")) for df, n in steps])


QUERIES = {
    "refreshed_features": q_refreshed_features,
    "feature_store": q_feature_store,
    "bulk_load": q_bulk_load,
    "incremental_load": q_incremental_load,
}
