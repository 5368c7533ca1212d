"""CSV bulk load with a manifest, and the incremental load's ledger."""

import os

import pytest
from pyspark.sql import functions as F

from conftest import rows
from menurec import schemas
from menurec.sources.bulk_load import bulk_load, loaded_tables, manifests
from menurec.sources.csv import read_csv
from menurec.streaming import incremental_load as inc

HEAD = "LOCATION_ID,PLACEKEY,LOCATION,CITY,REGION,ISO,COUNTRY\n"
TWO = {"location": schemas.LOCATION, "order_header": schemas.ORDER_HEADER}


def put(path, *lines):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as f:
        f.write(HEAD + "\n".join(lines) + "\n")


def put_orders(path, ids):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as f:
        f.write(",".join(schemas.ORDER_HEADER.fieldNames()) + "\n")
        for i in ids:
            f.write(f"{i},1,2.0,NULL,,null,,,,,,,,,12.5,2024-01-31 10:00:00\n")


def test_line_breaks_only_where_they_are(spark, tmp_dir):
    put(f"{tmp_dir}/a.csv", '1,pk,"Main ""St"", 1",Paris,,FR,NULL')
    put(f"{tmp_dir}/deep/b.csv", '2,pk,"one\ntwo ""q""\n\nthree",null,,FR,France', "3,,,,,,")
    got = read_csv(spark, tmp_dir, schemas.LOCATION, recursive=True, multiline=None)
    assert rows(got, "location_id", "location", "city", "country") == [
        (1, 'Main "St", 1', "Paris", None), (2, 'one\ntwo "q"\n\nthree', None, "France"), (3, None, None, None)]
    with pytest.raises(Exception):
        read_csv(spark, tmp_dir, schemas.LOCATION, recursive=True).collect()


def test_bulk_load_publishes_whole_loads(spark, tmp_dir):
    stage, target = f"{tmp_dir}/stage", f"{tmp_dir}/tables"
    put(f"{stage}/location/x.csv", '1,pk,"a\nb",Paris,,FR,France', "2,,,,,,")
    put_orders(f"{stage}/order_header/x.csv", range(500))
    put_orders(f"{stage}/order_header/more/y.csv", range(500, 900))
    size = sum(os.path.getsize(f"{stage}/order_header/{f}") for f in ("x.csv", "more/y.csv"))
    first = bulk_load(spark, stage, target, TWO, bucket_bytes=4096)
    assert rows(first, "table_name", "files", "rows", "buckets") == [("location", 1, 2, 0), ("order_header", 2, 900, -(-size // 4096))]
    held = loaded_tables(spark, target, TWO)
    assert held["order_header"].schema == schemas.ORDER_HEADER
    assert held["order_header"].agg(F.sum("order_id"), F.count("customer_id")).first() == (sum(range(900)), 0)
    # a load that fails is not published: readers keep the one before
    put(f"{stage}/location/bad.csv", "not a number,,,,,,")
    with pytest.raises(Exception):
        bulk_load(spark, stage, target, TWO)
    assert manifests(spark, target).count() == 2 and loaded_tables(spark, target, TWO)["location"].count() == 2
    put(f"{stage}/location/bad.csv", "7,,,,,,")
    second = bulk_load(spark, stage, target, TWO)
    assert rows(second, "table_name", "load_no", "rows", "buckets") == [("location", 2, 3, 0), ("order_header", 2, 900, 1)]
    assert loaded_tables(spark, target, TWO)["location"].count() == 3
    with pytest.raises(FileNotFoundError):
        bulk_load(spark, stage, target)


def ids(spark, target):
    return sorted(r.location_id for r in inc.loaded_rows(spark, target, schemas.LOCATION).collect())


def test_ledger(spark, tmp_dir, monkeypatch):
    source, target = f"{tmp_dir}/src", f"{tmp_dir}/t"
    os.makedirs(source)
    assert ids(spark, target) == []
    put(f"{source}/a.csv", "1,,,,,,", "1,,,,,,")
    put(f"{source}/sub/b.csv", '2,,"x\ny",,,,')
    run = lambda ckpt, **kw: inc.load_csv_incremental(spark, source, schemas.LOCATION, target, f"{tmp_dir}/{ckpt}", **kw)
    run("one")
    run("one")
    assert ids(spark, target) == [1, 1, 2]
    run("two")                                              # the checkpoint is lost: all files are met again
    assert ids(spark, target) == [1, 1, 2] and inc.ledger(spark, target).count() == 2
    # a batch that fails before its ledger entry leaves rows that nobody reads
    put(f"{source}/c.csv", "3,,,,,,")
    with monkeypatch.context() as m:
        m.setattr(inc, "LEDGER", "no such type at all")
        with pytest.raises(Exception):
            inc.load_batch(spark.createDataFrame([(f"file:{source}/c.csv", 1, "h"), (f"file:{source}/c.csv", 1, "3,,,,,,")],
                                                 "path string, size long, value string"), schemas.LOCATION, target)
    assert ids(spark, target) == [1, 1, 2]
    run("one")
    assert ids(spark, target) == [1, 1, 2, 3]
    # other content under the same name is a new file; one file a batch gives a load each
    put(f"{source}/a.csv", "4,,,,,,")
    put(f"{source}/d.csv", "5,,,,,,")
    run("three", max_files_per_trigger=1)
    assert ids(spark, target) == [1, 1, 2, 3, 4, 5]
    assert rows(inc.ledger(spark, target).groupBy("load_no").agg(F.count("*").alias("n")), "load_no", "n") == [(1, 2), (2, 1), (3, 1), (4, 1)]
    with pytest.raises(Exception):                          # a row that does not fit stops the load
        put(f"{source}/e.csv", "x,,,,,,")
        run("one")
    assert ids(spark, target) == [1, 1, 2, 3, 4, 5]


def test_checksum_is_free_of_order_and_sees_repeats(spark):
    def of(lines):
        df = spark.createDataFrame([("f", 1, v) for v in lines], "path string, size long, value string")
        return inc.described(df.repartition(3)).first()["checksum"]
    assert of(["a", "b", "c"]) == of(["c", "a", "b"])
    assert len({of(x) for x in (["a"], ["a", "a", "a"], ["a", "b", "b"], ["a", "c", "c"], ["b"])}) == 5


def test_staged_parts_are_not_sorted(spark, tmp_dir, monkeypatch):
    """Each staged part is one file, written by a task of its own that keeps it
    open instead of sorting its rows by part."""
    from menurec.plans import warehouse
    write, kept = warehouse.write_csv, []
    files = "spark.sql.maxConcurrentOutputFileWriters"

    def seen(df, path, by=None):
        sizes = df.groupBy(F.spark_partition_id().alias("p")).agg(F.countDistinct("part").alias("n")).collect()
        kept.append((spark.conf.get(files), max(r["n"] for r in sizes)))
        write(df, path, by)

    monkeypatch.setattr(warehouse, "write_csv", seen)
    before = spark.conf.get(files)
    got = rows(warehouse.q_incremental_load(spark, "/root/testdata/sf0.001"), "load_no", "files")
    assert got == [(1, 3), (2, 1)]
    assert kept == [(str(warehouse.FILES), 1)] * 2 and spark.conf.get(files) == before
