"""Helpers shared by the operators of this package."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from menurec.session import checkpoint_dir

# Words are runs of anything but ASCII white space.  On bytes this is exactly
# ``bytes.split()``, and ``bytes.lower()`` lower-cases A-Z alone.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


def materialised(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw_texts(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    """The texts of an Arrow batch as UTF-8 bytes; a null text is empty."""
    return [t or b"" for t in batch.column(name).cast(pa.binary()).to_pylist()]


def row_key(*cols: str) -> Column:
    """64-bit content hash that identifies a row (nulls allowed)."""
    return F.xxhash64(*cols)


def n_words(text: str = "text") -> Column:
    """Words of a text; a null text has none."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD_PATTERN)).cast("bigint"), F.lit(0).cast("bigint"))


def crc_class(doc_id: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus`` (a null id counts as '')."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % modulus


def labelled_sample(documents: DataFrame, labels: DataFrame, target: str,
                    per_class: int, allowed: Column, seed: int = 7) -> DataFrame:
    """A bounded sample of labelled documents: (doc_id, text, label).

    ``allowed`` is a condition on ``doc_id``.  Of each class about
    ``per_class`` labelled ids are drawn by hash (a counted threshold, then an
    exact cut), so the broadcast id list holds at most ``2 * per_class`` rows
    and only the drawn documents leave the scan.  Ids that are null, or
    labelled twice with different labels, take no part.
    """
    known = (labels.select("doc_id", F.col(target).cast("int").alias("label"))
             .filter(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1)).filter(allowed)
             .groupBy("doc_id").agg(F.min("label").alias("label"), F.max("label").alias("other"))
             .filter("label = other").drop("other")
             .withColumn("draw", F.xxhash64("doc_id", F.lit(seed))))
    sizes = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    drawn = None
    for label in (0, 1):
        n = sizes.get(label, 0)
        share = min(1.0, 1.2 * per_class / n) if n else 0.0
        cut = int(-(2 ** 63) + share * (2 ** 64 - 1))
        part = (known.filter((F.col("label") == label) & (F.col("draw") <= F.lit(min(cut, 2 ** 63 - 1))))
                .orderBy("draw", "doc_id").limit(per_class).select("doc_id", "label"))
        drawn = part if drawn is None else drawn.unionByName(part)
    ids = materialised(drawn)
    return documents.select("doc_id", "text").join(F.broadcast(ids), "doc_id")


def label_rate(labels: DataFrame, target: str, allowed: Column) -> float:
    """Share of label 1 over all labelled rows that ``allowed`` admits (0.5 without any)."""
    got = (labels.select("doc_id", F.col(target).cast("double").alias("label")).filter(allowed)
           .filter(F.col("label").isin(0.0, 1.0)).agg(F.sum("label").alias("ones"), F.count("*").alias("n")).first())
    return (got["ones"] + 1.0) / (got["n"] + 2.0) if got["n"] else 0.5
