"""Registered queries of the numbered operators: thin digests of their results."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from menurec.llm import (bwt_dedup, byte_cnn, cover_tree, decontaminate, divergence, licenses, mixing, phrase_automata, recurrent_lm, secret_scan,
                         simhash, toxicity, va_file)
from menurec.llm.common import crc_class, table
from menurec.session import ship_package


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_by_source(table(spark, sf_dir, "documents"))


def op2_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return va_file.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op3_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = crc_class("doc_id", 7) == 2
    scored = recurrent_lm.train_and_score(table(spark, sf_dir, "documents"), ~held_out)
    return scored.withColumn("held_out", held_out)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held_out = table(spark, sf_dir, "documents"), crc_class("doc_id", 4) == 2
    model = byte_cnn.fit(docs, table(spark, sf_dir, "labels"), ~held_out)
    return (byte_cnn.score(docs, model)
            .select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted")))


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.secrets(table(spark, sf_dir, "documents"))
    of_kind = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("bigint")
    return found.select("doc_id", of_kind(0).alias("n_assign"), of_kind(1).alias("n_access"), of_kind(2).alias("n_hex"),
                        F.sha2(secret_scan.span_text("base"), 256).alias("base_sha256"), secret_scan.span_text("spans").alias("spans"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bwt_dedup.dedup(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held_out = table(spark, sf_dir, "documents"), crc_class("doc_id", 5) == 0
    lexicon = toxicity.learn(docs, table(spark, sf_dir, "labels"), ~held_out)
    return (toxicity.score(docs, lexicon)
            .select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    path = F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string"))
    return licenses.scan(docs, path)


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return cover_tree.hard_negatives(table(spark, sf_dir, "embeddings").withColumn("label", moved), F.col("vec_id") % 100 == 0)


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


def op13_phrase_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrase_automata.dedup(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def _shipped(query):
    @wraps(query)
    def run(spark, sf_dir):
        ship_package(spark)
        return query(spark, sf_dir)

    return run


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: _shipped(f) for f in (op1_mixing, op2_topk, op3_lm_score, op4_quality, op5_secrets, op6_substring_dedup, op7_toxicity,
                            op8_decontaminate, op9_simhash, op10_licenses, op11_hard_negatives, op12_divergence, op13_phrase_dedup, pipeline)}
