"""Ranking and classification metrics as aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from menurec.functions.prefix import prefix_sums


def roc_auc(df: DataFrame, label: str = "purchased", score: str = "prediction") -> DataFrame:
    """Exact ROC AUC with ties counted half (Mann-Whitney), one row ``auc``.

    Rows are first grouped by score (partial aggregation), then the number of
    negatives below each score comes from :func:`prefix_sums`, which runs in
    parallel.  The numerator ``sum(pos * (2 * neg_below + neg))`` is an exact
    integer, so the result is a single division; NULL when only one class is
    present.  Labels other than 0 and 1 are ignored.
    """
    by_score = df.filter(F.col(score).isNotNull()).groupBy(
        F.col(score).alias("score")).agg(
        F.sum((F.col(label) == 1).cast("long")).alias("pos"),
        F.sum((F.col(label) == 0).cast("long")).alias("neg"))
    ranked = prefix_sums(by_score, "score", ["neg"])
    agg = ranked.agg(
        F.sum(F.col("pos").cast("decimal(38,0)")
              * (F.col("neg_before") * 2 + F.col("neg"))).alias("num"),
        F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    denom = F.col("p").cast("double") * F.col("n").cast("double") * 2.0
    return agg.select(
        F.when(denom > 0, F.col("num").cast("double") / denom).alias("auc"))


def binary_metrics(df: DataFrame, label: str = "purchased", score: str = "prediction",
                   threshold: float = 0.5) -> DataFrame:
    """Confusion counts, precision, recall and F1 at ``score >= threshold``.

    One aggregation (partial sums before a single-row merge).  Divisions by
    zero give 0, as the source's F1 guard does.
    """
    pred = (F.col(score) >= F.lit(threshold)).cast("int")
    y = F.col(label)
    agg = df.agg(
        F.sum(((y == 1) & (pred == 1)).cast("long")).alias("tp"),
        F.sum(((y == 0) & (pred == 1)).cast("long")).alias("fp"),
        F.sum(((y == 1) & (pred == 0)).cast("long")).alias("fn"),
        F.sum(((y == 0) & (pred == 0)).cast("long")).alias("tn"))
    c = {k: F.coalesce(F.col(k), F.lit(0)) for k in ("tp", "fp", "fn", "tn")}
    precision = F.when(c["tp"] + c["fp"] > 0,
                       c["tp"].cast("double") / (c["tp"] + c["fp"]).cast("double")
                       ).otherwise(F.lit(0.0))
    recall = F.when(c["tp"] + c["fn"] > 0,
                    c["tp"].cast("double") / (c["tp"] + c["fn"]).cast("double")
                    ).otherwise(F.lit(0.0))
    out = agg.select(*[c[k].alias(k) for k in ("tp", "fp", "fn", "tn")],
                     precision.alias("precision"), recall.alias("recall"))
    f1 = F.when(F.col("precision") + F.col("recall") > 0,
                F.col("precision") * F.col("recall") * 2.0
                / (F.col("precision") + F.col("recall"))).otherwise(F.lit(0.0))
    return out.withColumn("f1", f1)
