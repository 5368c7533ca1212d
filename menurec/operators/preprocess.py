"""Label encoding and min-max scaling, fitted and applied as Spark jobs.

Label encoder: the classes of a column are its distinct non-NULL values,
sorted (as text); a value's code is its position.  Fitting scans the data
once, unpivots the categorical columns into (feature, value) pairs,
de-duplicates them with partial aggregation, and numbers each feature's
values with :func:`menurec.functions.prefix.prefix_sums` -- no feature's
vocabulary has to fit in one task.  Applying is a left join per feature on
the (feature, value, code) table: an unseen value or a NULL gets a NULL code.

Min-max scaler: ``x * scale + offset`` with ``scale = 1 / (max - min)`` (1 for
a constant column, so it maps to 0) and ``offset = -min * scale``, the same
arithmetic as the scikit-learn style scaler the source uses.  Fitting is one
aggregation; the fitted state is two numbers per column.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from menurec.functions.prefix import prefix_sums
from menurec.plans.joins import left_join_spread_nulls
from menurec.schemas import DENSE_FEATURES, KEEP_WITH_CODES, SPARSE_FEATURES
from menurec.session import checkpoint_dir

ENCODED_SUFFIX = "_encoded"
MAX_BROADCAST_BYTES = 32 << 20    # a feature's encoder rows are broadcast up to this
CLASSES_A_LINE = 10_000
CLASSES = "map<string, struct<input_cols: array<string>, output_cols: array<string>, start: bigint, classes_: array<string>>>"
ENTRY_BYTES = 32                  # of an encoder row beside its text


def _fit_statistics(df: DataFrame, categorical: Sequence[str],
                    numeric: Sequence[str]) -> DataFrame:
    """One pass over ``df``: distinct values of every categorical column and
    min/max of every numeric one, as ``(feature, value, lo, hi)`` rows.

    Each input row is unpivoted into one entry per column; the grouping on
    (feature, value) aggregates map-side first, so a shuffle carries at most
    one row per distinct value (plus one per numeric column) per task.
    """
    entries = [F.struct(F.lit(c).alias("feature"), F.col(c).cast("string").alias("value"),
                        F.lit(None).cast("double").alias("num")) for c in categorical]
    entries += [F.struct(F.lit(c).alias("feature"), F.lit(None).cast("string").alias("value"),
                         F.col(c).cast("double").alias("num")) for c in numeric]
    unpivoted = df.select(F.explode(F.array(*entries)).alias("e")).select("e.*")
    return unpivoted.groupBy("feature", "value").agg(
        F.min("num").alias("lo"), F.max("num").alias("hi"))


def _number_values(stats: DataFrame, categorical: Sequence[str]) -> DataFrame:
    """Codes from the distinct values: position in sorted order per feature."""
    distinct = stats.filter(F.col("feature").isin(list(categorical))
                            & F.col("value").isNotNull()).select(
        "feature", "value", F.lit(1).cast("long").alias("one"))
    # ``stats`` is checkpointed by every caller: no second materialisation.
    coded = prefix_sums(distinct, "value", ["one"], groups=["feature"], materialize=False)
    return coded.select("feature", "value", F.col("one_before").alias("code"))


def fit_label_encoders(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``(feature, value, code)`` for every distinct non-NULL value."""
    checkpoint_dir(df.sparkSession)
    stats = _fit_statistics(df, columns, []).checkpoint(eager=True)
    return _number_values(stats, columns)


def apply_label_encoders(df: DataFrame, encoders: DataFrame, columns: Sequence[str],
                         in_place: bool = False,
                         keep: Sequence[str] = KEEP_WITH_CODES) -> DataFrame:
    """Add ``<col>_encoded`` codes (or replace the column when ``in_place``).

    Without ``in_place`` the inputs are dropped except those in ``keep``, as
    the app does.  Values are compared as text.  The encoder table (a
    checkpoint or saved table, so the planner cannot estimate its size) is
    measured once, per feature: a vocabulary of at most
    ``MAX_BROADCAST_BYTES`` is broadcast, a larger one is joined by shuffle
    with its NULLs spread (so one large vocabulary shuffles the rows once and
    the small ones still don't).
    """
    sizes = {r["feature"]: r["bytes"] for r in encoders.groupBy("feature").agg(
        F.sum(F.octet_length("value") + ENTRY_BYTES).alias("bytes"))
        .filter(F.col("feature").isin(list(columns))).collect()}
    out = df
    for c in columns:
        tmp_v = f"__v_{c}"
        e = encoders.filter(F.col("feature") == F.lit(c)).select(
            F.col("value").alias(tmp_v), F.col("code").alias(f"__code_{c}"))
        if sizes.get(c, 0) <= MAX_BROADCAST_BYTES:
            out = out.join(F.broadcast(e), out[c].cast("string") == e[tmp_v], "left").drop(tmp_v)
        else:
            key = f"__k_{c}"
            out = left_join_spread_nulls(
                out.withColumn(key, F.col(c).cast("string")), e, key, tmp_v,
                salt_cols=[k for k in df.columns if k != c]).drop(key, tmp_v)
    if in_place:
        return out.select(*[F.col(f"__code_{c}").alias(c) if c in columns else F.col(c)
                            for c in df.columns])
    kept = [c for c in df.columns if c not in columns or c in keep]
    return out.select(*kept, *[F.col(f"__code_{c}").alias(c + ENCODED_SUFFIX)
                               for c in columns])


def fit_min_max(df: DataFrame, columns: Sequence[str]) -> dict[str, tuple]:
    """``{column: (min, max)}`` from one aggregation (NULLs ignored)."""
    aggs = []
    for c in columns:
        x = F.col(c).cast("double")
        aggs += [F.min(x).alias(f"min_{c}"), F.max(x).alias(f"max_{c}")]
    row = df.agg(*aggs).first()
    return {c: (row[f"min_{c}"], row[f"max_{c}"]) for c in columns}


def min_max_column(c: str, lo, hi):
    """Scaled column; NULL in, NULL out."""
    if lo is None or hi is None:
        return F.lit(None).cast("double")
    rng = hi - lo
    scale = 1.0 / (rng if rng != 0 else 1.0)
    offset = 0.0 - lo * scale
    return F.col(c).cast("double") * F.lit(scale) + F.lit(offset)


def apply_min_max(df: DataFrame, ranges: dict[str, tuple]) -> DataFrame:
    return df.withColumns({c: min_max_column(c, lo, hi) for c, (lo, hi) in ranges.items()})


@dataclass
class PreprocessState:
    """Fitted encoders (a DataFrame, checkpointed) and min/max per column."""
    encoders: DataFrame
    ranges: dict[str, tuple]
    categorical: list[str] = field(default_factory=lambda: list(SPARSE_FEATURES))
    numeric: list[str] = field(default_factory=lambda: list(DENSE_FEATURES))

    def transform(self, df: DataFrame, in_place: bool = True) -> DataFrame:
        """Encode and scale; ``in_place`` keeps column names (training
        layout), otherwise adds ``_encoded`` columns (scoring layout)."""
        out = apply_label_encoders(df, self.encoders, self.categorical, in_place=in_place)
        return apply_min_max(out, self.ranges)

    def num_embeddings(self) -> int:
        """Rows the shared embedding table needs: 1 + the largest code."""
        mx = self.encoders.agg(F.max("code")).first()[0]
        return int(mx) + 1 if mx is not None else 1

    # -- persistence -------------------------------------------------------
    def save(self, path: str) -> None:
        """Write ``<path>/encoders`` (parquet) and ``<path>/scaler.json``."""
        self.encoders.write.mode("overwrite").parquet(f"{path}/encoders")
        spark = self.encoders.sparkSession
        meta = {"categorical": self.categorical, "numeric": self.numeric,
                "ranges": {k: list(v) for k, v in self.ranges.items()}}
        spark.createDataFrame([(json.dumps(meta),)], "state string").coalesce(1) \
            .write.mode("overwrite").text(f"{path}/scaler")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> PreprocessState:
        meta = json.loads(spark.read.text(f"{path}/scaler").first()[0])
        return cls(encoders=spark.read.parquet(f"{path}/encoders"),
                   ranges={k: tuple(v) for k, v in meta["ranges"].items()},
                   categorical=meta["categorical"], numeric=meta["numeric"])

    def export_classes_json(self, path: str, chunk: int = CLASSES_A_LINE) -> None:
        """Write the encoder classes in the source's layout, JSON objects keyed
        by feature: ``{feature: {input_cols, output_cols, classes_}}``.  A line
        holds up to ``chunk`` classes, so no task holds a whole vocabulary; a
        later part of a feature says the code that it ``start``s with."""
        start = F.floor(F.col("code") / chunk) * chunk
        parts = self.encoders.groupBy("feature", start.alias("start")).agg(
            F.transform(F.array_sort(F.collect_list(F.struct("code", "value"))),
                        lambda s: s["value"]).alias("classes_"))
        body = F.struct(
            F.array("feature").alias("input_cols"),
            F.array(F.concat("feature", F.lit(ENCODED_SUFFIX))).alias("output_cols"),
            F.when(F.col("start") > 0, F.col("start")).alias("start"), "classes_")
        parts.select(F.to_json(F.create_map("feature", body)).alias("value")).write.mode("overwrite").text(path)


class Preprocessor:
    """Label-encode ``categorical`` and min-max scale ``numeric`` columns."""

    def __init__(self, categorical: Sequence[str] = SPARSE_FEATURES,
                 numeric: Sequence[str] = DENSE_FEATURES):
        self.categorical = list(categorical)
        self.numeric = list(numeric)

    def fit(self, df: DataFrame) -> PreprocessState:
        """Fit from one scan of ``df``; the small statistics table is
        checkpointed so numbering the values does not read ``df`` again."""
        checkpoint_dir(df.sparkSession)
        stats = _fit_statistics(df, self.categorical, self.numeric).checkpoint(eager=True)
        encoders = _number_values(stats, self.categorical).checkpoint(eager=True)
        ranges = {c: (None, None) for c in self.numeric}
        for r in stats.filter(F.col("feature").isin(self.numeric)).collect():
            ranges[r["feature"]] = (r["lo"], r["hi"])
        return PreprocessState(encoders, ranges, self.categorical, self.numeric)


def read_classes_json(spark: SparkSession, path: str) -> DataFrame:
    """Read encoder classes back as ``(feature, value, code)``: a class's code is
    its position.  Takes one object with all features on a line (the source's
    file) as well as the parts of :meth:`PreprocessState.export_classes_json`;
    a line that is no such object is an error."""
    body = F.from_json("value", CLASSES, {"mode": "FAILFAST"})
    objects = spark.read.text(path).filter(F.trim("value") != "").select(F.explode(body).alias("feature", "of"))
    return objects.select("feature", F.coalesce("of.start", F.lit(0)).alias("start"),
                          F.posexplode("of.classes_").alias("place", "value")).select(
        "feature", "value", (F.col("start") + F.col("place")).alias("code"))
