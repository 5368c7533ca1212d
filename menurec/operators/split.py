"""Deterministic splits, exact-size samples and capped reads.

The source splits with an unseeded random split and samples with
``sample(n=...)``; both change from run to run.  Here a row's part is a pure
function of its key (a hash bucket), so re-running a job, or re-computing a
lost partition, gives the same rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from menurec.functions.hashing import md5_bucket, md5_prefix_int, pair_key

SPLIT_MODULUS = 10_000
DEFAULT_WEIGHTS = (0.1, 0.1, 0.8)   # train, validation, test as in the source


def split_bounds(weights: Sequence[float], modulus: int = SPLIT_MODULUS) -> list[int]:
    total = float(sum(weights))
    if total <= 0 or any(w < 0 for w in weights):
        raise ValueError("weights must be non-negative with a positive sum")
    bounds, acc = [], 0.0
    for w in weights:
        acc += w
        bounds.append(round(acc / total * modulus))
    bounds[-1] = modulus
    return bounds


def split_index(keys: Sequence[str], weights: Sequence[float] = DEFAULT_WEIGHTS,
                modulus: int = SPLIT_MODULUS):
    """Column with the 0-based part each row falls into."""
    b = md5_bucket(pair_key(*keys), modulus)
    bounds = split_bounds(weights, modulus)
    expr = F.lit(len(bounds) - 1)
    for i in range(len(bounds) - 2, -1, -1):
        expr = F.when(b < bounds[i], F.lit(i)).otherwise(expr)
    return expr


def hash_split(df: DataFrame, keys: Sequence[str],
               weights: Sequence[float] = DEFAULT_WEIGHTS,
               modulus: int = SPLIT_MODULUS) -> list[DataFrame]:
    """Split ``df`` into ``len(weights)`` parts by a hash of ``keys``.

    Each part is a filter of ``df`` (no shuffle); together they partition it,
    and rows with equal keys always land in the same part.
    """
    idx = split_index(keys, weights, modulus)
    return [df.filter(idx == i) for i in range(len(weights))]


def sample_n(df: DataFrame, keys: Sequence[str], n: int, oversample: float = 2.0) -> DataFrame:
    """Exactly ``min(n, count)`` rows: the ``n`` smallest md5 hashes of ``keys``.

    Spark's top-k would merge ``n`` rows of every partition in one task.  Here
    the hash is cut first: md5 is uniform, so after one count the rows whose
    first 32 hash bits lie under an oversampled threshold are taken
    (checkpointed; about ``oversample * n`` rows), checked to be at least ``n``
    (else the threshold doubles), and only those are sorted.  Every row of the
    sample has a hash below any row left out, so the result is exact.  A table
    of at most ``n`` rows is its own sample.
    """
    from menurec.session import checkpoint_dir
    checkpoint_dir(df.sparkSession)
    k = pair_key(*keys)
    total = df.count()
    if total <= n:
        return df
    frac = min(1.0, oversample * n / total)
    while True:
        cut = int(frac * (1 << 32))
        cand = df.filter((md5_prefix_int(k) <= F.lit(cut)) | k.isNull()).checkpoint(eager=True)
        if cand.count() >= n or frac >= 1.0:
            return cand.orderBy(F.md5(k), *keys).limit(n)
        frac = min(1.0, frac * 2)


def capped(df: DataFrame, keys: Sequence[str], n: int) -> DataFrame:
    """Deterministic form of an unordered ``limit(n)`` (the training-row cap)."""
    return sample_n(df, keys, n)
