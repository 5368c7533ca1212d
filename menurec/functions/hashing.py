"""Deterministic hashes for splits, samples and the stand-in score.

All are built-in expressions (md5, substring, conv), so they run inside
generated code and give the same value on every engine that has md5:
``h(key) = first 8 hex digits of md5(key)`` read as an unsigned integer.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def pair_key(*cols) -> Column:
    """``c1 || '|' || c2 ...`` over the text form of each column.

    One-to-one: ``|`` and ``\\`` in a value are escaped and NULL is ``\\N``, so
    rows with a NULL spread like any others.
    """
    parts = []
    for i, c in enumerate(cols):
        if i:
            parts.append(F.lit("|"))
        text = F.replace(F.replace(_c(c).cast("string"), F.lit("\\"), F.lit("\\\\")), F.lit("|"), F.lit("\\|"))
        parts.append(F.coalesce(text, F.lit("\\N")))
    return F.concat(*parts)


def md5_prefix_int(key) -> Column:
    """First 32 bits of ``md5(key)`` as a non-negative long."""
    return F.conv(F.substring(F.md5(_c(key)), 1, 8), 16, 10).cast("long")


def md5_bucket(key, modulus: int) -> Column:
    """``md5_prefix_int(key) % modulus``."""
    return md5_prefix_int(key) % F.lit(modulus)


def md5_score(key) -> Column:
    """Deterministic score in [0, 1) with ties: ``(h % 1000) / 1000``.

    Stands in for a model's prediction where a reproducible ranking is
    needed (oracle tests, benchmarks).
    """
    return (md5_prefix_int(key) % 1000).cast("double") / F.lit(1000.0)
