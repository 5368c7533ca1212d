"""Exact decimal averages.

Averages divide a ``decimal(18,4)`` sum by a whole number of periods and round
half-up to cents.  The sum is widened to ``decimal(28,4)`` and the divisor
cast to ``decimal(10,0)`` so the quotient keeps 14 decimal places (enough to
round exactly); doubles would round ties differently.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rounded_average(total, periods, scale: int = 2) -> Column:
    """``ROUND(total / periods, scale)`` in decimal arithmetic."""
    t = (F.col(total) if isinstance(total, str) else total).cast("decimal(28,4)")
    n = (F.col(periods) if isinstance(periods, str) else periods).cast("decimal(10,0)")
    return F.round(t / n, scale)
