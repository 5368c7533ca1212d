"""Calendar-boundary date differences.

``TIMESTAMPDIFF(unit, a, b)`` in the source warehouse counts unit boundaries
crossed between ``a`` and ``b`` (Jan 31 -> Feb 1 is one month), unlike
Spark's ``timestampdiff``, which counts whole elapsed units.  Weeks start on
Monday.  All three are plain column arithmetic, so they stay inside
whole-stage code generation.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def years_between(start, end) -> Column:
    """Year boundaries crossed from ``start`` to ``end``."""
    return (F.year(_c(end)) - F.year(_c(start))).cast("long")


def months_between_boundaries(start, end) -> Column:
    """Month boundaries crossed from ``start`` to ``end``."""
    s, e = _c(start), _c(end)
    return ((F.year(e) * 12 + F.month(e)) - (F.year(s) * 12 + F.month(s))).cast("long")


def weeks_between(start, end) -> Column:
    """Monday-week boundaries crossed from ``start`` to ``end``."""
    s, e = F.to_date(_c(start)), F.to_date(_c(end))
    days = F.datediff(F.date_trunc("week", e).cast("date"),
                      F.date_trunc("week", s).cast("date"))
    return F.floor(days / 7).cast("long")


def age_in_years(birthday, as_of=None) -> Column:
    """``DATEDIFF(YEAR, birthday, as_of)``: year boundaries, birthday-unaware.

    ``as_of`` defaults to ``current_date()``; pass a fixed date for
    reproducible results.
    """
    ref = F.current_date() if as_of is None else F.lit(as_of).cast("date")
    return years_between(birthday, ref)
