"""Random inputs: boundary date diffs and decimal averages vs plain Python."""

import datetime as dt
from decimal import ROUND_HALF_UP, Decimal

from hypothesis import given, settings
from hypothesis import strategies as st

from menurec.functions.dates import months_between_boundaries, weeks_between, years_between
from menurec.functions.money import rounded_average

dates = st.dates(min_value=dt.date(1990, 1, 1), max_value=dt.date(2030, 12, 31))


def monday(d):
    return d - dt.timedelta(days=d.weekday())


@settings(max_examples=1, deadline=None)
@given(st.lists(st.tuples(dates, dates), min_size=200, max_size=200))
def test_boundary_counts_match_python(spark, pairs):
    df = spark.createDataFrame(pairs, "a date, b date")
    got = df.select("a", "b", months_between_boundaries("a", "b").alias("m"),
                    weeks_between("a", "b").alias("w"), years_between("a", "b").alias("y")).collect()
    for r in got:
        a, b = r.a, r.b
        assert r.m == (b.year * 12 + b.month) - (a.year * 12 + a.month)
        assert r.y == b.year - a.year
        assert r.w == (monday(b) - monday(a)).days // 7


money = st.decimals(min_value=Decimal("0"), max_value=Decimal("99999999.9999"), places=4)


@settings(max_examples=1, deadline=None)
@given(st.lists(st.tuples(money, st.integers(min_value=1, max_value=5000)),
                min_size=200, max_size=200))
def test_rounded_average_matches_decimal_half_up(spark, rows):
    df = spark.createDataFrame(rows, "t decimal(18,4), n int")
    got = df.select("t", "n", rounded_average("t", "n").alias("avg")).collect()
    for r in got:
        want = (r.t / Decimal(r.n)).quantize(Decimal("0.01"), rounding=ROUND_HALF_UP)
        assert r.avg == want


@settings(max_examples=3, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 1), st.integers(0, 20)), min_size=2, max_size=300))
def test_auc_matches_pairwise_count(spark, data):
    from menurec.operators.evaluate import roc_auc
    pos = [s for y, s in data if y == 1]
    neg = [s for y, s in data if y == 0]
    df = spark.createDataFrame([(y, s / 10.0) for y, s in data], "purchased int, prediction double")
    got = roc_auc(df).first()["auc"]
    if not pos or not neg:
        assert got is None
        return
    wins = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg)
    assert abs(got - wins / (len(pos) * len(neg))) < 1e-12
