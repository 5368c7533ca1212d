"""Plan shapes that the scale design relies on (formatted physical plans)."""

import io
import re
from contextlib import redirect_stdout

import pytest

import __spark_entry__ as entry
from conftest import SF_SMALL
from menurec.operators.split import sample_n


def formatted(df):
    buf = io.StringIO()
    with redirect_stdout(buf):
        df.explain("formatted")
    return buf.getvalue()


def plan(spark, key):
    return formatted(entry.queries()[key](spark, SF_SMALL))


def tree(text):
    return text.split("\n\n")[0]


def shuffles(text):
    return len(re.findall(r"\bExchange \(\d+\)", tree(text)))


def test_order_view_needs_no_shuffle(spark):
    p = plan(spark, "orders_v")
    assert shuffles(p) == 0
    assert p.count("Bucketed: true") == 2


@pytest.mark.parametrize("key", ["training_set", "encoded"])
def test_encoder_joins_are_broadcast(spark, key):
    p = plan(spark, key)
    assert shuffles(p) == 0
    assert "SortMergeJoin" not in tree(p)


def test_top_k_uses_window_group_limit_without_reshuffling_expanded_rows(spark):
    t = tree(plan(spark, "top3_items"))
    assert "WindowGroupLimit" in t
    # nothing between the rank window and the menu expansion shuffles rows
    above_expansion = t.split("BroadcastNestedLoopJoin")[0]
    assert not re.search(r"\bExchange \(\d+\)", above_expansion)


def test_never_visited_has_no_product(spark):
    """The complement of each customer's brands: equality joins only, all brands
    from a scalar subquery."""
    p = plan(spark, "never_visited")
    assert "BroadcastNestedLoopJoin" not in p and "CartesianProduct" not in p
    assert "array_except" in p and "subquery" in p.lower()


def test_page_and_sample_cut_before_the_top_k(spark):
    """The rows are cut before the sort, the page by a literal bound and the
    sample by a checkpointed hash bound, at every size."""
    from menurec.operators.audience import ordered_page
    from menurec.plans.queries import Context
    page = formatted(ordered_page(Context(spark, SF_SMALL).interactions, ["customer_id", "menu_item_name"], 200))
    assert "TakeOrderedAndProject" in tree(page)
    assert re.search(r"LessThanOrEqual\(\w*,\d+\)|#\d+L? <= \d+", page)
    assert "TakeOrderedAndProject" in tree(plan(spark, "audience_page"))
    sample = tree(formatted(sample_n(spark.range(10_000), ["id"], 10)))
    assert "TakeOrderedAndProject" in sample and "Scan ExistingRDD" in sample
