"""Every registered query equals its DuckDB oracle on the smallest tables."""

import math

import duckdb
import pytest

import __spark_entry__ as entry
from conftest import SF_SMALL
from menurec.plans.queries import QUERIES

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()
ORACLE = entry.oracle_sql()


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v)
    return "\0" if v is None else str(v)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return c


@pytest.mark.parametrize("key", sorted(ORACLE))
def test_query_matches_oracle(spark, con, key):
    df = entry.queries()[key](spark, SF_SMALL)
    cols = sorted(df.columns)
    got = sorted(tuple(_norm(r[c]) for c in cols) for r in df.collect())
    rel = con.execute(ORACLE[key])
    ocols = [d[0] for d in rel.description]
    assert sorted(ocols) == cols
    idx = [ocols.index(c) for c in cols]
    want = sorted(tuple(_norm(r[i]) for i in idx) for r in rel.fetchall())
    assert got == want


def test_every_query_has_oracle_or_is_model():
    missing = set(QUERIES) - set(ORACLE)
    assert missing == {"dlrm_scores"}


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.count() > 0
    assert df.columns == ["customer_id", "city", "purchase_history", "menu_item_name"]


def test_fixture_counts(spark):
    """Adapter parity with the counts recorded in FIXTURES.md (sf0.001)."""
    q = entry.queries()
    assert q["orders_v"](spark, SF_SMALL).count() == 5976
    inter = q["interactions"](spark, SF_SMALL)
    assert inter.count() == 8237
    assert inter.filter("purchased = 1").count() == 4080
    assert q["never_visited"](spark, SF_SMALL).count() == 1988
