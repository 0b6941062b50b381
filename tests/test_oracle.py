"""Registered queries against their SQL on the smallest test folder.

A few by default; LARDER_ORACLE=all runs every query, LARDER_ORACLE_DIR picks another folder.
"""

import os

import pytest
from oracle import compare, connect

from __spark_entry__ import entry, oracle_sql, queries

FOLDER = os.environ.get("LARDER_ORACLE_DIR", "/root/testdata/sf0.001")
FEW = ["fts_batch", "fuzzy_batch", "semantic_batch", "hybrid_batch", "catalog_page", "order_rejects", "cart_state",
       "rate_limiter", "key_conflicts", "supplier_comparison", "result_ndjson", "visible_order_items"]
NAMES = list(queries()) if os.environ.get("LARDER_ORACLE") == "all" else FEW

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data here")


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, name):
    df = queries()[name](spark, FOLDER)
    if name in oracle_sql():
        problem, _ = compare(df, connect(FOLDER), oracle_sql()[name])
        assert problem is None
    else:
        assert df.count() >= 0


def test_entry(spark):
    assert not entry(spark).isEmpty()


def test_every_oracle_has_a_query():
    assert set(oracle_sql()) <= set(queries())
