"""One customer, one order and one part hold a third of the rows; results still match SQL."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from parity import TABLES, check, duck

KEYS = ["fp2_prices", "fp5_per_order", "fc6_window_trends", "fc9_relative_trends", "fc13_risk", "wn7_intervals", "wn8_half_trends", "ps1_psi",
        "ol1_transition_audit", "ol4_oversell", "ol6_balance_ledger", "ag8_category_preference", "ag21_product_dimension", "cl5_iqr_fences",
        "ar1_top_item_baskets", "ar2_itemsets", "ts1_series", "st1_incremental_rfm"]


@pytest.fixture(scope="module")
def skewed_dir(tmp_path_factory, sf):
    out = str(tmp_path_factory.mktemp("skewed"))
    for t in TABLES:
        if t not in ("orders", "lineitem"):
            os.symlink(f"{sf}/{t}.parquet", f"{out}/{t}.parquet")
    con = duckdb.connect()
    con.execute(f"""COPY (SELECT * REPLACE (CASE WHEN o_orderkey % 3 = 0 THEN 7 ELSE o_custkey END AS o_custkey) FROM '{sf}/orders.parquet')
        TO '{out}/orders.parquet' (FORMAT parquet)""")
    con.execute(f"""COPY (SELECT * REPLACE (CASE WHEN l_orderkey % 3 = 0 THEN 21 ELSE l_orderkey END AS l_orderkey,
        CASE WHEN l_partkey % 3 = 0 THEN 5 ELSE l_partkey END AS l_partkey) FROM '{sf}/lineitem.parquet') TO '{out}/lineitem.parquet' (FORMAT parquet)""")
    return out


@pytest.mark.parametrize("key", KEYS)
def test_skewed(spark, skewed_dir, key):
    assert check(spark, duck(skewed_dir), skewed_dir, key, entry.queries()[key], entry.oracle_sql()[key]) is None
