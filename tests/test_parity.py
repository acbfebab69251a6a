"""Every query with SQL gives the same whole result in DuckDB."""

import pytest

import __spark_entry__ as entry
from parity import check, duck

ORACLES = entry.oracle_sql()
QUERIES = entry.queries()


@pytest.fixture(scope="module")
def con(sf):
    return duck(sf)


@pytest.mark.parametrize("key", sorted(ORACLES))
def test_matches_sql(spark, sf, con, key):
    assert check(spark, con, sf, key, QUERIES[key], ORACLES[key]) is None


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
@pytest.mark.parametrize("key", ["ar4_rules", "ar4_rules_by_lift", "ar5_code_rules", "jn4_recommendations", "jn13_match_rule_products",
                                 "jn13_match_contained", "wn14_rank_by_lift", "so1_union_rules"])
def test_rules_are_not_empty(folder, key):
    assert duck(folder).sql(f"SELECT count(*) FROM ({ORACLES[key]})").fetchall()[0][0] > 0
