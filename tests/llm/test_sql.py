"""Queries of the package that SQL can express give the same whole result in DuckDB."""

import pytest

from parity import check, duck
from shelfwise.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("key", sorted(ORACLES))
def test_matches_sql(spark, sf, key):
    assert check(spark, duck(sf), sf, key, QUERIES[key], ORACLES[key]) is None
