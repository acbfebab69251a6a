"""Itemsets from item bitmaps against every subset of every basket."""

import random
from collections import Counter
from itertools import combinations

import pytest

from shelfwise.operators import baskets as B

SCHEMA = "basket long, items array<string>"


def by_hand(rows, least, max_len):
    n = Counter(s for _, items in rows for k in range(1, max_len + 1) for s in combinations(sorted(items), k))
    return {s: f for s, f in n.items() if f >= least}


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    likely = [["a", "b", "c", "d"], ["b", "c"], ["e", "f", "g"]]
    out = [(i, sorted({*rng.choice(likely), *rng.sample("abcdefghij", rng.randint(0, 3))})) for i in range(300)]
    return out + [(300, []), (301, [])]


@pytest.mark.parametrize("max_len", [0, 1, 2, 3, 4, 5])
@pytest.mark.parametrize("least", [1, 20])
def test_every_length(spark, rows, max_len, least):
    bk = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = B.frequent_itemsets(bk, min_count=least, max_len=max_len).collect()
    assert {tuple(r["items"]): r["freq"] for r in got} == by_hand(rows, least, max_len)
    assert len(got) == len({tuple(r["items"]) for r in got}) and {r["n"] for r in got} <= {302}
    assert all(list(r["items"]) == sorted(r["items"]) for r in got)


def test_support_counts_empty_baskets(spark, rows):
    bk = spark.createDataFrame(rows, SCHEMA)
    got = {tuple(r["items"]): r["freq"] for r in B.frequent_itemsets(bk, 0.1, 2).collect()}
    assert got == by_hand(rows, 31, 2)  # 302 baskets, 30.2 of them


def test_more_baskets_than_one_bitmap(spark):
    """Blocks of 32,768 baskets add up; no basket counts twice or is lost at their ends."""
    bk = spark.range(0, 100_000, 1, 1).selectExpr("id AS basket", "filter(array(if(id % 2 = 0, 'a', ''), if(id % 3 = 0, 'b', ''), if(id % 5 = 0, 'c', '')), x -> x <> '') AS items")
    got = {"".join(r["items"]): r["freq"] for r in B.frequent_itemsets(bk, min_count=1, max_len=3).collect()}
    assert got == {"a": 50_000, "b": 33_334, "c": 20_000, "ab": 16_667, "ac": 10_000, "bc": 6_667, "abc": 3_334}


def test_no_baskets(spark):
    assert B.frequent_itemsets(spark.createDataFrame([], SCHEMA), 0.5).collect() == []
    assert B.frequent_itemsets(spark.createDataFrame([(1, [])], SCHEMA), 0.5).collect() == []


def test_ladder_and_maximal_sets(spark, rows):
    bk = spark.createDataFrame(rows, SCHEMA)
    sets, support = B.itemsets_with_ladder(bk, 0.9, 3, floor=0.01, enough=10)
    assert support == 0.225 and {tuple(r["items"]) for r in sets.collect()} == set(by_hand(rows, 68, 3))
    want = by_hand(rows, 68, 3)
    assert {tuple(r["items"]) for r in B.maximal_itemsets(sets).collect()} == {s for s in want if not any(set(s) < set(x) for x in want)}


def test_candidates_need_all_their_parts():
    pairs = [("a", "b"), ("a", "c"), ("b", "c"), ("b", "d")]
    assert B._candidates(pairs, 3) == [(("a", "b"), ["c"])]
    assert B._candidates([("a",), ("b",), ("c",)], 2) == [(("a",), ["b", "c"]), (("b",), ["c"])]
