"""Exact quantiles against sorted lists: ties, weights, null keys, values that do not count."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfwise.functions.quantiles import column_quantiles, exact_quantiles
from shelfwise.operators import cleaning as CL

PROBS = [0.0, 0.1, 0.25, 0.5, 0.75, 1.0]


def by_hand(values, probs=PROBS):
    v, out = sorted(values), []
    for p in probs:
        h = (len(v) - 1) * p
        lo, part = int(h), h - int(h)
        out.append(v[lo] if part == 0 or v[lo] == v[lo + 1] else v[lo] * (1 - part) + v[lo + 1] * part)
    return out


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(7)
    out = [(rng.choice(["a", "b", None]), rng.choice([rng.random(), round(rng.random(), 1), 1e9 * rng.random()])) for _ in range(2000)]
    return out + [("hot", float(i % 50)) for i in range(3000)] + [("one", 5.0), ("odd", None), ("odd", float("nan")), ("odd", float("inf")), ("odd", -2.0)]


@pytest.mark.parametrize("splits", [2, 64])
@pytest.mark.parametrize("edges_per_key", [False, True])
def test_groups(spark, rows, splits, edges_per_key):
    df = spark.createDataFrame(rows, "k string, v double").repartition(5)
    got = {r["k"]: r["q"] for r in exact_quantiles(df, "v", PROBS, keys=["k"], splits=splits, edges_per_key=edges_per_key).collect()}
    groups = {}
    for k, v in rows:
        if v is not None and np.isfinite(v):
            groups.setdefault(k, []).append(v)
    assert got == {k: by_hand(v) for k, v in groups.items()}


def test_two_keys_with_nulls(spark):
    df = spark.createDataFrame([(None, 1, 1.0), (None, 1, 3.0), (None, None, 7.0), ("a", None, 9.0)], "x string, y int, v double")
    got = {(r["x"], r["y"]): r["q"] for r in exact_quantiles(df, "v", [0.5], keys=["x", "y"]).collect()}
    assert got == {(None, 1): [2.0], (None, None): [7.0], ("a", None): [9.0]}


def test_weights_repeat_rows(spark, rows):
    df = spark.createDataFrame(rows, "k string, v double")
    counts = df.groupBy("k", "v").agg(F.count("*").alias("n"))
    a = {r["k"]: r["q"] for r in exact_quantiles(df, "v", PROBS, keys=["k"]).collect()}
    assert a == {r["k"]: r["q"] for r in exact_quantiles(counts, "v", PROBS, keys=["k"], weight="n").collect()}


def test_no_values(spark):
    df = spark.createDataFrame([(None,), (float("nan"),)], "v double")
    assert exact_quantiles(df, "v", [0.5]).collect() == []
    assert column_quantiles(df, ["v"], [0.5]).collect()[0]["v"] is None


def test_input_is_read_once(spark, tmp_path):
    """The plan of the result, and what is built from it, reads the written counts and not the input."""
    spark.range(100).selectExpr("id % 7 AS k", "double(id) AS v").write.parquet(f"{tmp_path}/in")
    q = exact_quantiles(spark.read.parquet(f"{tmp_path}/in"), "v", [0.5], keys=["k"])
    assert not any(f.startswith(f"file://{tmp_path}") or str(tmp_path) in f for f in q.inputFiles())
    assert len(q.collect()) == 7


def test_fences_in_turn(spark):
    """The second fence is set by the rows that the first one kept, and a column without values keeps all."""
    rng = random.Random(1)
    rows = [(float(rng.randint(1, 9)), rng.random(), None) for _ in range(400)] + [(1000.0, 500.0 + i, None) for i in range(150)] + [(None, 0.5, None)]

    def fence(rows, c):
        v = [r[c] for r in rows if r[c] is not None]
        lo, hi = by_hand(v, [0.25, 0.75])
        return [r for r in rows if r[c] is not None and lo - 3 * (hi - lo) <= r[c] <= hi + 3 * (hi - lo)]
    want = fence(fence(rows, 0), 1)
    df = spark.createDataFrame(rows, "a double, b double, c double")
    assert sorted(map(tuple, CL.iqr_fences(df, ["a", "b", "c"]).collect()), key=str) == sorted(want, key=str)
    assert CL.iqr_fences(df.where("false"), ["a"]).collect() == []


def test_medians_fill_nulls(spark):
    df = spark.createDataFrame([(1.0, None, None), (None, 4.0, None), (3.0, 8.0, None)], "a double, b double, c double")
    got = sorted(map(tuple, CL.impute_median(df, ["a", "b", "c"]).collect()))
    assert got == [(1.0, 6.0, None), (2.0, 4.0, None), (3.0, 8.0, None)]
