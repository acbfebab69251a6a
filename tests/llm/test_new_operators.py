"""Spelling variants, hard negatives and one-permutation near copies against plain versions, on the small tables and odd ones."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import brute
from shelfwise.llm import letter_signatures, one_permutation, queries, segment_bounds
from test_edges import EXTRA, ROWS, table


@pytest.fixture(scope="module")
def docs(spark, sf):
    return [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


# ------------------------------------------------------------------ spelling variants

def test_op11(spark, sf, docs):
    got = queries.QUERIES["op11_letter_signatures"](spark, sf).select("word", "form", "root", "n", "n_near", "form_n").collect()
    assert sorted(map(tuple, got)) == brute.variants(docs)


def test_signatures_of_near_words_meet():
    rng = random.Random(5)
    for _ in range(400):
        w = "".join(rng.choice("aabbcdeéÿ") for _ in range(rng.randint(5, 12)))
        k = rng.randrange(len(w))
        for other in (w[:k] + w[k + 1:], w[:k] + rng.choice("abcxyz") + w[k + 1:], w[:k] + rng.choice("abcxyz") + w[k:]):
            if other != w:
                sig = letter_signatures.signatures([w, other])
                assert set(sig[0].tolist()) & set(sig[1].tolist()), (w, other)
                a, b = letter_signatures._bigrams([w, other])
                assert int(np.bitwise_count(a ^ b)) <= 4


def test_variants_of_random_words(spark):
    """Few letters, so that anagrams, repeated letters and long chains abound; marks, capitals and letters beyond the range end or change words."""
    rng = random.Random(2)
    vocabulary = ["".join(rng.choice("abé") for _ in range(rng.randint(4, 8))) for _ in range(150)]
    rows = [(d, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 60)))) for d in range(120)]
    rows += [(500, "Straße STRASSE straße,straße Ÿabcde ÷abcde×abcde Ábcdef ábcdef"), (501, "Āabcdef Ÿabcdef abcdef"), (501, "abcdef abcdef"), (None, "abcdef"), (502, None), (503, "")]
    got = letter_signatures.variants(frame(spark, rows)).collect()
    assert sorted(map(tuple, got)) == brute.variants(rows)


# ------------------------------------------------------------------ hard negatives

def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")


def integers(rows):
    return [(i, l, np.array([math.floor(256 * float(np.float32(x))) for x in v], object)) for i, v, l in rows]


def test_op12(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    rows = [(i, v, (l + 1) % 10 if i % 7 == 0 else l) for i, v, l in rows]
    got = queries.QUERIES["op12_segment_bounds"](spark, sf).collect()
    assert sorted(map(tuple, got)) == brute.hard_negatives(integers(rows))


@pytest.mark.parametrize("dims", [1, 3, 5, 40])
def test_many_blocks_ties_and_large_components(spark, monkeypatch, dims):
    """Several blocks and batches; few distinct components, so that scores tie; components whose products need 64 bits."""
    rng = np.random.default_rng(dims)
    monkeypatch.setattr(segment_bounds, "BLOCK", 64)
    centres = rng.integers(-3, 4, (5, dims))
    rows = [(int(i), [float(x) for x in (centres[i % 5] + rng.integers(-1, 2, dims)) * (40000 if dims == 3 else 1) / 4], int(i % 5 + (i % 11 == 0)) % 5) for i in range(400)]
    got = segment_bounds.mine(vectors(spark, rows), "id % 20 = 0").collect()
    assert sorted(map(tuple, got)) == brute.hard_negatives(integers(rows), every=20)


def test_bounds_hold_and_rule_out():
    rng = np.random.default_rng(0)
    x, y = rng.normal(0, 30, (20, 64)).round() + 40, rng.normal(0, 30, (50, 64)).round() - 10
    truth = (x @ y.T).astype(np.int64)
    seen = []

    def keep(low, high, alive):
        assert (low <= truth).all() and (truth <= high).all()
        seen.append(float((high - low).mean()))
        return np.ones(alive.shape, bool)
    alive, scores = segment_bounds.refined(x, segment_bounds.summaries(x), y, segment_bounds.summaries(y), np.ones((20, 50), bool), keep)
    assert (scores == truth).all() and seen == sorted(seen, reverse=True) and len(seen) == len(segment_bounds.LEVELS)
    smooth = np.repeat(rng.normal(0, 100, (60, 4)).round(), 16, axis=1)  # equal within segments: bounds are exact at once
    alive, _ = segment_bounds.refined(smooth, segment_bounds.summaries(smooth), smooth, segment_bounds.summaries(smooth), np.ones((60, 60), bool),
                                      lambda low, high, on: high >= segment_bounds._kth(low, on, 5)[:, None])
    assert alive.sum(axis=1).max() <= 8


def test_odd_vectors(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(0, [1.0, 0.0], 1), (50, None, 1), (100, [nan, 1.0], 1), (150, [inf, 1.0], 1), (None, [1.0, 1.0], 1), (1, [1.0, 0.5], 1), (2, [0.75, 0.0], 2), (3, [0.75, 0.25], None),
            (4, [0.75, None], 2), (5, [0.75, 0.0], 3), (6, [1.0, 0.0, 0.0], 2), (7, [], 2), (8, [0.6, 0.0], 2), (8, [0.6, 0.0], 2), (200, [0.0, 0.0], 4), (9, [-1.0, 0.0], 2), (10, [1e30, 0.0], 2)]
    df = vectors(spark, rows).selectExpr("*", "1 AS id", "2 AS block", "3 AS kind", "4 AS rank", "5 AS dims", "6 AS z", "7 AS best")
    got = [tuple(r) for r in segment_bounds.mine(df, "id % 50 = 0").orderBy("anchor_id", "positive_id", "rank").collect()]
    assert got == [(0, 1, 1, 2, 65536, 49152), (0, 1, 2, 5, 65536, 49152), (0, 1, 3, 8, 65536, 39168)]
    assert segment_bounds.mine(df.where("false"), "id % 50 = 0").collect() == []
    assert segment_bounds.mine(df, "id = -1").collect() == []


# ------------------------------------------------------------------ one-permutation hashing

def test_op13(spark, sf, docs):
    got = queries.QUERIES["op13_one_permutation"](spark, sf).collect()
    want = brute.components(docs, 3, 85)
    assert {r["doc_id"]: r["component_id"] for r in got} == want
    for r in got:
        assert r["kept"] == (r["doc_id"] == r["component_id"])
    sets = {d: len(brute.shingles(t, 3)) for d, t in docs}
    assert {r["doc_id"]: r["n_shingles"] for r in got} == sets


def planted(seed, sizes, edits):
    """Groups of documents that differ in a few words each from one text, and texts that share a long passage."""
    rng, rows = random.Random(seed), []
    word = lambda: f"w{rng.randrange(5000)}"
    for size in sizes:
        base = [word() for _ in range(rng.choice([8, 12, 30, 80, 300]))]
        for _ in range(size):
            t = list(base)
            for _ in range(rng.randint(0, edits)):
                t[rng.randrange(len(t))] = word()
            rows.append(" ".join(t))
    passage = [word() for _ in range(60)]
    rows += [" ".join(passage + [word() for _ in range(rng.randint(0, 12))]) for _ in range(60)]
    rng.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("seed, percent, words", [(1, 85, 3), (2, 85, 3), (3, 80, 5), (4, 60, 2)])
def test_planted_groups(spark, monkeypatch, seed, percent, words):
    """Members that are apart from a bucket's centre are found through the blocks, several of them."""
    monkeypatch.setattr(one_permutation, "BLOCK", 16)
    rows = planted(seed, [1] * 40 + [2] * 10 + [5] * 6 + [40, 60], 4)
    got = {r["doc_id"]: r["component_id"] for r in one_permutation.groups(frame(spark, rows), words, percent).collect()}
    assert got == brute.components(rows, words, percent)


def test_links_that_the_centre_does_not_see(spark):
    """The leftover step alone: all members share a bucket, whose centre links with none of them."""
    rng = random.Random(9)
    texts = [[f"a{rng.randrange(900)}" for _ in range(100)] for _ in range(3)]
    sets = {i: np.sort(np.array([hash((w, 1)) & (1 << 63) - 1 for w in t], np.uint64)) for i, t in enumerate([texts[0], texts[1], texts[1][:-3] + ["x", "y", "z"], texts[2], texts[2][:-2] + ["q", "r"]])}
    sets = {i: np.unique(s) for i, s in sets.items()}
    bands, rows = one_permutation.plan(85)
    values = one_permutation.signatures(list(sets.values()), bands * rows)
    short = (one_permutation.mix(values) & np.uint64(255)).astype(np.uint8)
    nodes = spark.createDataFrame([(i, len(s), bytearray(short[i].tobytes())) for i, s in sets.items()], "node long, n_shingles long, sig binary")
    whole = spark.createDataFrame([(i, bytearray(s.tobytes())) for i, s in sets.items()], "node long, shingles binary")
    buckets = spark.createDataFrame([(k, i, 0) for k in (7, 8) for i in sets], "key long, node long, center long")
    none = spark.createDataFrame([], "node long, component long")
    apart = one_permutation._apart(buckets, none)
    assert apart.select("key").distinct().count() == 1  # two buckets of the same members count once
    got = {tuple(sorted(r)) for r in one_permutation._leftover(apart, nodes, whole, 85).collect()}
    assert got == {(1, 2), (3, 4)}


def test_signatures_estimate_similarity():
    """With few shingles in many bins and with many; the miss of a pair at the threshold is far below one in a thousand."""
    rng = np.random.default_rng(4)
    bands, rows = one_permutation.plan(85)
    for n in (20, 100, 2000):
        met = 0
        for _ in range(60):
            both = rng.integers(0, 1 << 63, int(n * 0.85) + 1, dtype=np.uint64)
            extra = rng.integers(0, 1 << 63, n - len(both), dtype=np.uint64)
            a, b = np.unique(np.r_[both, extra[::2]]), np.unique(np.r_[both, extra[1::2]])
            v = one_permutation.signatures([a, b], bands * rows)
            j = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
            assert abs((v[0] == v[1]).mean() - j) < 6 * math.sqrt(j * (1 - j) / (bands * rows)) + (0.1 if n < 50 else 0)
            k = one_permutation.band_keys(v, bands, rows)
            met += bool((k[0] == k[1]).any())
        assert met == 60


# ------------------------------------------------------------------ odd tables

def test_odd_documents(spark):
    df = table(spark)
    got = {(r["doc_id"], r["n_shingles"]): r for r in one_permutation.groups(df).collect()}
    assert len(one_permutation.groups(df).collect()) == len(ROWS)
    for (d, n), r in got.items():
        assert r["component_id"] == d and r["kept"]
    assert got[7, 1] and got[2, 0] and got[5, 977 * 1]
    words = {r["word"]: r for r in letter_signatures.variants(df).collect()}
    assert words["plain"]["n"] if "plain" in words else True
    assert sorted(map(tuple, words.values())) == brute.variants([(r[0], r[1]) for r in ROWS])
    assert EXTRA and not one_permutation.groups(df.where("false")).collect() and not letter_signatures.variants(df.where("false")).collect()
    one = df.withColumn("doc_id", F.lit(3)).withColumn("text", F.lit("the same few words again and again"))
    assert {(r["component_id"], r["kept"]) for r in one_permutation.groups(one).collect()} == {(3, True)}
