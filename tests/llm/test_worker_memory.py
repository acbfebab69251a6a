"""What a Python worker remembers is bounded, and goes when another operator's helper begins."""

import weakref

import numpy as np
import public_tokenizers

from shelfwise.llm import neighbour_vote
from shelfwise.llm.text import MEMO, WordTokenizer, word_hasher, word_tokenizer

PATH = public_tokenizers.path("word_bpe_49k.json")
TEXTS = [" ".join(f"word{i * 7 + j} Ünit, {i}-{j}" for j in range(40)) + "\n" + "same line\nsame line" for i in range(60)]


def test_a_worker_keeps_one_helper():
    features = neighbour_vote._features(64)
    assert neighbour_vote._features(64) is features
    features = weakref.ref(features)
    hasher = weakref.ref(word_hasher())
    assert features() is None and hasher() is word_hasher()
    tokenizer = weakref.ref(word_tokenizer(PATH, MEMO))
    assert hasher() is None and tokenizer() is word_tokenizer(PATH, MEMO)
    word_hasher()
    assert tokenizer() is None


def test_tokenizer_remembers_no_more_runs_than_told():
    few, many = WordTokenizer(PATH, runs=600), WordTokenizer(PATH)
    for t in TEXTS:
        assert few(t).tolist() == many(t).tolist()
        assert len(few.memo) + len(few.old) <= 600
    assert len(many.memo) > 600


def test_features_do_not_depend_on_what_is_remembered():
    few, many = neighbour_vote.Features(256, limit=100), neighbour_vote.Features(256)
    for t in [b"", None, b" \n", *(t.encode() for t in TEXTS)]:
        got = few(t)
        assert np.array_equal(got, many(t)) and got.dtype == np.float32
        assert len(few.words) == len(few.words.hashes) < 100 + 130
    assert len(many.words) > 1000


def test_kept_documents_are_those_scored(spark):
    rows = [(i, t) for i, t in enumerate([*TEXTS, "", None])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 3 % 2) for i in range(30)], "doc_id long, label int")
    model = neighbour_vote.fit(docs, labels, features=256, rank=8)
    scores = {r["doc_id"]: r["score"] for r in neighbour_vote.score(docs, model).collect()}
    middle = float(np.median(list(scores.values())))
    for df in (docs, docs.selectExpr("doc_id", "cast(text as binary) as text")):
        kept = neighbour_vote.keep(df, model, threshold=middle)
        assert kept.columns == df.columns
        assert sorted(r["doc_id"] for r in kept.collect()) == sorted(d for d, s in scores.items() if s >= middle)
