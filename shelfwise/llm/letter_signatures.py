"""Spelling variants of the words of a corpus, by partition-and-enumerate signatures of their letters.

A word's letters are a binary vector with one place for each (letter, how many of it came before). Words one replacement apart have vectors of the
same weight at Hamming distance two, words one insertion or deletion apart have them at distance one, with weights that differ by one. Places are
dealt to parts by hashes. Vectors at distance k differ in at most k parts, so they agree on all others: for each choice of parts to leave out, a word
sends a hash of the rest (``SAME`` parts less two for words of one length; ``NEXT`` parts less one for those of a length and the next). Two near
words share a signature for sure; an equality join on signatures finds all near pairs, and each is verified inside the join: a sketch of its pairs
of letters first, which an edit changes by at most four bits, then the edit distance.

Only distinct words meet: occurrences are counted before the first shuffle and again behind it, and only frequent words send signatures.
A signature holds most letters of a word and its length, so few words share one however large the corpus is; ``SAME`` can be raised for a very
large vocabulary. Forms rise in frequency by a factor of two at least, so chains end, and roots are found by doubling steps.

Null texts hold no words. A null doc_id counts as an empty text in the noise draw. Repeated rows count each. Bytes that are no UTF-8 end a word.
No rows, or no frequent words, give no rows. Columns other than doc_id and text do not take part.
"""

import re
from itertools import combinations
from zlib import crc32

import numpy as np
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import LongType, StringType, StructField, StructType

from ..session import materialize
from .text import MEMO, batch, mix, text_column

SAME, NEXT = 6, 4
RUN = re.compile("[A-Za-zÀ-ÿ]+")


def noisy_runs(doc_id, text, shortest, noise):
    """(word, count) of a text's lower-cased runs; one run in ``noise`` by a hash of the id and the run lacks a code point."""
    seen, start = {}, crc32(b"%s:" % doc_id)
    for run in RUN.findall(text.lower().decode("utf-8", "replace")):
        if len(run) >= shortest:
            seen[run] = seen.get(run, 0) + 1
    for run, n in seen.items():
        h = crc32(run.encode(), start)
        if h % noise == 0:
            k = h % len(run)
            run = run[:k] + run[k + 1:]
            if len(run) < shortest:
                continue
        yield run, n


def observed_words(df, shortest=5, least=3, noise=97):
    """Distinct words of at least ``shortest`` code points and how often they occur (n), ``least`` times at least."""
    schema = StructType([StructField("word", StringType()), StructField("n", LongType())])

    def run(batches):
        out, counts = to_arrow_schema(schema), {}
        for b in batches:
            for i in range(0, b.num_rows, 256):
                part = b.slice(i, 256)
                for d, t in zip(part.column("id").to_pylist(), part.column("text").to_pylist()):
                    for word, n in noisy_runs((d or "").encode(), t or b"", shortest, noise):
                        counts[word] = counts.get(word, 0) + n
                    if len(counts) > MEMO:
                        yield batch(out, word=list(counts), n=list(counts.values()))
                        counts.clear()
        yield batch(out, word=list(counts), n=list(counts.values()))
    found = text_column(df, F.col("doc_id").cast("string").alias("id")).mapInArrow(run, schema)
    return found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def _sums(words, parts):
    """Per word and part, a sum of hashes of the places of the part that are set; and the words' lengths."""
    length = np.array([len(w) for w in words])
    letters = np.frombuffer("".join(words).encode("utf-32-le"), "<u4").astype(np.uint64)
    word = np.repeat(np.arange(len(words)), length)
    order = np.lexsort((letters, word))
    letters = letters[order]
    new = np.r_[True, (letters[1:] != letters[:-1]) | (word[1:] != word[:-1])]
    at = np.arange(len(letters))
    before = at - np.maximum.accumulate(np.where(new, at, 0))  # of the same letter in the word
    place = mix((letters << np.uint64(24)) + before.astype(np.uint64) + np.uint64(parts))
    sums = np.zeros((len(words), parts), np.uint64)
    with np.errstate(over="ignore"):
        np.add.at(sums, (word, (place % np.uint64(parts)).astype(np.int64)), mix(place))
    return sums, length.astype(np.uint64)


def signatures(words):
    """One row a word: its signatures for partners of its own length, then those for partners a letter longer or shorter."""
    out = []
    with np.errstate(over="ignore"):
        for parts, apart, slots in ((SAME, 2, (0,)), (NEXT, 1, (0, 1))):
            sums, length = _sums(words, parts)
            sums = mix(sums + np.arange(parts, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
            for k, left_out in enumerate(combinations(range(parts), apart)):
                rest = sums.sum(axis=1, dtype=np.uint64) - sums[:, list(left_out)].sum(axis=1, dtype=np.uint64)
                for slot in slots:
                    out.append(mix(rest + mix((length + np.uint64(slot)) * np.uint64(1 << 16) + np.uint64(k * 4 + apart))))
    return np.stack(out, axis=1)


def _bigrams(words):
    """A parity sketch of 64 bits of each word's pairs of neighbouring letters, ends included. An edit changes at most four pairs."""
    flat = np.frombuffer("".join(f"\0{w}\0" for w in words).encode("utf-32-le"), "<u4").astype(np.uint64)
    word = np.repeat(np.arange(len(words)), np.array([len(w) + 2 for w in words]))
    inside = word[1:] == word[:-1]
    bit = np.uint64(1) << (mix((flat[:-1] << np.uint64(32)) + flat[1:])[inside] >> np.uint64(58))
    sketch = np.zeros(len(words), np.uint64)
    np.bitwise_xor.at(sketch, word[1:][inside], bit)
    return sketch


def near_pairs(words):
    """Pairs of words (a < b) at edit distance one, from distinct words."""
    schema = StructType([StructField("sig", LongType()), StructField("word", StringType()), StructField("sketch", LongType())])

    def run(batches):
        out = to_arrow_schema(schema)
        for b in batches:
            for i in range(0, b.num_rows, 2048):
                part = b.column("word").slice(i, 2048)
                text = part.to_pylist()
                sig = signatures(text)
                at = np.repeat(np.arange(len(text)), sig.shape[1])
                yield batch(out, sig=sig.ravel().view(np.int64), word=part.take(at), sketch=_bigrams(text)[at].view(np.int64))
    sent = words.select("word").mapInArrow(run, schema)
    one, two = sent.toDF("sig", "a", "sa"), sent.toDF("sig", "b", "sb")
    close = (F.col("a") < F.col("b")) & (F.bit_count(F.col("sa").bitwiseXOR(F.col("sb"))) <= 4)
    return one.hint("merge").join(two, "sig").where(F.when(close, F.levenshtein("a", "b", 1) == 1)).select("a", "b").distinct()


def roots(forms):
    """The last of the chain word, form, form's form, ... from rows (word, form) without cycles; in doubling steps."""
    at = materialize(forms.select("word", F.col("form").alias("root")))
    while True:
        ahead = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = materialize(at.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        at = step.select("word", "root")
        if step.where("moved").isEmpty():
            return at


def variants(df, shortest=5, least=3, noise=97, ratio=2):
    """Per word: its form (the near word of most occurrences, of at least ``ratio`` times as many as its own), the root of its
    chain of forms, n, n_near and form_n."""
    words = materialize(observed_words(df, shortest, least, noise))
    pairs = materialize(near_pairs(words))
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("other")).unionByName(pairs.select(F.col("b").alias("word"), F.col("a").alias("other")))
    both = both.join(words.toDF("word", "own"), "word").join(words.toDF("other", "nb"), "other")
    best = both.groupBy("word").agg(F.first("own").alias("own"), F.count(F.lit(1)).alias("n_near"), F.min_by(F.struct("other", "nb"), F.struct(-F.col("nb"), "other")).alias("best"))
    chosen = F.col("best.nb") >= ratio * F.col("own")
    best = materialize(best.select("word", "n_near", F.when(chosen, F.col("best.other")).alias("form"), F.when(chosen, F.col("best.nb")).alias("form_n")))
    found = words.join(best, "word", "left").join(roots(best.where("form is not null")), "word", "left")
    return found.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n")
