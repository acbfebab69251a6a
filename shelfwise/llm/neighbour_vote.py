"""Quality by nearest-neighbour voting over latent-semantic vectors.

Texts become hashed counts of words, word shapes (letters, capitals, digits, marks) and repeats; square roots of counts
times inverse document frequency, projected on the leading singular directions of a sample of labelled texts. Every
document is compared with all labelled vectors of that sample by exact cosine products, block by block, and its score is
the similarity-weighted share of label 1 among its nearest. The sample is bounded by ``max_labelled`` rows (those of
smallest hash of their id), so what is broadcast has a fixed size: ``max_labelled`` x ``rank`` and ``features`` x ``rank``
numbers. Only the text makes a score; ids, languages, sources and labels do not.

Null and empty texts (no word) score 0. Without a labelled text every other document scores 0.5. Labels are one a
document: the smaller, if there are more; null labels and labels of unknown documents are left out. Repeated rows are
scored alike, and null ids are kept.
"""

from array import array

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, FloatType, IntegerType, StructField, StructType

from .text import MEMO, at_work, batch, free_name, shingle_hashes, text_column

_SHAPES = bytes.maketrans(bytes(range(48, 58)) + bytes(range(65, 91)) + bytes(range(97, 123)) + bytes(range(128, 256)),
                          b"0" * 10 + b"A" * 26 + b"a" * 26 + b"a" * 128)
REPEATS = 3  # features for repeated words, runs of words and lines


def shape(word):
    """A word with its kinds of characters in place of the characters, runs cut to one."""
    s = word[:64].translate(_SHAPES)
    return bytes(c for i, c in enumerate(s) if i == 0 or c != s[i - 1])


class _Words(dict):
    """Numbers of words, and by number a word's place and its shape's among the features, and its hash."""

    def __init__(self, half):
        self.half, self.places, self.shapes, self.hashes = half, array("i"), array("i"), array("Q")

    def __missing__(self, word):
        self.places.append(xxhash.xxh32_intdigest(word) % self.half)
        self.shapes.append(self.half + xxhash.xxh32_intdigest(shape(word), 7) % self.half)
        self.hashes.append(xxhash.xxh64_intdigest(word))
        n = self[word] = len(self)
        return n


class Features:
    """Counts of a text's features, as a dense vector."""

    def __init__(self, size, limit=MEMO):
        self.size, self.half, self.limit = size, (size - REPEATS) // 2, limit
        self.words = _Words(self.half)

    def __call__(self, text):
        words = (text or b"").split()
        n = len(words)
        if not n:
            return np.zeros(self.size, np.float32)
        if len(self.words) >= self.limit:  # between texts, since a text's numbers are looked up together
            self.words = _Words(self.half)
        at = np.fromiter(map(self.words.__getitem__, words), np.int32, n)
        ids, shapes, h = (np.frombuffer(x, x.typecode)[at] for x in (self.words.places, self.words.shapes, self.words.hashes))
        out = np.bincount(np.concatenate([ids, shapes]), minlength=self.size).astype(np.float32)
        s = shingle_hashes(h, 3)
        lines = [x for x in text.split(b"\n") if x.strip()]
        out[-3:] = (np.count_nonzero(h[1:] == h[:-1]), len(s) - len(np.unique(s)), (len(lines) - len(set(lines))) * n / len(lines))
        return out


def _features(size):
    return at_work(Features, size)


def counts(df, features, *others):
    """Rows with ``others``, the places and the values of the features that occur."""
    schema = StructType([*df.select(*others).schema, StructField("at", ArrayType(IntegerType())), StructField("n", ArrayType(FloatType()))])

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema
        f, out = _features(features), to_arrow_schema(schema)
        for b in batches:
            rows = [f(t) for t in b.column("text").to_pylist()]
            at = [np.flatnonzero(r).astype(np.int32) for r in rows]
            yield batch(out, at=pa.array(at, out.field("at").type), n=pa.array([r[a] for r, a in zip(rows, at)], out.field("n").type),
                        **{c: b.column(c) for c in others})
    return text_column(df, *others).mapInArrow(run, schema)


def fit(docs, labels, features=4096, rank=96, max_labelled=4000, seed=7):
    """Model from texts (doc_id, text) and labels (doc_id, label 0 or 1): a dict of arrays of bounded size."""
    labels = labels.where("doc_id is not null and label is not null").groupBy("doc_id").agg(F.min("label").cast("int").alias("label"))
    sample = labels.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
    known = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")  # at most max_labelled short rows
    rows = counts(known, features, "doc_id", "label").where("size(at) > 0").orderBy("doc_id", "at", "n").limit(2 * max_labelled).collect()
    if not rows:
        return None
    x = np.zeros((len(rows), features), np.float32)
    for i, r in enumerate(rows):
        x[i, r["at"]] = r["n"]
    idf = np.log((1 + len(rows)) / (1 + np.count_nonzero(x, axis=0))).astype(np.float32)
    x = _weigh(x, idf)
    rng = np.random.default_rng(seed)
    k = min(rank + 8, len(rows))
    y = x @ rng.standard_normal((features, k)).astype(np.float32)
    for _ in range(3):
        y = x @ (x.T @ np.linalg.qr(y)[0])
    q = np.linalg.qr(y)[0]
    directions = np.linalg.svd(q.T @ x, full_matrices=False)[2][:rank].T.astype(np.float32)
    return {"features": features, "idf": idf, "directions": directions, "vectors": _unit(x @ directions),
            "labels": np.array([r["label"] for r in rows], np.float32)}


def _unit(x):
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def _weigh(x, idf, block=128):
    """In place, as ``x`` is the largest array of a task."""
    np.sqrt(x, out=x)
    x *= idf
    for i in range(0, len(x), block):
        x[i:i + block] = _unit(x[i:i + block])
    return x


def _rows(f, texts):
    x = np.empty((len(texts), f.size), np.float32)
    for i, t in enumerate(texts):
        x[i] = f(t)
    return x


def vote(vectors, model, k=15, power=4, block=512):
    """Similarity-weighted share of label 1 among the ``k`` nearest labelled vectors, by blocks of rows."""
    out = np.empty(len(vectors))
    for i in range(0, len(vectors), block):
        sim = vectors[i:i + block] @ model["vectors"].T
        if sim.shape[1] > k:
            near = np.argpartition(sim, -k, axis=1)[:, -k:]
            sim, label = np.take_along_axis(sim, near, axis=1), model["labels"][near]
        else:
            label = np.broadcast_to(model["labels"], sim.shape)
        w = np.clip(sim, 1e-6, 1).astype(np.float64) ** power
        out[i:i + block] = (w * label).sum(axis=1) / w.sum(axis=1)
    return np.clip(out, 0, 1)


def score(df, model, key="doc_id", k=15, power=4):
    """Per row: the key and its score."""
    schema = StructType([df.select(key).schema[0], StructField("score", DoubleType())])
    if model is None:
        words = F.length(F.translate(F.coalesce(F.col("text"), F.lit("")), " \t\n\x0b\x0c\r", ""))
        return df.select(key, F.when(words > 0, 0.5).otherwise(0.0).alias("score"))
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema
        m, out = shared.value, to_arrow_schema(schema)
        f = _features(m["features"])
        for b in batches:
            for i in range(0, b.num_rows, 1024):
                part = b.slice(i, 1024)
                x = _rows(f, part.column("text").to_pylist())
                some = x.any(axis=1)
                s = vote(_unit(_weigh(x, m["idf"]) @ m["directions"]), m, k, power)
                yield batch(out, **{key: part.column(key), "score": np.where(some, s, 0.0)})
    return text_column(df, key).mapInArrow(run, schema)


def keep(df, model, threshold=0.3, **options):
    """The rows of ``df``, all columns, whose score reaches the threshold."""
    if model is None:
        return df.where(F.length(F.translate(F.coalesce("text", F.lit("")), " \t\n\x0b\x0c\r", "")) > 0)
    is_text = dict(df.dtypes).get("text") == "string"  # then its bytes are taken from the column itself
    own = "text" if is_text else free_name(df, "own_text")
    shared, columns, schema = df.sparkSession.sparkContext.broadcast(model), df.columns, df.schema

    def run(batches):
        m = shared.value
        f = _features(m["features"])
        for b in batches:
            for i in range(0, b.num_rows, 1024):
                part = b.slice(i, 1024)
                x = _rows(f, part.column(own).cast(pa.binary()).to_pylist())
                some = x.any(axis=1)
                s = vote(_unit(_weigh(x, m["idf"]) @ m["directions"]), m, **options)
                yield part.select(columns).filter(pa.array(np.where(some, s, 0.0) >= threshold))
    given = df if is_text else df.withColumn(own, F.col("text").cast("string").cast("binary"))
    return given.mapInArrow(run, schema)


def held_out(key="doc_id"):
    """Whether a document's label is kept for judging: crc32 of its id as text is divisible by five."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % 5 == 0, F.lit(False))


def fit_quality(docs, labels, **options):
    """The model of ``labels.quality``, from labels that are not held out."""
    return fit(docs, labels.select("doc_id", F.col("quality").alias("label")).where(~held_out()), **options)


def score_documents(docs, labels, threshold=0.3, **fit_options):
    """Per document: doc_id, held_out, score, predicted."""
    scored = score(docs, fit_quality(docs, labels, **fit_options))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
