"""Hard negatives by segment summaries of vectors.

Scores are inner products of integers (each component x as floor(256 x)). A vector is cut into segments, and a segment keeps its length n, mean m and
deviation s. For two vectors a segment's share of the product lies within n (m m' - s s') and n (m m' + s s'), so the sums over all segments bound the
score from both sides. Segments are refined from ``LEVELS``: what no bound at one level can rule out meets the next, and the rest is scored exactly.

Rows are dealt to blocks of some ``BLOCK`` rows by a hash of their id. Every block gets the anchors behind its rows in one sorted stream, so a task holds
one block and one batch of anchors, and each anchor leaves at most its best few per block; those of all blocks are merged. Anchors, the smaller side,
are copied once a block. A first pass finds each anchor's positives, a second its negatives, where a row takes part for a positive if its score may
lie within the positive's range and may be among the best there.

Rows with a null id, label or vector, with null or non-finite components or with components of 2^16 and more in size take no part, nor do empty vectors and
those of more than 4096 components. An id that comes more than once counts with its smallest (label, vector). Vectors of different lengths do not meet.
No rows, or no anchors, give none. Columns other than the three named do not take part.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import IntegerType, LongType, StructField, StructType
from pyspark.sql.window import Window

from ..session import materialize

LEVELS = (4, 16, 32)
BLOCK = 8192
BATCH = 256
SPARSE = 0.02  # below this share of open pairs a level looks at pairs one by one


def summaries(z, levels=LEVELS):
    """Per level: scaled means and deviations of the segments, such that their products are a segment's share."""
    out = []
    for level in levels:
        if level < z.shape[1]:
            cut = np.linspace(0, z.shape[1], level + 1).astype(int)
            n = np.diff(cut)
            mean = np.add.reduceat(z, cut[:-1], axis=1) / n
            spread = np.maximum(np.add.reduceat(z * z, cut[:-1], axis=1) / n - mean * mean, 0)
            out.append((mean * np.sqrt(n), np.sqrt(spread * n)))
    return out


def _products(x, y, at):
    """Products of rows of x and y: all, or those at some pairs."""
    return x @ y.T if at is None else np.einsum("ij,ij->i", x[at[0]], y[at[1]])


def exact(x, y, at=None):
    """Integer inner products, exact as long as they fit 64 bits."""
    if float(np.abs(x).max(initial=0)) * float(np.abs(y).max(initial=0)) * x.shape[1] < 2.0 ** 53:
        return _products(x, y, at).astype(np.int64)
    return _products(x.astype(np.int64), y.astype(np.int64), at)


def refined(x, sx, y, sy, alive, keep):
    """Exact scores where ``alive`` and not ruled out; ``keep(low, high, alive)`` says which bounds leave a pair open. Returns (alive, scores)."""
    slack = 1 + 1e-9 * float(np.linalg.norm(x, axis=1).max(initial=0)) * float(np.linalg.norm(y, axis=1).max(initial=0))
    for (mx, ex), (my, ey) in zip(sx, sy):
        at = np.nonzero(alive) if alive.mean() < SPARSE else None
        middle, around = _products(mx, my, at), _products(ex, ey, at) + slack
        low, high = middle - around, middle + around
        if at is not None:
            low, high = (_filled(v, at, alive.shape) for v in (low, high))
        alive = alive & keep(low, high, alive)
        if not alive.any():
            return alive, np.zeros(alive.shape, np.int64)
    at = np.nonzero(alive) if alive.mean() < SPARSE else None
    scores = exact(x, y, at)
    return alive, scores if at is None else _filled(scores, at, alive.shape)


def _filled(values, at, shape):
    out = np.zeros(shape, values.dtype)
    out[at] = values
    return out


def _kth(values, open_, k):
    """Per row the k-th largest of the open values, minus infinity if there are fewer."""
    if values.shape[1] < k:
        return np.full(len(values), -np.inf)
    return np.partition(np.where(open_, values, -np.inf), -k, axis=1)[:, -k]


def _best(scores, open_, k):
    """Places of the k best open scores, ties in order of place."""
    at = np.flatnonzero(open_)
    if len(at) > 4 * k:
        s = scores[at]
        at = at[s >= np.partition(s, -k)[-k]]
    return at[np.argsort(-scores[at], kind="stable")][:k]


class Block:
    """Rows of one block in order of their ids, with summaries."""

    def __init__(self, ids, labels, z):
        order = np.argsort(ids, kind="stable")
        self.ids, self.labels, self.z = ids[order], labels[order], z[order]
        self.sums = summaries(self.z)

    def positives(self, ids, labels, z, k):
        """Per anchor the places and scores of its best rows of the same label, itself left out."""
        sums = summaries(z)
        for label in np.unique(labels).tolist():
            own, here = np.flatnonzero(labels == label), np.flatnonzero(self.labels == label)
            if not len(here):
                continue
            alive = ids[own][:, None] != self.ids[here][None, :]
            alive, scores = refined(z[own], [(m[own], e[own]) for m, e in sums], self.z[here], [(m[here], e[here]) for m, e in self.sums], alive,
                                    lambda low, high, on: high >= _kth(low, on, k)[:, None])
            for i, a in enumerate(own.tolist()):
                for j in _best(scores[i], alive[i], k).tolist():
                    yield a, int(here[j]), int(scores[i, j])

    def negatives(self, labels, z, ranges, k):
        """Per anchor and range [low, high] the places and scores of the best rows of other labels whose scores lie in it."""
        bottom, top = (np.array([[r[p][e] if p < len(r) else (1, 0)[e] for p in range(max(map(len, ranges)))] for r in ranges], np.float64) for e in (0, 1))

        def keep(low, high, on):
            out = np.zeros(on.shape, bool)
            for p in range(bottom.shape[1]):
                b, t = bottom[:, p, None], top[:, p, None]
                kth = _kth(low, on & (low >= b) & (high <= t), k)[:, None]
                out |= (high >= np.maximum(b, kth)) & (low <= t) & (b <= t)
            return out
        alive, scores = refined(z, summaries(z), self.z, self.sums, labels[:, None] != self.labels[None, :], keep)
        for a, own in enumerate(ranges):
            for p, (b, t) in enumerate(own):
                if b <= t:
                    for j in _best(scores[a], alive[a] & (scores[a] >= b) & (scores[a] <= t), k).tolist():
                        yield a, p, j, int(scores[a, j])


def _vectors(df, scale):
    """(id, label, z, dims) of the rows that take part, z as integers."""
    x = F.col("embedding").cast("array<double>")
    rows = df.select(F.col("vec_id").cast("long").alias("id"), F.col("label").cast("int").alias("label"), x.alias("x")).where("id is not null and label is not null and x is not null")
    rows = rows.where(F.size("x").between(1, 4096) & F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < 2.0 ** 16)))
    rows = rows.select("id", "label", F.transform("x", lambda v: F.floor(v * F.lit(float(scale))).cast("int")).alias("z"))
    once = rows.groupBy("id").agg(F.min(F.struct("label", "z")).alias("r"))
    return once.select("id", "r.label", "r.z", F.size("r.z").alias("dims"))


def _met(rows, anchors, blocks, schema, work):
    """``work(block, anchors)`` for every block of rows and batch of anchors, from one stream of each block's rows and then the anchors."""
    extra = [c for c in anchors.columns if c not in rows.columns]
    dealt = rows.select(F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block"), F.lit(0).alias("kind"), "*",
                        *[F.lit(None).cast(anchors.schema[c].dataType).alias(c) for c in extra])
    copies = anchors.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(1).alias("kind"), "*")
    stream = dealt.unionByName(copies).repartition("dims", "block").sortWithinPartitions("dims", "block", "kind")

    def run(batches):
        out, held, at, block = to_arrow_schema(schema), [], None, None
        for b in batches:
            dims, blk, kind = (b.column(c).to_numpy() for c in ("dims", "block", "kind"))
            cuts = np.flatnonzero((dims[1:] != dims[:-1]) | (blk[1:] != blk[:-1]) | (kind[1:] != kind[:-1])) + 1
            for i, j in zip(np.r_[0, cuts].tolist(), np.r_[cuts, b.num_rows].tolist()):
                if i == j:
                    continue
                if (dims[i], blk[i]) != at:
                    at, held, block = (dims[i], blk[i]), [], None
                if kind[i] == 0:
                    held.append(b.slice(i, j - i))
                    continue
                if block is None and held:
                    t = pa.Table.from_batches(held)
                    block, held = Block(t.column("id").to_numpy(), t.column("label").to_numpy(), _matrix(t.column("z").combine_chunks(), at[0])), []
                for s in range(i, j if block else i, BATCH):
                    found = work(block, b.slice(s, min(BATCH, j - s)), at[0])
                    if found:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found), out)], schema=out)
    return stream.mapInArrow(run, schema)


def _matrix(column, dims):
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy().reshape(-1, dims).astype(np.float64)


def _long(*names):
    return StructType([StructField(n, LongType()) for n in names])


def _first(df, by, score, tie, k, rank):
    w = Window.partitionBy(*by).orderBy(F.col(score).desc(), tie)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= k)


def mine(df, anchor, positives=5, negatives=3, low=50, high=95, scale=256):
    """Per anchor (rows for which ``anchor`` holds) and each of its best ``positives`` of the same label, the best ``negatives`` of other labels whose
    score is ``low`` to ``high`` per cent of the positive's: anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``df`` has vec_id, embedding and label."""
    rows = materialize(_vectors(df, scale))
    blocks = max(1, -(-rows.count() // BLOCK))
    anchors = rows.where(F.expr(anchor) if isinstance(anchor, str) else anchor)
    near = _long("anchor_id", "positive_id", "positive_score")

    def find_positives(block, t, dims):
        ids = t.column("id").to_numpy()
        return [(int(ids[a]), int(block.ids[j]), s) for a, j, s in block.positives(ids, t.column("label").to_numpy(), _matrix(t.column("z"), dims), positives)]
    pairs = materialize(_first(_met(rows, anchors, blocks, near, find_positives), ["anchor_id"], "positive_score", "positive_id", positives, "place"))
    ranges = pairs.groupBy(F.col("anchor_id").alias("id")).agg(F.sort_array(F.collect_list(F.struct("place", "positive_id", "positive_score"))).alias("best"))
    asked = materialize(anchors.join(ranges, "id"))

    def find_negatives(block, t, dims):
        ids, best = t.column("id").to_pylist(), t.column("best").to_pylist()
        score = [[p["positive_score"] for p in b] for b in best]
        limits = [[(-(-low * s // 100), high * s // 100) for s in one] for one in score]
        found = block.negatives(t.column("label").to_numpy(), _matrix(t.column("z"), dims), limits, negatives)
        return [(ids[a], best[a][p]["positive_id"], int(block.ids[j]), score[a][p], s) for a, p, j, s in found]
    found = _met(rows, asked, blocks, _long("anchor_id", "positive_id", "negative_id", "positive_score", "negative_score"), find_negatives)
    found = _first(found, ["anchor_id", "positive_id"], "negative_score", "negative_id", negatives, "rank")
    return found.select("anchor_id", "positive_id", F.col("rank").cast(IntegerType()).alias("rank"), "negative_id", "positive_score", "negative_score")
