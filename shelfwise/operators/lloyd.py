"""K-means for many starts, sizes and bootstrap samples at once.

All fits share their passes: a Lloyd step reads the rows once, a task sums up (fit, cluster) for all fits and sends one row for
each, and the driver holds nothing but the centres, whose number the caller sets. Fits may differ in their number of clusters.
"""

import math

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .segments import adjusted_rand

ID = "customer_id"
#: Chances that a Poisson draw of mean 1 is at most 0, 1, 2, ...; what lies above the last is below one in 10^17.
POISSON = np.cumsum([math.exp(-1) / math.factorial(j) for j in range(18)])


def points(df: DataFrame) -> DataFrame:
    """Key and coordinates of a frame with a vector column ``features``."""
    return df.select(F.col(ID).cast("long").alias("id"), vector_to_array("features").alias("x"))


def bootstrap_weights(ids, rounds, seed):
    """How often each row counts in each of ``rounds`` samples: Poisson draws from 53 bits of a hash of key, round and seed."""
    with np.errstate(over="ignore"):
        h = ids.astype(np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15) + np.arange(1, rounds + 1, dtype=np.uint64)[None, :] * np.uint64(0xD6E8FEB86659FD93) + np.uint64(seed)
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, 1)):
            h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
    return np.searchsorted(POISSON, (h >> np.uint64(11)).astype(np.float64) / 2.0 ** 53, side="right")


def _matrix(batch):
    return batch.column("id").to_numpy(), batch.column("x").flatten().to_numpy().reshape(batch.num_rows, -1)


def _distances(x, centres):
    d = (x ** 2).sum(1)[:, None] - 2 * x @ centres.T + (centres ** 2).sum(1)[None, :]
    return np.maximum(d, 0)


def _assigned(x, centres):
    """Nearest centre and squared distance of each row for each fit."""
    flat = _distances(x, np.vstack(centres))
    out, at = [], 0
    for c in centres:
        d = flat[:, at:at + len(c)]
        at += len(c)
        nearest = d.argmin(1)
        out.append((nearest, d[np.arange(len(x)), nearest]))
    return out


def cluster_sums(pts: DataFrame, centres, samples=None) -> DataFrame:
    """One pass: per fit and cluster the weight, the sum of the rows, of their squared norms and of their squared distances.

    ``samples``: (rounds, seed) of bootstrap weights, round i for fit i."""
    dims = centres[0].shape[1]

    def run(batches):
        total = [np.zeros((len(c), dims + 3)) for c in centres]
        for b in batches:
            if b.num_rows:
                ids, x = _matrix(b)
                w = bootstrap_weights(ids, *samples) if samples else None
                full = np.hstack([np.ones((len(x), 1)), x, (x ** 2).sum(1)[:, None]])
                for i, (near, d) in enumerate(_assigned(x, centres)):
                    rows = np.hstack([full, d[:, None]])
                    np.add.at(total[i], near, rows if w is None else rows * w[:, i, None])
        rows = [(i, j, v.tolist()) for i, t in enumerate(total) for j, v in enumerate(t)]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int32(), pa.int32(), pa.list_(pa.float64())))], ["fit", "cluster", "s"])
    sent = pts.mapInArrow(run, "fit int, cluster int, s array<double>")
    return sent.groupBy("fit", "cluster").agg(F.array(*[F.sum(F.get("s", F.lit(k))) for k in range(dims + 3)]).alias("s"))


def _collected(sums, centres):
    out = [np.zeros((len(c), c.shape[1] + 3)) for c in centres]
    for r in sums.collect():  # a row a fit and cluster
        out[r["fit"]][r["cluster"]] = r["s"]
    return out


def starts(pts: DataFrame, ks, tries=10, seed=42, sample=2000):
    """Spread first centres for each k, ``tries`` times: k-means++ on a bounded sample of the rows, taken by a hash of their keys."""
    rows = np.array([r["x"] for r in pts.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(sample).collect()])
    rng, out = np.random.default_rng(seed), []
    for k in ks:
        for _ in range(tries):
            c = [rows[rng.integers(len(rows))]]
            while len(c) < k:
                d = _distances(rows, np.array(c)).min(1)
                c.append(rows[rng.choice(len(rows), p=d / d.sum())] if d.sum() > 0 else rows[rng.integers(len(rows))])
            out.append(np.array(c))
    return out


def fit(pts: DataFrame, centres, samples=None, max_iter=50, tol=1e-6):
    """Lloyd steps for all fits until no centre of any moves by more than ``tol``: (centres, inertia of each fit). A cluster that
    loses its rows keeps its centre."""
    for _ in range(max_iter):
        sums = _collected(cluster_sums(pts, centres, samples), centres)
        moved = [np.where(s[:, :1] > 0, s[:, 1:-2] / np.maximum(s[:, :1], 1e-300), c) for s, c in zip(sums, centres)]
        still = max(float(np.abs(m - c).max()) for m, c in zip(moved, centres)) <= tol
        centres = moved
        if still:
            break
    return centres, [float(s[:, -1].sum()) for s in _collected(cluster_sums(pts, centres, samples), centres)]


def best_starts(pts: DataFrame, ks, tries=10, seed=42, **kw):
    """Per k the centres of least inertia of ``tries`` starts, and that inertia; all starts of all k run together."""
    ks = list(ks)
    centres, inertia = fit(pts, starts(pts, ks, tries, seed), **kw)
    out = {}
    for i, k in enumerate(ks):
        j = min(range(i * tries, (i + 1) * tries), key=lambda f: inertia[f])
        out[k] = (centres[j], inertia[j])
    return out


def silhouettes(pts: DataFrame, centres):
    """Mean silhouette with squared distances of each fit, in two passes for all of them; a cluster of one row scores 0."""
    sums = _collected(cluster_sums(pts, centres), centres)

    def run(batches):
        total = np.zeros((len(centres), 2))
        for b in batches:
            if b.num_rows:
                _, x = _matrix(b)
                norm = (x ** 2).sum(1)[:, None]
                for i, ((near, _), s) in enumerate(zip(_assigned(x, centres), sums)):
                    n = s[:, 0]
                    apart = norm * n + s[:, -2] - 2 * x @ s[:, 1:-2].T  # sums of squared distances to each cluster's rows
                    own, at = n[near], np.arange(len(x))
                    a = apart[at, near] / np.maximum(own - 1, 1)
                    other = np.where(n > 0, apart / np.maximum(n, 1), np.inf)
                    other[at, near] = np.inf
                    c = other.min(1)
                    v = np.where((own > 1) & np.isfinite(c) & (np.maximum(a, c) > 0), (c - a) / np.maximum(np.maximum(a, c), 1e-300), 0.0)
                    total[i] += v.sum(), len(v)
        yield pa.RecordBatch.from_arrays([pa.array(range(len(centres)), pa.int32()), pa.array(total[:, 0]), pa.array(total[:, 1])], ["fit", "s", "n"])
    g = pts.mapInArrow(run, "fit int, s double, n double").groupBy("fit").agg((F.sum("s") / F.sum("n")).alias("v"))
    found = {r["fit"]: r["v"] for r in g.collect()}  # a row a fit
    return [found[i] for i in range(len(centres))]


def labels(pts: DataFrame, centres) -> DataFrame:
    """Nearest of one fit's centres for each row: (customer_id, cluster)."""
    def run(batches):
        for b in batches:
            if b.num_rows:
                ids, x = _matrix(b)
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(_assigned(x, [centres])[0][0], pa.int32())], [ID, "cluster"])
    return pts.mapInArrow(run, f"{ID} long, cluster int")


def stability(pts: DataFrame, base, rounds=30, seed=42, max_iter=50):
    """Adjusted Rand index of refits on ``rounds`` bootstrap samples against the labels of the ``base`` centres, one row a round.

    The refits start from the base's centres and run together; a pass counts how often each pair of labels meets."""
    centres, _ = fit(pts, [base] * rounds, (rounds, seed), max_iter)
    k = len(base)

    def run(batches):
        total = np.zeros((rounds, k, k), np.int64)
        for b in batches:
            if b.num_rows:
                ids, x = _matrix(b)
                w, old = bootstrap_weights(ids, rounds, seed), _assigned(x, [base])[0][0]
                for i, (near, _) in enumerate(_assigned(x, centres)):
                    np.add.at(total[i], (old, near), w[:, i])
        i, a, b = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(v, pa.int32()) for v in (i + 1, a, b)] + [pa.array(total[i, a, b])], ["round", "a", "b", "n"])
    met = pts.mapInArrow(run, "round int, a int, b int, n long").groupBy("round", "a", "b").agg(F.sum("n").alias("n"))
    return adjusted_rand(met, weight="n", keys=["round"])
