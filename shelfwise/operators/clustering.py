"""Cluster fits, K search, stability and projections on Spark ML.

Inputs are materialised feature frames with one row per customer. Loops run over
candidate models; every fit and every score reads the whole frame in parallel.
"""

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.ml.clustering import BisectingKMeans, GaussianMixture, KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.quantiles import attach_quantiles
from .segments import adjusted_rand, balance_ok

ID = "customer_id"


def vectors(df: DataFrame, cols, out="features") -> DataFrame:
    return VectorAssembler(inputCols=list(cols), outputCol=out).transform(df)


def robust_scale(df: DataFrame, cols, prefix="r_") -> DataFrame:
    """(x - median) / IQR with exact quartiles; a zero range scales by 1."""
    d = attach_quantiles(df, cols, [0.25, 0.5, 0.75])

    def q(c, i):
        return F.get(F.col(f"_q.{c}"), F.lit(i))
    return d.withColumns({
        prefix + c: (F.col(c) - q(c, 1)) / F.coalesce(F.nullif(q(c, 2) - q(c, 0), F.lit(0.0)), F.lit(1.0)) for c in cols}).drop("_q")


def _yeo_johnson(x, lam):
    up = F.log1p(x) if abs(lam) < 1e-9 else (F.pow(x + 1, F.lit(lam)) - 1) / lam
    down = -F.log1p(-x) if abs(lam - 2) < 1e-9 else -(F.pow(1 - x, F.lit(2 - lam)) - 1) / (2 - lam)
    return F.when(x >= 0, up).otherwise(down)


def yeo_johnson(df: DataFrame, cols, grid=tuple(i / 4 for i in range(-8, 9)), prefix="y_") -> DataFrame:
    """Power-transform each column with the grid value of best likelihood, then standardise.

    One aggregate with a row per column scores the whole grid.
    """
    x = F.col("x")
    long = df.select([F.col(c).cast("double").alias(c) for c in cols]).unpivot([], list(cols), "f", "x")
    stats = {r["f"]: r for r in long.groupBy("f").agg(
        F.count("*").alias("n"), F.sum(F.signum(x) * F.log1p(F.abs(x))).alias("j"),
        F.array(*[F.avg(_yeo_johnson(x, g)) for g in grid]).alias("m"),
        F.array(*[F.stddev_pop(_yeo_johnson(x, g)) for g in grid]).alias("s")).collect()}
    out = {}
    for c in cols:
        r = stats[c]
        fit = [-np.inf if not s else -r["n"] * np.log(s) + (g - 1) * r["j"] for g, s in zip(grid, r["s"])]
        best = int(np.argmax(fit))
        out[prefix + c] = (_yeo_johnson(F.col(c).cast("double"), grid[best]) - r["m"][best]) / (r["s"][best] or 1.0)
    return df.withColumns(out)


def fit_kmeans(df: DataFrame, k, seed=42, weight=None, max_iter=50):
    m = KMeans(k=k, seed=seed, maxIter=max_iter, initMode="k-means||", featuresCol="features", predictionCol="cluster")
    return (m.setWeightCol(weight) if weight else m).fit(df)


def silhouette(df: DataFrame) -> float:
    """Mean silhouette with squared distances, linear in the rows."""
    return ClusteringEvaluator(featuresCol="features", predictionCol="cluster").evaluate(df)


def isolate_outliers(df: DataFrame, k_init=5, min_size=50, seed=42) -> DataFrame:
    """First-pass clusters below ``min_size`` are marked as outliers."""
    first = fit_kmeans(df, k_init, seed).transform(df).withColumnRenamed("cluster", "_c")
    small = first.groupBy("_c").agg((F.count("*") < min_size).alias("is_outlier"))
    return first.join(F.broadcast(small), "_c").drop("_c")


def search_k(df: DataFrame, ks=range(3, 8), seed=42):
    """(k, silhouette) of every candidate; the list has one entry per k."""
    return [(k, silhouette(fit_kmeans(df, k, seed).transform(df))) for k in ks]


def combine_labels(fitted: DataFrame, outliers: DataFrame) -> DataFrame:
    """Final labels: fitted clusters, and 999 for outliers."""
    return fitted.select(ID, "cluster").unionByName(outliers.select(ID, F.lit(999).alias("cluster")))


def bisecting(df: DataFrame, k, seed=42, min_size=30):
    """Hierarchical clusters by bisection, with whether they are balanced enough to be accepted."""
    lab = BisectingKMeans(k=k, seed=seed, featuresCol="features", predictionCol="cluster").fit(df).transform(df)
    return lab, balance_ok(lab, min_size)


def mixture(df: DataFrame, k, n_features, seed=42):
    """Gaussian mixture labels with BIC and AIC."""
    m = GaussianMixture(k=k, seed=seed, featuresCol="features", predictionCol="cluster", probabilityCol="prob").fit(df)
    n = df.count()
    params = k * (n_features + n_features * (n_features + 1) / 2) + k - 1
    ll = m.summary.logLikelihood
    return m.transform(df).drop("prob"), {"bic": params * float(np.log(n)) - 2 * ll, "aic": 2 * params - 2 * ll}


def poisson_weight(key, seed):
    """Bootstrap multiplicity of a row: a Poisson(1) draw from the hash of its key."""
    u = F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(1_000_000)) / 1_000_000
    p, cum, out = np.exp(-1.0), np.exp(-1.0), None
    for i in range(6):
        out = F.when(u < float(cum), i) if out is None else out.when(u < float(cum), i)
        p = p / (i + 1)
        cum += p
    return out.otherwise(6)


def stability(df: DataFrame, labels: DataFrame, k, rounds=30, seed=42):
    """Adjusted Rand index of refits on bootstrap weights against the base labels, one per round."""
    base = df.join(labels.select(ID, F.col("cluster").alias("base")), ID)
    out = []
    for i in range(rounds):
        w = base.withColumn("w", poisson_weight(ID, seed + i)).where("w > 0")
        got = fit_kmeans(w, k, seed + i, "w", 20).transform(w)
        out.append(adjusted_rand(got, "base", "cluster", "w").first()[0])
    return out


def hopkins(df: DataFrame, n_features, sample=200, seed=42) -> float:
    """Clusterability: nearest-neighbour distances of sampled rows against those of uniform points.

    At most ``sample`` rows and as many uniform points are sent to the tasks;
    each task returns its nearest distance per point and the minimum is reduced.
    """
    arr = df.select(ID, vector_to_array("features").alias("x"))
    box = arr.agg(*[F.min(F.get("x", F.lit(i))).alias(f"a{i}") for i in range(n_features)],
                  *[F.max(F.get("x", F.lit(i))).alias(f"b{i}") for i in range(n_features)], F.count("*").alias("n")).first()
    s = max(1, min(sample, box["n"] // 2))
    picked = arr.orderBy(F.xxhash64(ID, F.lit(seed)), ID).limit(s).toPandas()
    rng = np.random.default_rng(seed)
    lo, hi = np.array([box[f"a{i}"] for i in range(n_features)]), np.array([box[f"b{i}"] for i in range(n_features)])
    probes = np.vstack([np.vstack(picked["x"].to_numpy()), rng.uniform(lo, hi, (s, n_features))])
    ids = np.concatenate([picked[ID].to_numpy(), np.full(s, -1)])

    def nearest(batches):
        for b in batches:
            if len(b):
                x = np.vstack(b["x"].to_numpy())
                d = np.maximum((x ** 2).sum(1)[:, None] - 2 * x @ probes.T + (probes ** 2).sum(1)[None, :], 0)
                d[b[ID].to_numpy()[:, None] == ids[None, :]] = np.inf
                yield pd.DataFrame({"i": np.arange(len(ids)), "d": np.sqrt(d.min(0))})
    best = arr.mapInPandas(nearest, "i int, d double").groupBy("i").agg(F.min("d").alias("d"))
    r = best.agg(F.sum(F.when(F.col("i") < s, F.col("d"))).alias("a"), F.sum("d").alias("t")).first()
    return r["a"] / r["t"]


def project_2d(df: DataFrame) -> DataFrame:
    p = PCA(k=2, inputCol="features", outputCol="_p").fit(df).transform(df)
    a = vector_to_array("_p")
    return p.withColumns({"x": F.get(a, F.lit(0)), "y": F.get(a, F.lit(1))}).drop("_p")


def segment_customers(df: DataFrame, cols, ks=range(3, 8), k_init=5, min_size=50, seed=42):
    """Outlier isolation, K search and the final fit; returns labels, K and silhouette.

    ``min_size`` is the smallest first-fit cluster that is no outlier; for few customers pass a smaller one."""
    from ..session import materialize
    marked = materialize(isolate_outliers(vectors(df, cols), k_init, min_size, seed))
    normal = marked.where("NOT is_outlier")
    k, sil = max(search_k(normal, ks, seed), key=lambda r: r[1])
    labels = combine_labels(fit_kmeans(normal, k, seed).transform(normal), marked.where("is_outlier"))
    return labels, k, sil


def union_rows(frames):
    return reduce(lambda a, b: a.unionByName(b), frames)
