"""Cluster profiles, labels and quality measures given labels; fits are in ``clustering``."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions import scalars as X
from ..functions.quantiles import exact_quantiles


def medians(df: DataFrame, key, cols) -> DataFrame:
    """Median of each column per group; the columns are unpivoted so one pass serves all."""
    long = df.select(key, *[F.col(c).cast("double").alias(c) for c in cols]).unpivot([key], cols, "_f", "_x")
    q = exact_quantiles(long, "_x", [0.5], keys=[key, "_f"], edges_per_key=True)
    return q.groupBy(key).agg(*[F.max(F.when(F.col("_f") == c, F.get("q", F.lit(0)))).alias(c) for c in cols])


def cluster_profiles(df: DataFrame, key="cluster", cols=("recency_days", "total_orders", "total_spent")) -> DataFrame:
    """Size, share in percent and medians per cluster."""
    total = df.agg(F.count("*")).scalar()
    sizes = df.groupBy(key).agg(F.count("*").alias("size")).withColumn("pct", F.col("size") * 100.0 / total)
    return sizes.join(medians(df, key, list(cols)), key)


def business_label(cluster, recency, orders, spent, overall) -> Column:
    """Label of a cluster from its medians; the first rule that holds wins."""
    n = S.CLUSTER_LABELS
    return (F.when(cluster == 999, n["outlier"]).when((recency <= 30) & (orders >= 8), n["loyal"])
            .when((recency <= 45) & (orders >= 4) & (spent >= overall), n["high_loyal"])
            .when((recency <= 60) & (orders >= 3), n["active"])
            .when((recency > 180) & (spent < overall * 0.3), n["deep_lost"]).when(recency > 180, n["lost"])
            .when(recency > 120, n["warning"]).when(spent >= overall * 1.5, n["big_rare"])
            .when((orders <= 2) & (recency <= 90), n["new"]).otherwise(n["plain"]))


def label_profiles(profiles: DataFrame, features: DataFrame) -> DataFrame:
    overall = exact_quantiles(features, "total_spent", [0.5]).select(F.get("q", F.lit(0))).scalar()
    return profiles.withColumn("_g", overall).withColumn("label", business_label(
        F.col("cluster"), F.col("recency_days"), F.col("total_orders"), F.col("total_spent"), F.col("_g"))).drop("_g")


def label_ratios(profiles: DataFrame) -> DataFrame:
    """Shares summed over clusters that carry the same (renamed) label."""
    named = F.coalesce(X.lookup("label", S.SEGMENT_ALIASES), F.col("label"))
    return profiles.groupBy(named.alias("label")).agg(F.sum("pct").alias("pct"))


def write_segments(rfm: DataFrame, labels: DataFrame, profiles: DataFrame) -> DataFrame:
    """Result rows: RFM values with the renamed label of the customer's cluster."""
    named = F.coalesce(X.lookup("label", S.SEGMENT_ALIASES), F.col("label"))
    seg = profiles.select("cluster", named.alias("segment"))
    return labels.join(F.broadcast(seg), "cluster", "left").select(
        "customer_id", "cluster", F.coalesce("segment", F.concat(F.lit("Cluster_"), F.col("cluster"))).alias("segment")).join(
        rfm, "customer_id")


def balance_ok(labels: DataFrame, min_size=30, max_share=0.65) -> DataFrame:
    """One row: are all clusters large enough, at least two, and none too dominant."""
    g = labels.groupBy("cluster").agg(F.count("*").alias("n"))
    return g.agg(((F.min("n") >= min_size) & (F.count("*") >= 2) & (F.max("n") / F.sum("n") < max_share)).alias("balanced"))


def dispersion_scores(df: DataFrame, cols, key="cluster") -> DataFrame:
    """Davies-Bouldin and Calinski-Harabasz from centroids and within-cluster spread.

    Points are compared with their own centroid only; the pairwise part is
    between clusters, whose number the fit fixes, so centroids travel to the rows.
    """
    cent = df.groupBy(key).agg(F.count("*").alias("n"), F.array(*[F.avg(c) for c in cols]).alias("mu"))
    all_mu = df.agg(F.array(*[F.avg(c) for c in cols])).scalar()

    def sq(a, b):
        return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v)
    pts = df.select(key, F.array(*[F.col(c).cast("double") for c in cols]).alias("x")).join(F.broadcast(cent), key)
    within = pts.groupBy(key).agg(F.avg(F.sqrt(sq(F.col("x"), F.col("mu")))).alias("s"), F.sum(sq(F.col("x"), F.col("mu"))).alias("w"))
    c = cent.join(within, key).withColumn("_all", all_mu).withColumn("b", F.col("n") * sq(F.col("mu"), F.col("_all")))
    others = c.select(F.collect_list(F.struct(key, "mu", "s"))).scalar()
    ratio = F.array_max(F.transform(
        F.filter("_o", lambda o: o[key] != F.col(key)),
        lambda o: F.try_divide(F.col("s") + o["s"], F.sqrt(sq(F.col("mu"), o["mu"])))))
    g = c.withColumn("_o", others).withColumn("r", ratio).agg(
        F.avg("r").alias("davies_bouldin"), F.sum("b").alias("_b"), F.sum("w").alias("_w"), F.sum("n").alias("_n"),
        F.count("*").alias("_k"))
    return g.select("davies_bouldin", (F.col("_b") * (F.col("_n") - F.col("_k")) / (F.col("_w") * (F.col("_k") - 1))).alias("calinski_harabasz"))


def adjusted_rand(pairs: DataFrame, a="a", b="b", weight=None, keys=()) -> DataFrame:
    """Adjusted Rand index of two labelings from their contingency counts, for each group of ``keys``."""
    keys = list(keys)

    def c2(n):
        return F.col(n) * (F.col(n) - 1) / 2

    def pairs_in(t, *by):
        g = t.groupBy(*keys, *by).agg(F.sum("n").alias("n")) if by else t
        return g.groupBy(*keys).agg(F.sum(c2("n")).alias("_p"))
    t = pairs.groupBy(*keys, a, b).agg((F.sum(weight) if weight else F.count("*")).alias("n"))
    g = t.groupBy(*keys).agg(F.sum(c2("n")).alias("s"), F.sum("n").alias("n"))
    for name, by in (("ra", a), ("rb", b)):
        side = pairs_in(t, by).withColumnRenamed("_p", name)
        g = g.join(side, keys) if keys else g.withColumn(name, side.scalar())
    exp = F.col("ra") * F.col("rb") / (F.col("n") * (F.col("n") - 1) / 2)
    top = (F.col("ra") + F.col("rb")) / 2
    return g.select(*keys, F.coalesce(F.try_divide(F.col("s") - exp, top - exp), F.lit(1.0)).alias("ari"))
