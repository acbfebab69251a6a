"""Log summaries and cart merging."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def load_summary(log: DataFrame, seconds=10.0) -> DataFrame:
    """Requests, failures, mean, P95 at index floor(0.95 n), and rate per label.

    Latencies are counted per distinct millisecond first, so the rank runs over
    that short list and not over the requests of a label.
    """
    hist = log.groupBy("label", "elapsed").agg(F.count("*").alias("n"), F.count(F.when(~F.col("ok"), 1)).alias("bad"))
    w = Window.partitionBy("label")
    hist = hist.withColumn("end", F.sum("n").over(w.orderBy("elapsed").rowsBetween(Window.unboundedPreceding, 0))).withColumn(
        "total", F.sum("n").over(w))
    at = F.floor(F.col("total") * F.lit(0.95))
    hit = (at < F.col("end")) & (at >= F.col("end") - F.col("n"))
    g = hist.groupBy("label").agg(
        F.max("total").alias("total"), F.sum("bad").alias("failed"), F.sum(F.col("n") * F.col("elapsed")).alias("_ms"),
        F.max(F.when(hit, F.col("elapsed"))).alias("p95_ms"))
    return g.select("label", "total", "failed", F.round(F.col("failed") * 100.0 / F.col("total"), 4).alias("error_pct"),
                    F.round(F.col("_ms") / F.col("total"), 4).alias("mean_ms"), "p95_ms",
                    (F.col("total") / F.lit(float(seconds))).alias("per_second"))


def merge_carts(adds: DataFrame, keep_last=False) -> DataFrame:
    """One cart line per (user, product): quantities of repeated adds are summed."""
    extra = [F.max("created_at").alias("last_added"),
             F.max_by("quantity", F.struct("created_at", "quantity")).alias("last_quantity")] if keep_last else []
    return adds.groupBy("user_id", "product_id").agg(F.sum("quantity").alias("quantity"), *extra)
