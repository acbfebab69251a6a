"""Recency, frequency and monetary scoring and segments."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions import scalars as X


def segment_of(r, f, m) -> Column:
    """Five-way segment; the first rule that holds wins."""
    return (F.when((r >= 4) & (f >= 4) & (m >= 4), S.SEG_HIGH)
            .when((r >= 3) & (f >= 3) & (m >= 3), S.SEG_POTENTIAL)
            .when((r <= 2) & (f <= 2) & (m <= 2), S.SEG_LOW)
            .when((r <= 2) & (f >= 3), S.SEG_AT_RISK)
            .otherwise(S.SEG_GENERAL))


def profile_segment_of(r, f, m) -> Column:
    """The profile stage's own rules and names."""
    n = S.PROFILE_SEGMENTS
    return (F.when(r <= 2, n["at_risk"]).when((f >= 4) & (m >= 4), n["high"])
            .when((r >= 4) & (f >= 3), n["loyal"]).when((r >= 3) & (f >= 2), n["potential"]).otherwise(n["general"]))


def score_rfm(df: DataFrame, unit="cents") -> DataFrame:
    """Add scores, their sum and the segment to (recency, frequency, monetary)."""
    df = df.withColumns({
        "r_score": X.r_score(F.col("recency")), "f_score": X.f_score(F.col("frequency")),
        "m_score": X.m_score(F.col("monetary"), unit)})
    r, f, m = F.col("r_score"), F.col("f_score"), F.col("m_score")
    return df.withColumn("rfm_score", r + f + m).withColumn("segment", segment_of(r, f, m))


def rfm_from_orders(orders: DataFrame, as_of: DataFrame) -> DataFrame:
    """RFM of every user from revenue orders, as of the one-row date frame."""
    base = orders.where(F.col("status").isin(*S.REVENUE_STATUSES)).groupBy("user_id").agg(
        F.max("created_at").alias("_last"), F.count("*").alias("frequency"), F.sum("total_cents").alias("monetary"))
    return score_rfm(base.select("user_id", F.datediff(as_of.scalar(), "_last").alias("recency"), "frequency", "monetary"))


def rfm_from_profile(features: DataFrame) -> DataFrame:
    """Scores in pounds with the profile stage's segment rules."""
    df = features.select("customer_id", F.col("recency_days").alias("recency"), F.col("total_orders").alias("frequency"),
                         F.col("total_spent").alias("monetary"))
    df = df.withColumns({"r_score": X.r_score(F.col("recency")), "f_score": X.f_score(F.col("frequency")),
                         "m_score": X.m_score(F.col("monetary"), "pounds")})
    return df.withColumn("segment", profile_segment_of(F.col("r_score"), F.col("f_score"), F.col("m_score")))


def rename_segments(df: DataFrame, col="segment") -> DataFrame:
    """Replace the three aliased names, keep the others."""
    return df.withColumn(col, F.coalesce(X.lookup(col, S.SEGMENT_ALIASES), F.col(col)))
