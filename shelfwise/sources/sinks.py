"""Result tables: refresh, skip-if-present, append, upsert, JSON export."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def full_refresh(df: DataFrame, path, partition_by=(), partitions_only=False):
    """Replace a result table; with ``partitions_only`` just the partitions present in ``df``."""
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    if partitions_only:
        w = w.option("partitionOverwriteMode", "dynamic")
    w.parquet(path)


def write_if_absent(df: DataFrame, path):
    """Leave an existing result table alone."""
    df.write.mode("ignore").parquet(path)


def append(df: DataFrame, path):
    df.write.mode("append").parquet(path)


def append_jdbc(df: DataFrame, url, table, batch_rows=1000, properties=None):
    """Append over JDBC in batches of ``batch_rows``."""
    df.write.mode("append").option("batchsize", batch_rows).jdbc(url, table, properties=properties or {})


def upsert_latest(df: DataFrame, keys, order) -> DataFrame:
    """One row per key, the latest by ``order``: a mergeable aggregate, so hot keys combine map-side."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(
        *keys, *[F.col(f"_r.{c}").alias(c) for c in rest])


def upsert_metrics(old: DataFrame, new: DataFrame) -> DataFrame:
    """Old and new metric rows merged by (model, metric); new rows win on equal time."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    return upsert_latest(both, ["model_name", "metric_name"], ["created_at", "_new"]).drop("_new")


def to_json_rows(df: DataFrame, out="payload") -> DataFrame:
    """One JSON string per row, for chart payloads."""
    return df.select(F.to_json(F.struct(*df.columns)).alias(out))


def export_json(df: DataFrame, path):
    df.write.mode("overwrite").json(path)
