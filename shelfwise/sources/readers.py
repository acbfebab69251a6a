"""Readers: invoice CSV, relational tables, stage artifacts, chart JSON, load logs."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from .. import schemas

VIZ_ALIASES = {"Clustering": "phase3", "Churn": "phase4", "SalesForecast": "phase5", "Association": "phase6"}


def read_invoices(spark: SparkSession, path, formats=("yyyy-MM-dd HH:mm:ss", "M/d/yyyy H:mm", "yyyy-MM-dd")) -> DataFrame:
    """Raw invoice lines from a latin-1 CSV with header, typed by an explicit schema."""
    raw = spark.read.csv(path, schema=schemas.INVOICE_CSV, header=True, encoding="ISO-8859-1")
    ts = F.coalesce(*[F.try_to_timestamp("InvoiceDate", F.lit(f)) for f in formats])
    return raw.select(
        F.col("InvoiceNo").alias("invoice_no"), F.col("StockCode").alias("stock_code"),
        F.col("Description").alias("description"), F.col("Quantity").alias("quantity"), ts.alias("invoice_date"),
        F.col("UnitPrice").alias("unit_price"),
        F.expr("CAST(try_cast(CustomerID AS DOUBLE) AS BIGINT)").alias("customer_id"), F.col("Country").alias("country"))


def read_table(spark, path, columns=None, predicate=None) -> DataFrame:
    """Parquet scan with projection and predicate left to pushdown."""
    df = spark.read.parquet(path)
    if predicate is not None:
        df = df.where(predicate)
    return df.select(*columns) if columns else df


def read_jdbc(spark, url, table, column=None, lower=None, upper=None, partitions=None, properties=None) -> DataFrame:
    """Relational scan, split on a numeric column when bounds are given."""
    if column:
        return spark.read.jdbc(url, table, column=column, lowerBound=lower, upperBound=upper,
                               numPartitions=partitions, properties=properties or {})
    return spark.read.jdbc(url, table, properties=properties or {})


def read_artifact(spark, path, schema) -> DataFrame:
    """A stage's output table; an empty frame of ``schema`` when it was never written."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def read_chart(spark, folder, model) -> DataFrame:
    """Chart payload of a model by stage or display name; None when it was never written."""
    try:
        return spark.read.json(f"{folder}/{VIZ_ALIASES.get(model, model)}_viz.json")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def read_load_log(spark, path) -> DataFrame:
    return spark.read.csv(path, header=True, schema=schemas.LOAD_LOG_CSV, enforceSchema=False).select(
        "label", "elapsed", (F.col("success") == "true").alias("ok"))
