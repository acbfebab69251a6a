"""Ingest cleaning of invoice lines."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.quantiles import attach_quantiles, exact_quantiles
from ..session import materialize

KEY_FIELDS = ("customer_id", "invoice_no", "stock_code", "description")


def drop_missing_keys(df: DataFrame, fields=KEY_FIELDS) -> DataFrame:
    return df.na.drop(subset=[f for f in fields if f in df.columns])


def drop_cancelled(df: DataFrame) -> DataFrame:
    """Without cancelled invoices: a flag column, or the C prefix of the invoice number."""
    if "cancelled" in df.columns:
        return df.where(~F.col("cancelled"))
    return df.where(~F.col("invoice_no").startswith("C"))


def positive_lines(df: DataFrame) -> DataFrame:
    return df.where((F.col("quantity") > 0) & (F.col("unit_price") > 0))


def with_line_total(df: DataFrame) -> DataFrame:
    return df.withColumn("line_total", F.col("quantity") * F.col("unit_price")).withColumn(
        "invoice_day", F.to_date("invoice_date"))


def iqr_fences(df: DataFrame, cols=("quantity", "unit_price"), k=3.0) -> DataFrame:
    """Keep rows within k inter-quartile ranges of the quartiles, column by column: each column's quartiles come from the rows
    that the fences before kept.

    All quartiles come from one written table of the columns' distinct values and their counts, so the rows are read once for
    it and once for the filter. A column without values keeps all rows.
    """
    counts = materialize(df.groupBy(*cols).agg(F.count(F.lit(1)).alias("_n")))
    for c in cols:
        q = exact_quantiles(counts, c, [0.25, 0.75], weight="_n").select("q").scalar()
        lo, hi = F.get(q, F.lit(0)), F.get(q, F.lit(1))
        inside = q.isNull() | F.col(c).between(lo - k * (hi - lo), hi + k * (hi - lo))
        df, counts = df.where(inside), counts.where(inside)
    return df


def iqr_fence(df: DataFrame, col, k=3.0) -> DataFrame:
    """Keep rows within k inter-quartile ranges of the quartiles."""
    return iqr_fences(df, [col], k)


def normalize_description(df: DataFrame, col="description") -> DataFrame:
    return df.withColumn(col, F.upper(F.trim(F.col(col)))).where(F.col(col) != "")


def fill_features(df: DataFrame, cols) -> DataFrame:
    """Null, NaN and infinite features become 0."""
    def clean(c):
        bad = F.isnan(c) | (F.abs(c) == float("inf"))
        return F.when(bad, 0.0).otherwise(F.coalesce(c, F.lit(0.0)))
    return df.withColumns({c: clean(F.col(c).cast("double")) for c in cols})


def impute_median(df: DataFrame, cols) -> DataFrame:
    """Nulls become the column's median; the medians of all columns come from one reading of the rows."""
    med = attach_quantiles(df, list(cols), [0.5])
    return med.withColumns({c: F.coalesce(F.col(c).cast("double"), F.get(F.col(f"_q.{c}"), F.lit(0))) for c in cols}).drop("_q")


def temporal_split(df: DataFrame, cut_date, ts="invoice_date"):
    """Lines up to the cut, and lines from the next day on."""
    cut = F.lit(cut_date).cast("timestamp")
    return df.where(F.col(ts) <= cut), df.where(F.col(ts) >= F.date_add(F.lit(cut_date).cast("date"), 1))


def purge_split(orders, users, keep_suffix):
    """Orders of accounts whose address has the suffix, and the orders to purge."""
    kept = users.where(F.col("email").endswith(keep_suffix))
    return orders.join(kept, "user_id", "left_semi"), orders.join(kept, "user_id", "left_anti")
