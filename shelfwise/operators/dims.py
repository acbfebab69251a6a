"""Dimension and header builds from invoice lines, lookups and set operations."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as X
from ..functions.quantiles import exact_quantiles
from ..session import materialize


def product_dimension(lines: DataFrame) -> DataFrame:
    """One row per stock code: first description, category, median price in cents."""
    prices = materialize(lines.groupBy("stock_code", "unit_price").agg(F.min("description").alias("description"), F.count(F.lit(1)).alias("_n")))
    first = prices.groupBy("stock_code").agg(F.min("description").alias("description"))
    med = exact_quantiles(prices, "unit_price", [0.5], keys=["stock_code"], weight="_n")
    return first.join(med, "stock_code").select(
        "stock_code", "description", X.category_name(X.categorize(F.col("description"))).alias("category_name"),
        X.short_name(F.col("description")).alias("short_name"), F.get("q", F.lit(0)).alias("median_price"))


def user_dimension(lines: DataFrame) -> DataFrame:
    """One row per customer: first country, address code and pseudonym."""
    first, last = X.pseudonym(F.col("customer_id"))
    return lines.groupBy("customer_id").agg(F.min("country").alias("country")).select(
        "customer_id", F.coalesce("country", F.lit("Unknown")).alias("country"),
        X.email_of(F.col("customer_id")).alias("email"), first.alias("first_name"), last.alias("last_name"))


def order_headers(lines: DataFrame) -> DataFrame:
    """One row per invoice: its customer, date and total in cents."""
    return lines.groupBy("invoice_no").agg(
        F.min("customer_id").alias("customer_id"), F.to_date(F.min("invoice_date")).alias("order_date"),
        F.sum("line_cents").alias("total_cents"), F.count("*").alias("n_lines"))


def order_items(lines: DataFrame) -> DataFrame:
    """Item rows keyed by a stable hash of the invoice number, so a re-run gives the same ids."""
    return lines.select(F.xxhash64("invoice_no").alias("order_id"), "invoice_no", "stock_code",
                        F.col("quantity").cast("long").alias("quantity"), "line_cents")


def resolve_users(customers: DataFrame, users: DataFrame) -> DataFrame:
    """Match customer ids with user ids through the address code; others drop out."""
    ids = users.select("user_id", X.customer_of(F.col("email")).alias("customer_id")).where("customer_id IS NOT NULL")
    return customers.join(ids, "customer_id")


def with_names(facts: DataFrame, products=None, users=None) -> DataFrame:
    """Facts with product and user names, kept when a side is missing."""
    if products is not None:
        facts = facts.join(products.select("product_id", F.col("name").alias("product_name")), "product_id", "left")
    if users is not None:
        facts = facts.join(users.select("user_id", F.col("name").alias("user_name")), "user_id", "left")
    return facts


def cart_lines(carts: DataFrame, products: DataFrame) -> DataFrame:
    return carts.join(products.select("product_id", "price", "stock", "is_active"), "product_id").withColumn(
        "subtotal", F.col("price") * F.col("quantity"))


def first_label_purchase(train: DataFrame, label: DataFrame) -> DataFrame:
    """Train customers with their first purchase day in the label window, null when there is none."""
    f = label.groupBy("customer_id").agg(F.to_date(F.min("invoice_date")).alias("first_label"))
    return train.select("customer_id").distinct().join(f, "customer_id", "left")


def churn_labels(train: DataFrame, label: DataFrame) -> DataFrame:
    """1 for train customers absent from the label window."""
    seen = label.select("customer_id").distinct().withColumn("_seen", F.lit(True))
    return train.select("customer_id").distinct().join(seen, "customer_id", "left").select(
        "customer_id", F.when(F.col("_seen").isNull(), 1).otherwise(0).alias("is_churn"))


def inject_clusters(customers: DataFrame, labels: DataFrame, values, keep_id=True) -> DataFrame:
    """Cluster id (-1 when unknown) with one 0/1 column per known cluster."""
    j = customers.join(labels.select("customer_id", F.col("cluster").alias("cluster_id")), "customer_id", "left")
    j = j.withColumn("cluster_id", F.coalesce("cluster_id", F.lit(-1)))
    j = j.withColumns({f"cluster_{v}": (F.col("cluster_id") == v).cast("int") for v in values})
    return j if keep_id else j.drop("cluster_id")


def near_holiday(dates: DataFrame, holidays, days=7, date_col="date") -> DataFrame:
    """Flag dates within ``days`` of a holiday.

    Every holiday is widened to the days it covers, so the match is an equality
    on a short fixed list instead of a range join.
    """
    h = dates.sparkSession.createDataFrame([(d,) for d in holidays], "d string")
    spread = h.select(F.explode(F.sequence(F.date_sub(F.to_date("d"), days), F.date_add(F.to_date("d"), days),
                                           F.expr("INTERVAL 1 DAY"))).alias(date_col)).distinct().withColumn("_h", F.lit(1))
    return dates.join(F.broadcast(spread), date_col, "left").withColumn("has_holiday", F.coalesce("_h", F.lit(0))).drop("_h")


def match_rule_products(rules: DataFrame, products: DataFrame, text="consequent") -> DataFrame:
    """Rule ids paired with products whose name equals one of the comma-listed items."""
    parts = rules.select("rule_id", F.explode(F.array_distinct(F.split(F.col(text), ", "))).alias("item"))
    names = products.select("product_id", F.upper(F.trim("name")).alias("key"))
    return parts.select("rule_id", F.upper(F.trim("item")).alias("key")).join(names, "key").select("rule_id", "product_id")


def match_contained(rules: DataFrame, products: DataFrame, text="consequent") -> DataFrame:
    """Rule ids paired with products whose name occurs anywhere in the rule text.

    All substrings with the length of some product name are looked up by
    equality: the work is text length times the number of distinct name lengths.
    """
    names = products.select("product_id", F.col("name").alias("key")).where("length(key) > 0")
    lengths = names.agg(F.collect_set(F.length("key")))
    r = rules.select("rule_id", F.col(text).alias("t")).withColumn("_ls", lengths.scalar())
    r = r.select("rule_id", "t", F.explode("_ls").alias("n")).where("n <= length(t)")
    grams = r.select("rule_id", F.explode(F.transform(
        F.sequence(F.lit(1), F.length("t") - F.col("n") + 1), lambda i: F.substring("t", i, F.col("n")))).alias("key")).distinct()
    return grams.join(names, "key").select("rule_id", "product_id")


def align_features(base: DataFrame, current: DataFrame, features) -> DataFrame:
    """Both sides in long form, matched by feature name: counts and means of what is present."""
    def side(df, tag):
        long = df.select([F.col(c).cast("double").alias(c) for c in features if c in df.columns]).unpivot(
            [], [c for c in features if c in df.columns], "feature", "value")
        return long.groupBy("feature").agg(F.count("value").alias(f"n_{tag}"), F.avg("value").alias(f"mean_{tag}"))
    return side(base, "base").join(side(current, "current"), "feature", "full_outer")
