"""Dashboard, trend, preference and rating queries."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions import scalars as X


def revenue_orders(orders: DataFrame) -> DataFrame:
    return orders.where(F.col("status").isin(*S.REVENUE_STATUSES))


def user_rfm_cards(users: DataFrame, rfm: DataFrame) -> DataFrame:
    """Every user's RFM with advice; users without orders get the starter record."""
    j = users.select("user_id").join(rfm, "user_id", "left")
    num = {c: F.coalesce(F.col(c), F.lit(0)) for c in ("recency", "frequency", "monetary", "rfm_score")}
    return j.select("user_id", *[v.alias(k) for k, v in num.items()],
                    F.coalesce("segment", F.lit(S.SEG_GENERAL)).alias("my_segment"),
                    X.lookup("segment", S.SEGMENT_ADVICE, "").alias("advice"))


HEADLINE_METRICS = {
    "clustering_k": ("Clustering", "K"), "churn_auc": ("Churn", "test_auc"),
    "forecast_smape": ("SalesForecast", "best_smape"), "association_rules_count": ("Association", "global_rules_count"),
}


def dashboard(users, products, orders, churn, metrics, rfm=None) -> DataFrame:
    """One KPI row; each table is aggregated once. With ``rfm`` it also lists the segments and their customers, by name."""
    o = orders.agg(
        F.count("*").alias("total_orders"),
        F.coalesce(F.sum(F.when(F.col("status").isin(*S.REVENUE_STATUSES), F.col("total_cents"))), F.lit(0)).alias("total_revenue"),
        F.count(F.when(F.col("status") != "cancelled", 1)).alias("paid_orders"))
    picked = metrics.agg(F.struct(*[
        F.coalesce(F.max(F.when((F.col("model_name") == m) & (F.col("metric_name") == n), F.col("metric_value"))), F.lit(0.0)).alias(k)
        for k, (m, n) in HEADLINE_METRICS.items()]))
    counted = o.withColumns({
        "total_users": users.agg(F.count("*")).scalar(),
        "total_products": products.where("is_active").agg(F.count("*")).scalar(),
        "churn_risk_count": churn.where("is_churn_risk").agg(F.count("*")).scalar(), "_m": picked.scalar()})
    if rfm is not None:
        n = rfm.groupBy("segment").agg(F.count("*").alias("count"))  # a row a segment
        counted = counted.withColumn("rfm_segments", n.agg(F.sort_array(F.collect_list(F.struct("segment", "count")))).scalar())
    whole = ("clustering_k", "association_rules_count")
    return counted.withColumns({
        k: F.floor(f"_m.{k}").cast("long") if k in whole else F.col(f"_m.{k}") for k in HEADLINE_METRICS}).drop("_m")


def gauges(dash: DataFrame) -> DataFrame:
    """Paid-order rate, churn rate (both at most 100) and revenue per user."""
    def rate(a, b):
        return F.least(F.coalesce(F.round(F.try_divide(F.col(a) * 100.0, F.col(b)), 1), F.lit(0.0)), F.lit(100.0))
    return dash.select(
        rate("paid_orders", "total_orders").alias("paid_rate"), rate("churn_risk_count", "total_users").alias("churn_rate"),
        F.coalesce(F.round(F.try_divide(F.col("total_revenue") / 100.0, F.col("total_users")), 2), F.lit(0.0)).alias("revenue_per_user"))


def sales_trend(orders: DataFrame) -> DataFrame:
    return revenue_orders(orders).groupBy(F.to_date("created_at").alias("date")).agg(
        F.sum("total_cents").alias("amount"), F.count("*").alias("count"))


def monthly_sales(orders: DataFrame, by=()) -> DataFrame:
    """Monthly amount and count, per extra key when given (per user: the personal trend)."""
    return revenue_orders(orders).groupBy(*by, X.month_key(F.col("created_at")).alias("month")).agg(
        F.sum("total_cents").alias("amount"), F.count("*").alias("count"))


def predictions_by_month(preds: DataFrame) -> DataFrame:
    """Weekly predictions summed to months, missing bounds as 0."""
    cols = ["pred_amount", "pred_upper", "pred_lower"]
    return preds.groupBy(X.month_key(F.col("pred_date")).alias("month")).agg(
        *[F.sum(F.coalesce(F.col(c), F.lit(0.0))).alias(c) for c in cols])


def sales_heatmap(orders: DataFrame, months=6) -> DataFrame:
    """Month by weekday grid of the last months, every cell present."""
    rev = revenue_orders(orders)
    month = X.month_key(F.col("created_at"))
    last = rev.select(month.alias("month")).distinct().orderBy(F.desc("month")).limit(months)
    cells = last.select("month", F.explode(F.sequence(F.lit(0), F.lit(6))).alias("dow"))
    sums = rev.groupBy(month.alias("month"), (F.dayofweek("created_at") - 1).alias("dow")).agg(
        F.sum("total_cents").alias("_c"))
    rank = F.dense_rank().over(Window.partitionBy(F.lit(0)).orderBy("month")) - 1
    return F.broadcast(cells).join(sums, ["month", "dow"], "left").select(
        "month", rank.alias("month_index"), "dow", X.lookup("dow", dict(enumerate(S.WEEKDAY_NAMES))).alias("day_name"),
        F.round(F.coalesce(F.col("_c"), F.lit(0)) / 100, 0).alias("amount"))


def category_preference(orders, items, products) -> DataFrame:
    """Spend and lines per user and category over all statuses, with the share of the user's total."""
    j = (orders.select("order_id", "user_id").join(items, "order_id")
         .join(products.select("product_id", F.coalesce("category_name", F.lit(S.CATEGORY_OTHER)).alias("category")), "product_id"))
    g = j.groupBy("user_id", "category").agg(F.sum("line_cents").alias("amount"), F.count("*").alias("count"))
    total = F.sum("amount").over(Window.partitionBy("user_id"))
    return g.withColumn("percent", X.percent_of(F.col("amount"), total))


def rfm_summary(rfm: DataFrame, places=1) -> DataFrame:
    return rfm.groupBy("segment").agg(
        F.count("*").alias("count"), *[F.round(F.avg(c), places).alias(f"avg_{c}") for c in ("recency", "frequency", "monetary")])


def segment_distribution(rfm: DataFrame) -> DataFrame:
    """Segment sizes with percent, next to the population's mean scores."""
    pop = rfm.agg(F.struct(F.count("*").alias("n"), *[F.round(F.avg(c), 2).alias(c) for c in ("r_score", "f_score", "m_score")]))
    g = rfm.groupBy("segment").agg(F.count("*").alias("value")).withColumn("_p", pop.scalar())
    return g.select("segment", "value", X.percent_of(F.col("value"), F.col("_p.n")).alias("percent"),
                    *[F.col(f"_p.{c}").alias(f"avg_{c}") for c in ("r_score", "f_score", "m_score")])


def churn_summary(churn: DataFrame, threshold=0.5) -> DataFrame:
    lvl = X.risk_level(F.col("churn_prob"), threshold)
    return churn.agg(*[F.count(F.when(lvl == v, 1)).alias(v) for v in ("high", "medium", "low")],
                     F.count(F.when(F.col("status") == "resolved", 1)).alias("resolved"),
                     F.count(F.when(F.col("is_churn_risk"), 1)).alias("total_risk"))


BUCKETS = ["0-20%", "20-40%", "40-60%", "60-80%", "80-100%"]


def churn_histogram(churn: DataFrame) -> DataFrame:
    """Five fixed probability buckets, kept when empty; 1.0 falls in the last."""
    p = F.col("churn_prob")
    idx = F.when((p >= 0) & (p < 0.2), 0).when((p >= 0.2) & (p < 0.4), 1).when((p >= 0.4) & (p < 0.6), 2).when(
        (p >= 0.6) & (p < 0.8), 3).when(p >= 0.8, 4)
    one = churn.agg(F.count("*").alias("_n"), *[F.count(F.when(idx == i, 1)).alias(f"_{i}") for i in range(5)])
    cells = F.array(*[F.struct(F.lit(b).alias("bucket"), F.col(f"_{i}").alias("count")) for i, b in enumerate(BUCKETS)])
    return one.select("_n", F.inline(cells)).select("bucket", "count", X.percent_of(F.col("count"), F.col("_n")).alias("rate"))


def category_counts(products: DataFrame) -> DataFrame:
    return products.where("is_active AND category_name IS NOT NULL AND trim(category_name) <> ''").groupBy(
        "category_name").agg(F.count("*").alias("count"))


def category_share(products: DataFrame, k=8) -> DataFrame:
    """The k largest categories of a product list."""
    return products.groupBy("category_name").agg(F.count("*").alias("count")).orderBy(F.desc("count"), "category_name").limit(k)


def ratings(products, reviews, only=None) -> DataFrame:
    """Average and count of ratings per product, zeros when there is none."""
    p = products.select("product_id") if only is None else only
    g = reviews.groupBy("product_id").agg(F.avg("rating").alias("_a"), F.count("*").alias("_n"))
    return p.join(g, "product_id", "left").select(
        "product_id", F.coalesce(F.round("_a", 1), F.lit(0.0)).alias("average"), F.coalesce("_n", F.lit(0)).alias("count"))


def cart_totals(carts, products) -> DataFrame:
    return carts.join(products.select("product_id", "price"), "product_id").groupBy("user_id").agg(
        F.count("*").alias("lines"), F.sum("quantity").alias("units"), F.sum(F.col("price") * F.col("quantity")).alias("total_cents"))


def metrics_by_model(metrics: DataFrame, model=None) -> DataFrame:
    """One row per model with its metrics as a name -> (value, detail) map."""
    m = metrics if model is None else metrics.where(F.col("model_name") == model)
    entry = F.struct(F.col("metric_name"), F.struct(F.col("metric_value").alias("value"), "detail"))
    return m.groupBy("model_name").agg(F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("metrics"),
                                       F.count("*").alias("n"))


def last_compute_time(metrics: DataFrame) -> DataFrame:
    return metrics.agg(F.max("created_at").alias("last_compute"))


def churn_importance(metrics, churn) -> DataFrame:
    """Stored feature importances, largest first, with the risk totals."""
    prefix = "feature_importance_"
    tot = churn.agg(F.struct(F.count(F.when(F.col("is_churn_risk"), 1)).alias("risk"), F.count("*").alias("n")))
    return metrics.where((F.col("model_name") == "Churn") & F.col("metric_name").startswith(prefix)).withColumn(
        "_t", tot.scalar()).select(
        F.replace("metric_name", F.lit(prefix), F.lit("")).alias("feature"), F.floor("metric_value").cast("long").alias("count"),
        F.col("_t.risk").alias("total_risk"), F.col("_t.n").alias("total_all"))


def churn_list(churn, users, rfm, page=1, per_page=20, risk_only=False, threshold=0.5) -> DataFrame:
    """A page of predictions, highest first, enriched with user and segment.

    The page is cut before the joins, so they touch at most ``per_page`` rows.
    """
    from .catalogue import page_of
    c = churn.where("is_churn_risk") if risk_only else churn
    rows = F.broadcast(page_of(c, [F.desc("churn_prob"), F.asc("user_id")], page, per_page))
    return (rows.join(users.select("user_id", "email", "name"), "user_id", "left")
            .join(rfm.select("user_id", "segment"), "user_id", "left")
            .select("user_id", F.col("churn_prob").alias("churn_probability"), F.coalesce("email", F.lit("")).alias("email"),
                    F.coalesce("name", F.lit("")).alias("user_name"), F.coalesce("segment", F.lit("")).alias("segment"),
                    X.risk_level(F.col("churn_prob"), threshold).alias("risk_level"), "status",
                    F.date_format("created_at", "yyyy-MM-dd").alias("prediction_date")))
