"""Customer profile features and churn features."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as X
from ..functions.quantiles import attach_quantiles, bin_by_edges, exact_quantiles, quantile_scalar

PROFILE_COLUMNS = [
    "total_items", "total_spent", "total_orders", "unique_products", "avg_item_price", "price_std", "price_min",
    "price_max", "price_p25", "price_p75", "price_range", "price_cv", "purchase_span_days", "avg_purchase_interval",
    "recency_days", "avg_items_per_order", "avg_spend_per_order", "weekend_ratio", "avg_purchase_hour", "hour_std",
    "is_night", "is_weekday",
]


def _share(cond):
    return F.avg(F.when(cond, 1.0).otherwise(0.0))


def _distinct_counts(lines: DataFrame, key, **cols) -> list[DataFrame]:
    """One frame per distinct count, each reduced to (key, value) pairs before it is counted.

    The pair aggregate spreads a hot key over its values, and keeps the wide
    aggregate free of the row expansion that several distinct counts would add.
    """
    return [lines.select(key, c).distinct().groupBy(key).agg(F.count(c).alias(out)) for out, c in cols.items()]


def _attach(base: DataFrame, key, *others, how="left") -> DataFrame:
    for o in others:
        base = base.join(o, key, how)
    return base


def profile_features(lines: DataFrame, columns=None) -> DataFrame:
    """The 22 profile columns per customer and the churn label, or just some ``columns`` of them; the price quartiles, which take
    jobs of their own, are built only when asked for."""
    columns = list(columns or [*PROFILE_COLUMNS, "churn_label"])
    day, hour = F.to_date("invoice_date"), F.hour("invoice_date")
    today = lines.agg(F.max(day)).scalar()
    agg = lines.groupBy("customer_id").agg(
        F.sum("quantity").alias("total_items"), (F.sum("line_cents") / 100).alias("total_spent"),
        F.avg("unit_price").alias("avg_item_price"), F.stddev_samp("unit_price").alias("price_std"),
        F.min("unit_price").alias("price_min"), F.max("unit_price").alias("price_max"),
        F.min(day).alias("first_purchase"), F.max(day).alias("last_purchase"),
        F.avg(hour).alias("avg_purchase_hour"), F.stddev_samp(hour).alias("hour_std"),
        _share(F.weekday("invoice_date") >= 5).alias("weekend_ratio"), _share(hour < 6).alias("is_night"))
    quartiles = {"price_p25": 0, "price_p75": 1}
    q = []
    if quartiles.keys() & set(columns):
        q.append(exact_quantiles(lines, "unit_price", [0.25, 0.75], keys=["customer_id"]).select(
            "customer_id", *[F.get("q", F.lit(i)).alias(c) for c, i in quartiles.items()]))
    counts = _distinct_counts(lines.withColumn("_d", day), "customer_id", total_orders="invoice_no",
                              unique_products="stock_code", _days="_d")
    span = F.datediff("last_purchase", "first_purchase")
    df = _attach(agg, "customer_id", *q, *counts).withColumns({
        "purchase_span_days": span, "recency_days": F.datediff(today, "last_purchase"),
        "avg_items_per_order": F.col("total_items") / F.col("total_orders"),
        "avg_spend_per_order": F.col("total_spent") / F.col("total_orders"),
        "price_range": F.col("price_max") - F.col("price_min"),
        "price_cv": F.try_divide("price_std", "avg_item_price"), "is_weekday": 1 - F.col("weekend_ratio"),
        # the mean gap between consecutive distinct days is the span over the gaps
        "avg_purchase_interval": F.coalesce(F.try_divide(span, F.col("_days") - 1), F.lit(0.0)),
        "avg_purchase_hour": F.coalesce("avg_purchase_hour", F.lit(12.0))})
    df = df.withColumn("churn_label", (F.col("recency_days") > 90).cast("int"))
    return df.select("customer_id", *[F.coalesce(F.col(c), F.lit(0)).alias(c) for c in columns])


def churn_prob_group(features: DataFrame) -> DataFrame:
    """0.1 to 0.9 by recency quintile."""
    edges = quantile_scalar(features, "recency_days", [0.2, 0.4, 0.6, 0.8])
    above = F.size(F.filter("_e", lambda e: e < F.col("recency_days")))
    return features.withColumn("_e", edges).withColumn(
        "churn_prob_group", F.get(F.array(*[F.lit(p) for p in (0.1, 0.3, 0.5, 0.7, 0.9)]), above)).drop("_e")


def standard_scale(df: DataFrame, cols, prefix="z_") -> DataFrame:
    """Population z-scores; a constant column becomes 0."""
    stats = df.agg(F.struct(*[F.avg(c).alias(f"m_{c}") for c in cols], *[F.stddev_pop(c).alias(f"s_{c}") for c in cols]))
    out = df.withColumn("_s", stats.scalar())
    return out.withColumns({
        prefix + c: F.coalesce(F.try_divide(F.col(c) - F.col(f"_s.m_{c}"), F.col(f"_s.s_{c}")), F.lit(0.0)) for c in cols
    }).drop("_s")


def minmax_scale(df: DataFrame, cols, prefix="u_", log=False) -> DataFrame:
    """Scale to 0..1, on log1p values when ``log``; a constant column becomes 0."""
    def val(c):
        return F.log1p(F.col(c)) if log else F.col(c)
    stats = df.agg(F.struct(*[F.min(val(c)).alias(f"a_{c}") for c in cols], *[F.max(val(c)).alias(f"b_{c}") for c in cols]))
    out = df.withColumn("_s", stats.scalar())
    return out.withColumns({
        prefix + c: F.coalesce(F.try_divide(val(c) - F.col(f"_s.a_{c}"), F.col(f"_s.b_{c}") - F.col(f"_s.a_{c}")), F.lit(0.0))
        for c in cols}).drop("_s")


# ------------------------------------------------------------------ purchase times


def _names(key):
    """Key columns: one name or a list of them."""
    return [key] if isinstance(key, str) else list(key)


def _monthly_times(lines: DataFrame, key):
    """Distinct purchase times with their month; months are the slices a hot customer is cut into."""
    return lines.select(*key, F.col("invoice_date").alias("ts")).distinct().withColumn("m", F.trunc("ts", "month"))


def purchase_gaps(lines: DataFrame, key="customer_id") -> DataFrame:
    """Count, mean, population deviation and variation of the gaps between distinct times, and the last-gap ratio.

    Gaps inside a month come from a window per (customer, month); gaps between
    months from one row per month. Moments then add up per customer.
    """
    key = _names(key)
    times = _monthly_times(lines, key)
    inside = Window.partitionBy(*key, "m").orderBy("ts")
    t = times.withColumn("g", X.whole_days(F.col("ts"), F.lag("ts").over(inside)))
    by_month = t.groupBy(*key, "m").agg(
        F.count("*").alias("n"), F.min("ts").alias("lo"), F.max("ts").alias("hi"), F.sum("g").alias("s1"),
        F.sum(F.col("g").cast("long") * F.col("g")).alias("s2"), F.max_by("g", "ts").alias("last_inside"))
    months = Window.partitionBy(*key).orderBy("m")
    x = X.whole_days(F.col("lo"), F.lag("hi").over(months))
    c = by_month.withColumn("x", x).withColumn("s1", F.coalesce("s1", F.lit(0)) + F.coalesce("x", F.lit(0))).withColumn(
        "s2", F.coalesce("s2", F.lit(0)) + F.coalesce(F.col("x").cast("long") * F.col("x"), F.lit(0))).withColumn(
        "last_gap", F.when(F.col("n") > 1, F.col("last_inside")).otherwise(F.col("x")))
    g = c.groupBy(*key).agg(F.sum("n").alias("n"), F.sum("s1").alias("s1"), F.sum("s2").alias("s2"),
                           F.max_by("last_gap", "m").alias("last_gap"))
    gaps = F.col("n") - 1
    mean = F.col("s1") / gaps
    std = F.sqrt(F.greatest(F.col("s2") / gaps - mean * mean, F.lit(0.0)))
    prior = F.try_divide(F.col("s1") - F.col("last_gap"), gaps - 1)

    def enough(c):
        return F.when(F.col("n") > 2, c).otherwise(0.0)
    return g.select(
        *key, F.col("n").alias("n_times"), enough(mean).alias("interval_mean"), enough(std).alias("interval_std"),
        enough(std / F.greatest(mean, F.lit(1.0))).alias("interval_cv"),
        enough(F.least(F.col("last_gap") / F.greatest(prior, F.lit(1.0)), F.lit(10.0))).alias("last_interval_ratio"))


def _midpoints(lines: DataFrame, key):
    """The (n/2)-th distinct time of customers with three or more, found in the month that holds it."""
    times = _monthly_times(lines, key)
    per_month = times.groupBy(*key, "m").agg(F.count("*").alias("n"))
    w = Window.partitionBy(*key)
    pos = per_month.withColumn("end", F.sum("n").over(w.orderBy("m").rowsBetween(Window.unboundedPreceding, 0))).withColumn(
        "total", F.sum("n").over(w)).withColumn("start", F.col("end") - F.col("n")).withColumn(
        "mid", F.floor(F.col("total") / 2)).where("total >= 3 AND mid >= start AND mid < end")
    rank = F.row_number().over(Window.partitionBy(*key, "m").orderBy("ts"))
    return times.join(pos.select(*key, "m", "mid", "start"), [*key, "m"]).withColumn("r", rank).where(
        "r - 1 = mid - start").select(*key, F.col("ts").alias("mid_ts"))


def half_trends(lines: DataFrame, key="customer_id") -> DataFrame:
    """Orders and spend of the second half over the first, split at the middle purchase time, at most 5."""
    key = _names(key)
    per_visit = lines.groupBy(*key, "invoice_no", "invoice_date").agg(F.sum("line_cents").alias("c"))
    j = per_visit.join(_midpoints(lines, key), key).withColumn("late", F.col("invoice_date") >= F.col("mid_ts"))
    spend = j.groupBy(*key, "late").agg(F.sum("c").alias("c"))
    orders = j.select(*key, "late", "invoice_no").distinct().groupBy(*key, "late").agg(F.count("*").alias("o"))
    s = orders.join(spend, [*key, "late"]).groupBy(*key).agg(
        *[F.sum(F.when(F.col("late") == late, F.col(v))).alias(f"{v}{int(late)}") for v in ("o", "c") for late in (False, True)])
    return s.select(
        *key, F.least(F.col("o1") / F.greatest("o0", F.lit(1)), F.lit(5.0)).alias("relative_freq_trend"),
        F.least((F.col("c1") / 100) / F.greatest(F.col("c0") / 100, F.lit(0.01)), F.lit(5.0)).alias("relative_spend_trend"))


def peak_month(lines: DataFrame, key="customer_id") -> DataFrame:
    """Month of the year with the highest spend (earliest on ties) and its share of the total."""
    key = _names(key)
    m = lines.groupBy(*key, F.month("invoice_date").alias("mon")).agg(F.sum("line_cents").alias("c"))
    return m.groupBy(*key).agg(
        F.max_by("mon", F.struct(F.col("c"), -F.col("mon"))).alias("spend_peak_month"),
        (F.max("c") / 100 / F.greatest(F.sum("c") / 100, F.lit(1.0))).alias("spend_peak_ratio"))


# ------------------------------------------------------------------ churn features

# Feature names and what each model leaves out.
CHURN_EXCLUDE = ["churn_risk_score", "is_churn", "is_at_risk", "loyalty_index", "purchase_span_days", "purchase_trend_30d",
                 "spend_trend_30d", "purchase_trend_60d", "spend_trend_60d", "recent_density_ratio"]
CLV_EXCLUDE = CHURN_EXCLUDE + ["avg_spend_per_order", "spend_per_day", "spend_depth", "total_items", "items_per_day",
                               "avg_items_per_order", "diversity_x_freq", "price_range", "total_spent", "recency_score",
                               "days_overdue", "overdue_score", "low_engagement_score"]
ALL_FEATURES = [
    "total_items", "total_spent", "total_orders", "unique_products", "avg_item_price", "price_std", "price_p25", "price_cv",
    "purchase_span_days", "avg_purchase_interval", "recency_days", "tenure_days", "avg_spend_per_order",
    "avg_items_per_order", "spend_per_day", "items_per_day", "order_frequency", "weekend_ratio", "avg_purchase_hour",
    "hour_std", "is_night", "is_weekday", "active_months", "purchase_trend_30d", "spend_trend_30d", "purchase_trend_60d",
    "spend_trend_60d", "interval_mean", "interval_std", "interval_cv", "purchase_density", "recent_density_ratio",
    "relative_freq_trend", "relative_spend_trend", "last_interval_ratio", "recency_vs_interval", "recency_vs_lifespan",
    "recency_ratio", "purchase_consistency", "diversity_x_freq", "spend_depth", "activity_rate", "engagement_consistency",
    "is_bulk_buyer", "product_diversity", "spending_cv", "price_range", "spend_peak_month", "spend_peak_ratio",
    "recency_score", "days_overdue", "overdue_score", "low_engagement_score", "churn_risk_score", "loyalty_index",
    "is_at_risk", "is_churn",
]


def churn_feature_columns(exclude=CHURN_EXCLUDE, extra=()):
    return [c for c in [*ALL_FEATURES, *extra] if c not in exclude]


def churn_base(lines: DataFrame, cut_date, columns=None) -> DataFrame:
    """Volume, price, timing and window features up to the cut, one row per customer. The lower price quartile, which takes jobs
    of its own, is left out if ``columns`` are given and neither it nor what is made from it is among them."""
    ref = F.date_add(F.lit(cut_date).cast("date"), 1).cast("timestamp")
    lines = lines.where(F.col("invoice_date") <= F.lit(cut_date).cast("timestamp"))
    hour, mon = F.hour("invoice_date"), F.month("invoice_date")
    last_seen = lines.agg(F.max("invoice_date")).scalar()
    starts = {f"{side}_{w}d": last_seen - F.make_dt_interval(F.lit(w * k))
              for w in (30, 60) for side, k in (("early", 2), ("late", 1))}
    lines = lines.withColumns({f"_{n}": F.col("invoice_date") >= s for n, s in starts.items()})
    agg = lines.groupBy("customer_id").agg(
        F.sum("quantity").alias("total_items"), (F.sum("line_cents") / 100).alias("total_spent"),
        F.avg("unit_price").alias("avg_item_price"), F.coalesce(F.stddev_samp("unit_price"), F.lit(0.0)).alias("price_std"),
        F.min("invoice_date").alias("first_purchase"), F.max("invoice_date").alias("last_purchase"),
        _share(F.weekday("invoice_date") >= 5).alias("weekend_ratio"), F.avg(hour).alias("avg_purchase_hour"),
        F.coalesce(F.stddev_samp(hour), F.lit(0.0)).alias("hour_std"), _share((hour >= 22) | (hour <= 5)).alias("is_night"),
        _share(hour.between(9, 17)).alias("is_weekday"), F.size(F.collect_set(mon)).alias("active_months"),
        *[F.coalesce(F.sum(F.when(F.col(f"_{n}"), F.col("line_cents"))), F.lit(0)).alias(f"_spend_{n}") for n in starts])
    q = []
    if columns is None or {"price_p25", "price_range"} & set(columns):
        q.append(exact_quantiles(lines, "unit_price", [0.25], keys=["customer_id"]).select("customer_id", F.get("q", F.lit(0)).alias("price_p25")))
    # one row per order answers the order counts of every window
    visits = lines.groupBy("customer_id", "invoice_no").agg(*[F.max(f"_{n}").alias(f"_{n}") for n in starts])
    orders = visits.groupBy("customer_id").agg(
        F.count("*").alias("total_orders"), *[F.count(F.when(F.col(f"_{n}"), 1)).alias(f"orders_{n}") for n in starts])
    products = lines.select("customer_id", "stock_code").distinct().groupBy("customer_id").agg(
        F.count("*").alias("unique_products"))
    return base_ratios(_attach(agg, "customer_id", orders, products, *q), ref, starts)


def base_ratios(df: DataFrame, ref, windows) -> DataFrame:
    """Spans, rates and trends from the sums and counts of a customer; ``ref`` is the day after the cut."""
    days = {"purchase_span_days": X.whole_days(F.col("last_purchase"), F.col("first_purchase")),
            "recency_days": X.whole_days(ref, F.col("last_purchase")), "tenure_days": X.whole_days(ref, F.col("first_purchase"))}
    df = df.withColumns(days).withColumns({f"spend_{n}": F.col(f"_spend_{n}") / 100 for n in windows})
    span = F.greatest("purchase_span_days", F.lit(1))
    return df.withColumns({
        "price_cv": F.col("price_std") / F.greatest("avg_item_price", F.lit(0.01)),
        "avg_purchase_interval": F.when(F.col("total_orders") > 1, F.col("purchase_span_days") / F.greatest(F.col("total_orders") - 1, F.lit(1)))
        .otherwise(F.col("purchase_span_days").cast("double")),
        "avg_spend_per_order": F.col("total_spent") / F.col("total_orders"),
        "avg_items_per_order": F.col("total_items") / F.col("total_orders"),
        "spend_per_day": F.col("total_spent") / span, "items_per_day": F.col("total_items") / span,
        "order_frequency": F.col("total_orders") / span * 30,
        **{f"purchase_trend_{w}d": F.col(f"orders_late_{w}d") / F.greatest(F.col(f"orders_early_{w}d"), F.lit(0.5)) for w in (30, 60)},
        **{f"spend_trend_{w}d": F.col(f"spend_late_{w}d") / F.greatest(F.col(f"spend_early_{w}d"), F.lit(0.5)) for w in (30, 60)},
    }).drop(*[f"_spend_{n}" for n in windows])


def derive_churn(df: DataFrame, cut_date, keys=(), columns=None) -> DataFrame:
    """Ratios, engagement and risk components from the base and time features; ``keys`` name what holds several cuts apart. The
    bulk-buyer mark, which takes a quantile of all customers, is left out if ``columns`` are given without it."""
    ref = F.date_add(F.lit(cut_date).cast("date"), 1)
    c = F.col
    span = F.greatest("purchase_span_days", F.lit(1))
    life = F.greatest(c("purchase_span_days") + c("recency_days"), F.lit(1))
    months = F.greatest(c("purchase_span_days") / 30, F.lit(1.0))
    df = df.withColumns({
        "purchase_density": c("total_orders") / span,
        "recency_vs_interval": c("recency_days") / F.greatest("avg_purchase_interval", F.lit(1.0)),
        "recency_vs_lifespan": c("recency_days") / life, "recency_ratio": c("recency_days") / life,
        "purchase_consistency": 1 / (1 + c("avg_purchase_interval")),
        "diversity_x_freq": c("unique_products") * c("order_frequency"),
        "spend_depth": c("avg_spend_per_order") / F.greatest("avg_item_price", F.lit(0.01)),
        "activity_rate": c("active_months") / months, "engagement_consistency": c("active_months") / months,
        "product_diversity": c("unique_products") / c("total_orders"),
        "spending_cv": c("price_std") / F.greatest("avg_item_price", F.lit(0.01)), **({"price_range": c("price_p25") * 2} if "price_p25" in df.columns else {}),
        "recency_score": F.least(F.lit(100.0), c("recency_days") / 365 * 100),
    })
    if columns is None or "is_bulk_buyer" in columns:
        p90 = exact_quantiles(df, "avg_items_per_order", [0.9], keys=keys, edges_per_key=bool(keys)).select(*keys, F.get("q", F.lit(0)).alias("_p90"))
        df = df.join(F.broadcast(p90), list(keys)) if keys else df.withColumn("_p90", p90.scalar())  # a row a cut
        df = df.withColumn("is_bulk_buyer", (c("avg_items_per_order") > c("_p90")).cast("int")).drop("_p90")
    idle = (F.unix_micros(ref.cast("timestamp")) - F.unix_micros("last_purchase")) / F.lit(86_400_000_000)
    overdue = F.greatest(F.floor(idle - c("avg_purchase_interval")), F.lit(0)).cast("int")
    df = df.withColumns({
        "recent_density_ratio": c("purchase_trend_30d") * c("purchase_density"),
        "days_overdue": overdue,
        "expected_next_purchase": F.date_add(F.to_date("last_purchase"), F.floor("avg_purchase_interval").cast("int")),
        "low_engagement_score": (1 - c("engagement_consistency")) * 50,
    })
    df = df.withColumn("overdue_score", F.least(F.lit(100.0), c("days_overdue") / 180 * 100))
    df = df.withColumn("churn_risk_score", c("recency_score") * 0.5 + c("overdue_score") * 0.3 + c("low_engagement_score") * 0.2)
    return df.withColumns({"loyalty_index": 100 - c("churn_risk_score"), "is_at_risk": (c("churn_risk_score") > 60).cast("int")})


#: Churn features that come from the purchase times alone, by the function that makes them, and from the label window.
TIME_FEATURES = {purchase_gaps: {"n_times", "interval_mean", "interval_std", "interval_cv", "last_interval_ratio"},
                 half_trends: {"relative_freq_trend", "relative_spend_trend"}, peak_month: {"spend_peak_month", "spend_peak_ratio"}}
LABELS = {"first_label_purchase", "is_churn"}


def churn_features(lines: DataFrame, cut_date, label_end=None, columns=None) -> DataFrame:
    """All churn features at one cut date with the label from the days after it, or what some ``columns`` need and no more."""
    train = lines.where(F.col("invoice_date") <= F.lit(cut_date).cast("timestamp"))
    want = None if columns is None else set(columns)
    times = [f for f, names in TIME_FEATURES.items() if want is None or names & want]
    simple = set.union(*TIME_FEATURES.values(), LABELS, {"customer_id", "last_purchase"})
    whole = want is None or bool(want - simple)
    base = churn_base(lines, cut_date, columns) if whole else train.groupBy("customer_id").agg(F.max("invoice_date").alias("last_purchase"))
    df = _attach(base, "customer_id", *[f(train) for f in times])
    df = df.withColumns({k: F.coalesce(F.col(k), F.lit(0.0)) for k in sorted(TIME_FEATURES[half_trends]) if half_trends in times})
    if whole:
        df = derive_churn(df, cut_date, columns=columns)
    if want is None or want & (LABELS | {"prediction_tier"}):
        later = lines.where(F.col("invoice_date") >= F.date_add(F.lit(cut_date).cast("date"), 1))
        if label_end:
            later = later.where(F.col("invoice_date") <= F.lit(label_end).cast("timestamp"))
        seen = later.groupBy("customer_id").agg(F.to_date(F.min("invoice_date")).alias("first_label_purchase"))
        df = labelled(df.join(seen, "customer_id", "left"))
    return df


def labelled(df: DataFrame) -> DataFrame:
    """The churn label from the first purchase after the cut, and the prediction tier where the orders are counted."""
    df = df.withColumn("is_churn", F.col("first_label_purchase").isNull().cast("int"))
    if "total_orders" not in df.columns:
        return df
    return df.withColumn("prediction_tier", F.when(F.col("total_orders") <= 1, "Cold-Start").otherwise("Established"))


def next_purchase(df: DataFrame, cut_date) -> DataFrame:
    """Next-purchase class and capped days from the label start, with the recency extras."""
    start = F.date_add(F.lit(cut_date).cast("date"), 1)
    d = F.datediff("first_label_purchase", start)
    last = F.to_date("last_purchase")
    return df.withColumns({
        "purchase_window": F.when(d <= 30, 0).when(d <= 90, 1).otherwise(2),
        "days_to_next": F.least(F.coalesce(d, F.lit(180)), F.lit(180)),
        "days_to_label_start": F.datediff(start, last), "last_purchase_month": F.month("last_purchase"),
        "recency_from_train_end": F.datediff(F.lit(cut_date).cast("date"), last)})


def leakage_scan(df: DataFrame, cols, label="is_churn") -> DataFrame:
    """Absolute correlation of every feature with the label, in one aggregate."""
    row = df.agg(*[F.abs(F.corr(F.col(c).cast("double"), F.col(label).cast("double"))).alias(c) for c in cols])
    long = row.unpivot([], cols, "feature", "abs_r")
    return long.withColumn("verdict", F.when(F.col("abs_r") > 0.9, "drop").when(F.col("abs_r") > 0.7, "warn").otherwise("keep"))


#: What the clustering columns are made from.
CLUSTER_INPUTS = ["recency_days", "total_orders", "total_spent", "avg_items_per_order", "purchase_span_days", "unique_products", "weekend_ratio", "avg_spend_per_order"]


def cluster_features(profile: DataFrame) -> DataFrame:
    """The 11 clustering columns with the RFM values they describe."""
    cols = ["recency_days", "total_orders", "total_spent"]
    velocity = F.col("total_orders") / F.greatest("purchase_span_days", F.lit(1))
    binned = attach_quantiles(profile, [*cols, "avg_items_per_order"], [0.5, *[i / 5 for i in range(6)]])
    binned = binned.withColumns({"_med": F.get(F.col("_q.avg_items_per_order"), F.lit(0)),
                                 "_q": F.struct(*[F.slice(F.col(f"_q.{c}"), 2, 6).alias(c) for c in cols])})
    r, f, m = [bin_by_edges(F.col(c), F.col(f"_q.{c}")) for c in cols]
    return binned.select(
        "customer_id", (6 - r).alias("r_quintile"), (f + 1).alias("f_quintile"), (m + 1).alias("m_quintile"),
        F.col("unique_products").alias("product_diversity"), (F.col("avg_items_per_order") > F.col("_med")).cast("int").alias("is_bulk_buyer"),
        velocity.alias("purchase_velocity"), velocity.alias("activity_rate"), "weekend_ratio", "avg_spend_per_order",
        "total_orders", "recency_days", "total_spent")
