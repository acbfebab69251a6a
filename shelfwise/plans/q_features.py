"""Profile features, churn features, window features and cluster features."""

from pyspark.sql import functions as F

from ..functions.quantiles import qcut
from ..operators import asof as AT
from ..operators import features as FT
from ..operators import segments as SG
from ..session import materialize
from ..sources.canonical import CUT_DATE
from .q_basics import CLUSTER_SQL, cluster_labels
from .registry import query

LINE_COLS = ("customer_id", "invoice_no", "stock_code", "quantity", "unit_price", "line_cents", "invoice_date")


def lines(t):
    """Cleaned lines joined once and written, since the feature builders read them several times."""
    return materialize(t.sales(*LINE_COLS))


def rounded(df, spec):
    """Select columns with the decimals to compare them at; None keeps the value."""
    return df.select(*[F.round(c, d).alias(c) if d is not None else F.col(c) for c, d in spec.items()])


def rsql(spec):
    return ", ".join(f"round({c}, {d}) AS {c}" if d is not None else c for c, d in spec.items())


PROF = """p0 AS (SELECT customer_id, sum(quantity) AS total_items, CAST(sum(line_cents) AS BIGINT) / 100.0::DOUBLE AS total_spent,
    count(DISTINCT invoice_no) AS total_orders, count(DISTINCT stock_code) AS unique_products, avg(unit_price) AS avg_item_price,
    coalesce(stddev_samp(unit_price), 0) AS price_std, min(unit_price) AS price_min, max(unit_price) AS price_max,
    quantile_cont(unit_price, 0.25) AS price_p25, quantile_cont(unit_price, 0.75) AS price_p75,
    CAST(min(invoice_date) AS DATE) AS fp, CAST(max(invoice_date) AS DATE) AS lp, avg(hour(invoice_date)) AS avg_purchase_hour,
    coalesce(stddev_samp(hour(invoice_date)), 0) AS hour_std, avg(CASE WHEN isodow(invoice_date) >= 6 THEN 1.0::DOUBLE ELSE 0 END) AS weekend_ratio,
    avg(CASE WHEN hour(invoice_date) < 6 THEN 1.0::DOUBLE ELSE 0 END) AS is_night, count(DISTINCT CAST(invoice_date AS DATE)) AS nd
    FROM sales GROUP BY 1),
    prof AS (SELECT *, CAST(lp - fp AS INTEGER) AS purchase_span_days, CAST((SELECT max(lp) FROM p0) - lp AS INTEGER) AS recency_days,
    total_items / total_orders AS avg_items_per_order, total_spent / total_orders AS avg_spend_per_order, price_max - price_min AS price_range,
    price_std / avg_item_price AS price_cv, 1 - weekend_ratio AS is_weekday,
    CASE WHEN nd > 1 THEN (lp - fp) / (nd - 1)::DOUBLE ELSE 0.0 END AS avg_purchase_interval FROM p0)"""


def profile(t, *columns):
    return FT.profile_features(lines(t), columns)


def _fp(key, spec):
    query(key, "sales", f"SELECT {rsql(spec)} FROM prof", PROF)(lambda t: rounded(profile(t, *[c for c in spec if c != "customer_id"]), spec))


_fp("fp1_volume", {"customer_id": None, "total_items": 2, "total_spent": 2, "total_orders": None, "unique_products": None})
_fp("fp2_prices", {"customer_id": None, "avg_item_price": 6, "price_std": 6, "price_min": 8, "price_max": 8, "price_p25": 10,
                   "price_p75": 10, "price_range": 8, "price_cv": 6})
_fp("fp3_timing", {"customer_id": None, "purchase_span_days": None, "recency_days": None})
_fp("fp4_hours", {"customer_id": None, "avg_purchase_hour": 6, "hour_std": 6, "weekend_ratio": 6, "is_weekday": 6, "is_night": 6})
_fp("fp5_per_order", {"customer_id": None, "avg_items_per_order": 6, "avg_spend_per_order": 6, "avg_purchase_interval": 6})

_PROB = """CASE WHEN recency_days <= q[1] THEN 0.1::DOUBLE WHEN recency_days <= q[2] THEN 0.3 WHEN recency_days <= q[3] THEN 0.5
    WHEN recency_days <= q[4] THEN 0.7 ELSE 0.9 END AS churn_prob_group"""


@query("fp6_churn_label", "sales", f"""SELECT customer_id, CAST(recency_days > 90 AS INTEGER) AS churn_label, {_PROB} FROM prof,
    (SELECT quantile_cont(recency_days, [0.2, 0.4, 0.6, 0.8]) AS q FROM prof)""", PROF)
def _(t):
    return FT.churn_prob_group(profile(t, "recency_days", "churn_label")).select("customer_id", "churn_label", "churn_prob_group")


_ZS = ", ".join(f"round(CASE WHEN stddev_pop({c}) OVER () = 0 THEN 0 ELSE ({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER () END, 5) AS z_{c}"
                for c in ("total_items", "total_spent", "price_cv", "recency_days", "avg_purchase_interval"))


@query("fp7_standard_scale", "sales", f"SELECT customer_id, {_ZS} FROM prof", PROF)
def _(t):
    z = FT.standard_scale(profile(t), FT.PROFILE_COLUMNS)
    return z.select("customer_id", *[F.round(f"z_{c}", 5).alias(f"z_{c}") for c in
                                     ("total_items", "total_spent", "price_cv", "recency_days", "avg_purchase_interval")])


# ---------------------------------------------------------------- windows over purchase times

GAPS = """tr AS (SELECT * FROM sales WHERE invoice_date <= DATE '2001-01-31'),
    tm AS (SELECT DISTINCT customer_id, invoice_date AS ts FROM tr),
    gp AS (SELECT customer_id, ts, date_diff('day', lag(ts) OVER (PARTITION BY customer_id ORDER BY ts), ts) AS g,
    row_number() OVER (PARTITION BY customer_id ORDER BY ts) - 1 AS i, count(*) OVER (PARTITION BY customer_id) AS n FROM tm),
    gap AS (SELECT customer_id, max(n) AS n_times, CASE WHEN max(n) > 2 THEN avg(g) ELSE 0 END AS interval_mean,
    CASE WHEN max(n) > 2 THEN stddev_pop(g) ELSE 0 END AS interval_std,
    CASE WHEN max(n) > 2 THEN stddev_pop(g) / greatest(avg(g), 1) ELSE 0 END AS interval_cv,
    CASE WHEN max(n) > 2 THEN least(max(g) FILTER (WHERE i = n - 1) / greatest(avg(g) FILTER (WHERE i < n - 1), 1), 10) ELSE 0 END AS last_interval_ratio
    FROM gp GROUP BY 1),
    md AS (SELECT customer_id, ts AS mid FROM gp WHERE n >= 3 AND i = n // 2),
    half AS (SELECT customer_id, least(count(DISTINCT invoice_no) FILTER (WHERE invoice_date >= mid)::DOUBLE /
    greatest(count(DISTINCT invoice_no) FILTER (WHERE invoice_date < mid), 1), 5) AS relative_freq_trend,
    least(CAST(sum(line_cents) FILTER (WHERE invoice_date >= mid) AS BIGINT) / 100.0::DOUBLE / greatest(CAST(sum(line_cents) FILTER (WHERE invoice_date < mid) AS BIGINT) / 100.0::DOUBLE, 0.01), 5)
    AS relative_spend_trend FROM tr JOIN md USING (customer_id) GROUP BY 1),
    pm AS (SELECT customer_id, month(invoice_date) AS mon, CAST(sum(line_cents) AS BIGINT) AS c FROM tr GROUP BY 1, 2),
    peak AS (SELECT customer_id, CAST(arg_max(mon, c * 100 - mon) AS INTEGER) AS spend_peak_month,
    max(c) / 100.0::DOUBLE / greatest(CAST(sum(c) AS BIGINT) / 100.0::DOUBLE, 1) AS spend_peak_ratio FROM pm GROUP BY 1)"""


def train(t, *cols):
    return (materialize(t.sales(*cols)) if cols else lines(t)).where(F.col("invoice_date") <= F.lit(CUT_DATE).cast("timestamp"))


_WN7 = {"customer_id": None, "n_times": None, "interval_mean": 6, "interval_std": 5, "interval_cv": 6}
_WN8 = {"customer_id": None, "relative_freq_trend": 6, "relative_spend_trend": 6}
_WN9 = {"customer_id": None, "last_interval_ratio": 6}
_WN13 = {"customer_id": None, "spend_peak_month": None, "spend_peak_ratio": 6}


@query("wn6_date_gaps", "sales", "SELECT customer_id, round(avg_purchase_interval, 6) AS avg_gap FROM prof", PROF)
def _(t):
    s = t.sales("customer_id", "invoice_date").select("customer_id", F.to_date("invoice_date").alias("d")).distinct()
    g = s.groupBy("customer_id").agg(F.datediff(F.max("d"), F.min("d")).alias("s"), F.count("*").alias("n"))
    return g.select("customer_id", F.round(F.coalesce(F.try_divide("s", F.col("n") - 1), F.lit(0.0)), 6).alias("avg_gap"))


@query("wn7_intervals", "sales", f"SELECT {rsql(_WN7)} FROM gap", GAPS)
def _(t):
    return rounded(FT.purchase_gaps(train(t, "customer_id", "invoice_date")), _WN7)


@query("wn8_half_trends", "sales", f"SELECT {rsql(_WN8)} FROM half", GAPS)
def _(t):
    return rounded(FT.half_trends(train(t)), _WN8)


@query("wn9_last_interval", "sales", f"SELECT {rsql(_WN9)} FROM gap", GAPS)
def _(t):
    return rounded(FT.purchase_gaps(train(t, "customer_id", "invoice_date")), _WN9)


def _bin(col, edges):
    return f"CAST(len(list_filter(({edges})[2:len({edges}) - 1], lambda e: e < {col})) AS INTEGER)"


def _edges(col, q, src):
    qs = ", ".join(str(i / q) for i in range(q + 1))
    return f"(SELECT list_sort(list_distinct(quantile_cont({col}, [{qs}]))) FROM {src})"


QUINT = f"""ed AS (SELECT {_edges('recency_days', 5, 'prof')} AS er, {_edges('total_orders', 5, 'prof')} AS ef, {_edges('total_spent', 5, 'prof')} AS em),
    km AS (SELECT customer_id, CAST(6 - {_bin('recency_days', 'er')} AS INTEGER) AS r_quintile, CAST({_bin('total_orders', 'ef')} + 1 AS INTEGER) AS f_quintile,
    CAST({_bin('total_spent', 'em')} + 1 AS INTEGER) AS m_quintile, unique_products AS product_diversity,
    CAST(avg_items_per_order > (SELECT quantile_cont(avg_items_per_order, 0.5) FROM prof) AS INTEGER) AS is_bulk_buyer,
    total_orders / greatest(purchase_span_days, 1)::DOUBLE AS purchase_velocity, total_orders / greatest(purchase_span_days, 1)::DOUBLE AS activity_rate,
    weekend_ratio, avg_spend_per_order, total_orders, recency_days, total_spent FROM prof, ed)"""


def cluster_frame(t):
    return FT.cluster_features(materialize(profile(t, *FT.CLUSTER_INPUTS)))


@query("wn10_quintiles", "sales", "SELECT customer_id, r_quintile, f_quintile, m_quintile FROM km", PROF + ", " + QUINT)
def _(t):
    return cluster_frame(t).select("customer_id", "r_quintile", "f_quintile", "m_quintile")


@query("wn11_tiers", "sales", f"""SELECT customer_id, list_extract(['Low', 'Mid', 'High', 'Premium'], b + 1) AS tier, tenure_bin FROM (SELECT customer_id,
    {_bin('total_spent', 'e4')} AS b, {_bin('purchase_span_days', 'e5')} AS tenure_bin FROM prof,
    (SELECT {_edges('total_spent', 4, 'prof')} AS e4, {_edges('purchase_span_days', 5, 'prof')} AS e5))""", PROF)
def _(t):
    p = qcut(qcut(materialize(profile(t, "total_spent", "purchase_span_days")), {"b": "total_spent"}, 4), {"tenure_bin": "purchase_span_days"}, 5)
    return p.select("customer_id", F.get(F.array(*[F.lit(x) for x in ("Low", "Mid", "High", "Premium")]), F.col("b")).alias("tier"), "tenure_bin")


@query("wn12_prob_group", "sales", f"SELECT customer_id, {_PROB} FROM prof, (SELECT quantile_cont(recency_days, [0.2, 0.4, 0.6, 0.8]) AS q FROM prof)", PROF)
def _(t):
    return FT.churn_prob_group(profile(t, "recency_days")).select("customer_id", "churn_prob_group")


@query("wn13_peak_month", "sales", f"SELECT {rsql(_WN13)} FROM peak", GAPS)
def _(t):
    return rounded(FT.peak_month(train(t)), _WN13)


@query("ag27_month_spend_peak", "sales", "SELECT customer_id, spend_peak_month FROM peak", GAPS)
def _(t):
    return FT.peak_month(train(t)).select("customer_id", "spend_peak_month")


# ---------------------------------------------------------------- churn features

_W = "CAST(count(DISTINCT CASE WHEN invoice_date >= mx - INTERVAL {d} DAY THEN invoice_no END) AS BIGINT) AS orders_{n}, " \
     "CAST(coalesce(sum(line_cents) FILTER (WHERE invoice_date >= mx - INTERVAL {d} DAY), 0) AS BIGINT) / 100.0::DOUBLE AS spend_{n}"
_WINS = ", ".join(_W.format(d=d, n=n) for d, n in ((60, "early_30d"), (30, "late_30d"), (120, "early_60d"), (60, "late_60d")))
FC = GAPS + f""",
    b0 AS (SELECT customer_id, sum(quantity) AS total_items, CAST(sum(line_cents) AS BIGINT) / 100.0::DOUBLE AS total_spent, avg(unit_price) AS avg_item_price,
    coalesce(stddev_samp(unit_price), 0) AS price_std, quantile_cont(unit_price, 0.25) AS price_p25, count(DISTINCT invoice_no) AS total_orders,
    count(DISTINCT stock_code) AS unique_products, CAST(min(invoice_date) AS DATE) AS fp, CAST(max(invoice_date) AS DATE) AS lp,
    avg(CASE WHEN isodow(invoice_date) >= 6 THEN 1.0::DOUBLE ELSE 0 END) AS weekend_ratio, avg(hour(invoice_date)) AS avg_purchase_hour,
    coalesce(stddev_samp(hour(invoice_date)), 0) AS hour_std,
    avg(CASE WHEN hour(invoice_date) >= 22 OR hour(invoice_date) <= 5 THEN 1.0::DOUBLE ELSE 0 END) AS is_night,
    avg(CASE WHEN hour(invoice_date) BETWEEN 9 AND 17 THEN 1.0::DOUBLE ELSE 0 END) AS is_weekday,
    CAST(count(DISTINCT month(invoice_date)) AS INTEGER) AS active_months, {_WINS} FROM tr, (SELECT max(invoice_date) AS mx FROM tr) GROUP BY 1),
    b1 AS (SELECT *, CAST(lp - fp AS INTEGER) AS purchase_span_days, CAST(DATE '2001-02-01' - lp AS INTEGER) AS recency_days,
    CAST(DATE '2001-02-01' - fp AS INTEGER) AS tenure_days, greatest(lp - fp, 1)::DOUBLE AS sp, price_std / greatest(avg_item_price, 0.01) AS price_cv,
    CASE WHEN total_orders > 1 THEN (lp - fp) / (total_orders - 1)::DOUBLE ELSE (lp - fp)::DOUBLE END AS avg_purchase_interval,
    total_spent / total_orders AS avg_spend_per_order, total_items / total_orders AS avg_items_per_order,
    orders_late_30d / greatest(orders_early_30d, 0.5)::DOUBLE AS purchase_trend_30d, orders_late_60d / greatest(orders_early_60d, 0.5)::DOUBLE AS purchase_trend_60d,
    spend_late_30d / greatest(spend_early_30d, 0.5)::DOUBLE AS spend_trend_30d, spend_late_60d / greatest(spend_early_60d, 0.5)::DOUBLE AS spend_trend_60d FROM b0),
    b2 AS (SELECT *, total_spent / sp AS spend_per_day, total_items / sp AS items_per_day, total_orders / sp * 30 AS order_frequency,
    total_orders / sp AS purchase_density, greatest(purchase_span_days / 30.0::DOUBLE, 1) AS mo FROM b1),
    b3 AS (SELECT *, purchase_trend_30d * purchase_density AS recent_density_ratio, recency_days / greatest(avg_purchase_interval, 1) AS recency_vs_interval,
    recency_days / greatest(purchase_span_days + recency_days, 1)::DOUBLE AS recency_vs_lifespan, 1 / (1 + avg_purchase_interval) AS purchase_consistency,
    unique_products * order_frequency AS diversity_x_freq, avg_spend_per_order / greatest(avg_item_price, 0.01) AS spend_depth,
    active_months / mo AS activity_rate, CAST(avg_items_per_order > (SELECT quantile_cont(avg_items_per_order, 0.9) FROM b1) AS INTEGER) AS is_bulk_buyer,
    unique_products / total_orders::DOUBLE AS product_diversity, price_std / greatest(avg_item_price, 0.01) AS spending_cv, price_p25 * 2 AS price_range,
    least(100, recency_days / 365.0::DOUBLE * 100) AS recency_score,
    CAST(greatest(floor(recency_days - avg_purchase_interval), 0) AS INTEGER) AS days_overdue, (1 - active_months / mo) * 50 AS low_engagement_score FROM b2),
    b4 AS (SELECT *, least(100, days_overdue / 180.0::DOUBLE * 100) AS overdue_score FROM b3),
    b5 AS (SELECT *, recency_score * 0.5::DOUBLE + overdue_score * 0.3::DOUBLE + low_engagement_score * 0.2::DOUBLE AS churn_risk_score FROM b4),
    lab AS (SELECT customer_id, CAST(min(invoice_date) AS DATE) AS fl FROM sales WHERE invoice_date >= DATE '2001-02-01' GROUP BY 1),
    fc AS (SELECT b5.*, 100 - churn_risk_score AS loyalty_index, CAST(churn_risk_score > 60 AS INTEGER) AS is_at_risk, CAST(fl IS NULL AS INTEGER) AS is_churn, fl,
    CASE WHEN total_orders <= 1 THEN 'Cold-Start' ELSE 'Established' END AS prediction_tier FROM b5 LEFT JOIN lab USING (customer_id))"""


def churn_frame(t, columns=None):
    return FT.churn_features(lines(t), CUT_DATE, columns=columns)


def _fc(key, spec, frame, src="fc"):
    spec = {"customer_id": None, **spec}
    query(key, "sales", f"SELECT {rsql(spec)} FROM {src}", FC)(lambda t: rounded(frame(t, list(spec)), spec))


def base_frame(t, columns=None):
    return FT.churn_base(lines(t), CUT_DATE, columns)


def derived_frame(t, columns=None):
    return FT.derive_churn(base_frame(t, columns), CUT_DATE, columns=columns)


_fc("fc1_volume_price", {"total_items": 2, "total_spent": 2, "avg_item_price": 6, "price_std": 6, "price_p25": 10, "price_cv": 6,
                         "total_orders": None, "unique_products": None}, base_frame)
_fc("fc2_span_interval", {"purchase_span_days": None, "avg_purchase_interval": 6}, base_frame)
_fc("fc3_recency_tenure", {"recency_days": None, "tenure_days": None}, base_frame)
_fc("fc4_rates", {"avg_spend_per_order": 5, "avg_items_per_order": 6, "spend_per_day": 5, "items_per_day": 6, "order_frequency": 6}, base_frame)
_fc("fc5_time_patterns", {"weekend_ratio": 6, "avg_purchase_hour": 6, "hour_std": 6, "is_night": 6, "is_weekday": 6,
                          "active_months": None}, base_frame)
_fc("fc6_window_trends", {"orders_early_30d": None, "orders_late_30d": None, "orders_early_60d": None, "orders_late_60d": None,
                          "spend_early_30d": 2, "spend_late_60d": 2, "purchase_trend_30d": 6, "purchase_trend_60d": 6,
                          "spend_trend_30d": 6, "spend_trend_60d": 6}, base_frame)
_fc("fc7_intervals", {"interval_mean": 6, "interval_std": 5, "interval_cv": 6}, lambda t, _: FT.purchase_gaps(train(t)), "gap")
_fc("fc8_density", {"purchase_density": 6, "recent_density_ratio": 6, "recency_vs_interval": 6, "recency_vs_lifespan": 6,
                    "purchase_consistency": 6, "diversity_x_freq": 6, "spend_depth": 6}, derived_frame)
_fc("fc10_engagement", {"activity_rate": 6, "is_bulk_buyer": None, "product_diversity": 6}, derived_frame)
_fc("fc13_risk", {"recency_score": 6, "days_overdue": None, "overdue_score": 6, "low_engagement_score": 6, "churn_risk_score": 6,
                  "loyalty_index": 6, "is_at_risk": None}, derived_frame)
_fc("fc12_label", {"is_churn": None}, churn_frame)
_fc("fc19_tier", {"prediction_tier": None}, churn_frame)


@query("fc9_relative_trends", "sales", """SELECT customer_id, round(coalesce(relative_freq_trend, 0), 6) AS relative_freq_trend,
    round(coalesce(relative_spend_trend, 0), 6) AS relative_spend_trend, round(last_interval_ratio, 6) AS last_interval_ratio
    FROM gap LEFT JOIN half USING (customer_id)""", GAPS)
def _(t):
    spec = {"customer_id": None, "relative_freq_trend": 6, "relative_spend_trend": 6, "last_interval_ratio": 6}
    return rounded(churn_frame(t, list(spec)), spec)


@query("fc11_spending_profile", "sales", """SELECT customer_id, round(spending_cv, 6) AS spending_cv, round(price_range, 10) AS price_range,
    spend_peak_month, round(spend_peak_ratio, 6) AS spend_peak_ratio FROM fc JOIN peak USING (customer_id)""", FC)
def _(t):
    spec = {"customer_id": None, "spending_cv": 6, "price_range": 10, "spend_peak_month": None, "spend_peak_ratio": 6}
    return rounded(churn_frame(t, list(spec)), spec)


@query("fc20_three_cuts", "sales", " UNION ALL ".join(f"""SELECT DATE '{d}' AS cut, count(*) AS customers, CAST(sum(o) AS BIGINT) AS orders, CAST(sum(c) AS BIGINT) AS cents,
    CAST(sum(p) AS BIGINT) AS products, round(avg(price_p25), 6) AS price_p25, CAST(sum(CASE WHEN fl IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS churned,
    CAST(sum(CASE WHEN o <= 1 THEN 1 ELSE 0 END) AS BIGINT) AS cold FROM (SELECT customer_id, count(DISTINCT invoice_no) AS o, sum(line_cents) AS c, count(DISTINCT stock_code) AS p,
    quantile_cont(unit_price, 0.25) AS price_p25 FROM sales WHERE invoice_date <= TIMESTAMP '{d}' GROUP BY 1) LEFT JOIN (SELECT customer_id, min(invoice_date) AS fl FROM sales
    WHERE invoice_date >= DATE '{d}' + 1 AND invoice_date <= TIMESTAMP '2001-06-30' GROUP BY 1) USING (customer_id)""" for d in ("2000-10-31", "2000-11-30", "2000-12-31")))
def _(t):
    f = AT.churn_features_at(lines(t), ["2000-10-31", "2000-11-30", "2000-12-31"], "2001-06-30")
    return f.groupBy("cut").agg(F.count("*").alias("customers"), F.sum("total_orders").alias("orders"), F.sum(F.round(F.col("total_spent") * 100).cast("long")).alias("cents"),
                                F.sum("unique_products").alias("products"), F.round(F.avg("price_p25"), 6).alias("price_p25"), F.sum(F.col("is_churn").cast("long")).alias("churned"),
                                F.sum((F.col("prediction_tier") == "Cold-Start").cast("long")).alias("cold"))


@query("fc14_cluster_onehot", "sales rfm", f"""SELECT fc.customer_id, coalesce(cluster, -1) AS cluster_id, CAST(coalesce(cluster, -1) = 0 AS INTEGER) AS cluster_0,
    CAST(coalesce(cluster, -1) = 1 AS INTEGER) AS cluster_1 FROM fc LEFT JOIN cl USING (customer_id)""", FC + ", " + CLUSTER_SQL)
def _(t):
    from ..operators.dims import inject_clusters
    return inject_clusters(train(t).select("customer_id").distinct(), cluster_labels(t), [0, 1])


@query("fc15_next_purchase", "sales", """SELECT customer_id, CAST(CASE WHEN fl - DATE '2001-02-01' <= 30 THEN 0 WHEN fl - DATE '2001-02-01' <= 90 THEN 1 ELSE 2 END
    AS INTEGER) AS purchase_window, CAST(least(coalesce(fl - DATE '2001-02-01', 180), 180) AS INTEGER) AS days_to_next FROM fc""", FC)
def _(t):
    return FT.next_purchase(churn_frame(t, ["last_purchase", "first_label_purchase"]), CUT_DATE).select("customer_id", "purchase_window", "days_to_next")


@query("fc16_recency_extras", "sales", """SELECT customer_id, CAST(DATE '2001-02-01' - lp AS INTEGER) AS days_to_label_start, CAST(month(lp) AS INTEGER) AS last_purchase_month,
    CAST(DATE '2001-01-31' - lp AS INTEGER) AS recency_from_train_end FROM fc""", FC)
def _(t):
    return FT.next_purchase(churn_frame(t, ["last_purchase", "first_label_purchase"]), CUT_DATE).select("customer_id", "days_to_label_start", "last_purchase_month", "recency_from_train_end")


@query("fc17_feature_lists", "sales", f"""SELECT customer_id, {len(FT.churn_feature_columns())} AS n_churn, {len(FT.churn_feature_columns(FT.CLV_EXCLUDE))} AS n_clv,
    total_orders FROM fc""", FC)
def _(t):
    df, a, b = churn_frame(t), FT.churn_feature_columns(), FT.churn_feature_columns(FT.CLV_EXCLUDE)
    return df.select("customer_id", F.size(F.array(*[F.col(c).cast("double") for c in a])).alias("n_churn"),
                     F.size(F.array(*[F.col(c).cast("double") for c in b])).alias("n_clv"), "total_orders")


_LK = ["recency_days", "tenure_days", "total_orders", "total_spent", "unique_products", "weekend_ratio", "product_diversity"]


@query("fc18_leakage_scan", "sales", "SELECT feature, round(abs_r, 6) AS abs_r, CASE WHEN abs_r > 0.9 THEN 'drop' WHEN abs_r > 0.7 THEN 'warn' ELSE 'keep' END AS verdict FROM (" +
       " UNION ALL ".join(f"SELECT '{c}' AS feature, abs(corr({c}::DOUBLE, is_churn::DOUBLE)) AS abs_r FROM fc" for c in _LK) + ")", FC)
def _(t):
    return FT.leakage_scan(churn_frame(t), _LK).select("feature", F.round("abs_r", 6).alias("abs_r"), "verdict")


# ---------------------------------------------------------------- cluster features and label-based measures

_KM1 = {"customer_id": None, "r_quintile": None, "f_quintile": None, "m_quintile": None, "product_diversity": None, "is_bulk_buyer": None,
        "purchase_velocity": 8, "activity_rate": 8, "weekend_ratio": 6, "avg_spend_per_order": 8, "total_orders": None, "recency_days": None}


@query("km1_cluster_features", "sales", f"SELECT {rsql(_KM1)} FROM km", PROF + ", " + QUINT)
def _(t):
    return rounded(cluster_frame(t), _KM1)


@query("km2_standard_scale", "sales", "SELECT customer_id, " + ", ".join(
    f"round(({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER (), 5) AS z_{c}" for c in ("m_quintile", "purchase_velocity", "recency_days")) + " FROM km", PROF + ", " + QUINT)
def _(t):
    cols = ["m_quintile", "purchase_velocity", "recency_days"]
    return FT.standard_scale(cluster_frame(t), cols).select("customer_id", *[F.round(f"z_{c}", 5).alias(f"z_{c}") for c in cols])


@query("km3_log_minmax", "sales", "SELECT customer_id, " + ", ".join(
    f"round((ln(1 + {c}) - min(ln(1 + {c})) OVER ()) / (max(ln(1 + {c})) OVER () - min(ln(1 + {c})) OVER ()), 6) AS u_{c}"
    for c in ("m_quintile", "purchase_velocity", "recency_days")) + " FROM km", PROF + ", " + QUINT)
def _(t):
    cols = ["m_quintile", "purchase_velocity", "recency_days"]
    return FT.minmax_scale(cluster_frame(t), cols, log=True).select("customer_id", *[F.round(f"u_{c}", 6).alias(f"u_{c}") for c in cols])


_PROFILES = """pj AS (SELECT prof.*, cluster FROM prof JOIN cl USING (customer_id)),
    cp AS (SELECT cluster, count(*) AS size, count(*) * 100.0::DOUBLE / (SELECT count(*) FROM pj) AS pct, quantile_cont(recency_days::DOUBLE, 0.5) AS recency_days,
    quantile_cont(total_orders::DOUBLE, 0.5) AS total_orders, quantile_cont(total_spent, 0.5) AS total_spent FROM pj GROUP BY 1),
    lb AS (SELECT *, CASE WHEN cluster = 999 THEN '超多样化客户' WHEN recency_days <= 30 AND total_orders >= 8 THEN '忠诚客户'
    WHEN recency_days <= 45 AND total_orders >= 4 AND total_spent >= g THEN '高价值忠诚客户' WHEN recency_days <= 60 AND total_orders >= 3 THEN '一般活跃客户'
    WHEN recency_days > 180 AND total_spent < g * 0.3 THEN '深度流失客户' WHEN recency_days > 180 THEN '低频流失客户' WHEN recency_days > 120 THEN '流失预警客户'
    WHEN total_spent >= g * 1.5 THEN '高消费低频客户' WHEN total_orders <= 2 AND recency_days <= 90 THEN '新客户' ELSE '普通客户' END AS label
    FROM cp, (SELECT quantile_cont(total_spent, 0.5) AS g FROM pj))"""
_PX = PROF + ", " + CLUSTER_SQL + ", " + _PROFILES


def _profiled(t):
    p = materialize(profile(t).join(cluster_labels(t), "customer_id"))
    return p, SG.label_profiles(SG.cluster_profiles(p), p)


@query("ag30_cluster_profiles", "sales rfm", "SELECT cluster, size, round(pct, 4) AS pct, recency_days, total_orders, round(total_spent, 4) AS total_spent FROM cp", _PX)
def _(t):
    c = SG.cluster_profiles(profile(t).join(cluster_labels(t), "customer_id"))
    return c.select("cluster", "size", F.round("pct", 4).alias("pct"), "recency_days", "total_orders", F.round("total_spent", 4).alias("total_spent"))


@query("ag31_label_ratios", "sales rfm", """SELECT CASE label WHEN '高价值忠诚客户' THEN '高价值客户' WHEN '一般活跃客户' THEN '活跃客户' ELSE label END AS label,
    round(sum(pct), 6) AS pct FROM lb GROUP BY 1""", _PX)
def _(t):
    return SG.label_ratios(_profiled(t)[1]).select("label", F.round("pct", 6).alias("pct"))


@query("km15_business_label", "sales rfm", "SELECT cluster, label FROM lb", _PX)
def _(t):
    return _profiled(t)[1].select("cluster", "label")


@query("km16_write_segments", "sales rfm", """SELECT p.customer_id, p.cluster, CASE label WHEN '高价值忠诚客户' THEN '高价值客户' WHEN '一般活跃客户' THEN '活跃客户' ELSE label END AS segment,
    p.recency_days FROM pj p JOIN lb USING (cluster)""", _PX)
def _(t):
    p, lab = _profiled(t)
    return SG.write_segments(p.select("customer_id", "recency_days"), p.select("customer_id", "cluster"), lab)


_DBC = ("m_quintile", "r_quintile", "weekend_ratio")


@query("km11_dispersion", "sales rfm", """SELECT round(avg(r), 6) AS davies_bouldin, round(max(ch), 4) AS calinski_harabasz FROM (
    SELECT a.cluster, max((a.s + b.s) / sqrt((a.x-b.x)**2 + (a.y-b.y)**2 + (a.z-b.z)**2)) AS r FROM w a JOIN w b ON a.cluster <> b.cluster GROUP BY 1) t,
    (SELECT sum(n * ((x-gx)**2 + (y-gy)**2 + (z-gz)**2)) * (sum(n) - count(*)) / (sum(w) * (count(*) - 1)) AS ch FROM w,
    (SELECT avg(m_quintile) AS gx, avg(r_quintile) AS gy, avg(weekend_ratio) AS gz FROM kc) g) c""", PROF + ", " + QUINT + ", " + CLUSTER_SQL + """,
    kc AS (SELECT km.*, cluster FROM km JOIN cl USING (customer_id)),
    ct AS (SELECT cluster, count(*) AS n, avg(m_quintile) AS x, avg(r_quintile) AS y, avg(weekend_ratio) AS z FROM kc GROUP BY 1),
    w AS (SELECT cluster, max(n) AS n, max(x) AS x, max(y) AS y, max(z) AS z, avg(sqrt((m_quintile-x)**2 + (r_quintile-y)**2 + (weekend_ratio-z)**2)) AS s,
    sum((m_quintile-x)**2 + (r_quintile-y)**2 + (weekend_ratio-z)**2) AS w FROM kc JOIN ct USING (cluster) GROUP BY 1)""")
def _(t):
    d = SG.dispersion_scores(cluster_frame(t).join(cluster_labels(t), "customer_id"), _DBC)
    return d.select(F.round("davies_bouldin", 6).alias("davies_bouldin"), F.round("calinski_harabasz", 4).alias("calinski_harabasz"))


@query("km12_adjusted_rand", "rfm", """WITH p AS (SELECT r_score AS a, f_score AS b FROM rfm), t AS (SELECT a, b, count(*) AS n FROM p GROUP BY 1, 2),
    s AS (SELECT sum(n * (n - 1) / 2.0::DOUBLE) AS s, sum(n)::DOUBLE AS n FROM t), ra AS (SELECT sum(n * (n - 1) / 2.0::DOUBLE) AS ra FROM (SELECT sum(n)::DOUBLE AS n FROM t GROUP BY a)),
    rb AS (SELECT sum(n * (n - 1) / 2.0::DOUBLE) AS rb FROM (SELECT sum(n)::DOUBLE AS n FROM t GROUP BY b))
    SELECT round((s - ra * rb / (n * (n - 1) / 2)) / ((ra + rb) / 2 - ra * rb / (n * (n - 1) / 2)), 6) AS ari FROM s, ra, rb""")
def _(t):
    return SG.adjusted_rand(t.rfm.select(F.col("r_score").alias("a"), F.col("f_score").alias("b"))).select(F.round("ari", 6).alias("ari"))
