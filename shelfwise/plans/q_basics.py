"""Scans, sinks, cleaning, filters, joins, aggregates, paging and set operations."""

from pyspark.sql import functions as F

from .. import schemas as S
from ..functions import scalars as X
from ..functions.quantiles import exact_quantiles
from ..operators import catalogue as C
from ..operators import cleaning as CL
from ..operators import dims as D
from ..operators import kpis as K
from ..operators import quality as Q
from ..operators import rfm as R
from ..session import shared_dir
from ..sources import readers, sinks
from .registry import query

# ---------------------------------------------------------------- scans and sinks


@query("sc1_invoice_csv", "tx", """SELECT customer_id, count(*) AS n, CAST(sum(quantity) AS BIGINT) AS units,
    count(DISTINCT invoice_no) AS invoices FROM tx WHERE NOT cancelled GROUP BY 1""")
def _(t):
    path = shared_dir(t.spark, "csv")
    li = t.lines("invoice_no", "stock_code", "description", "quantity", "invoice_date", "unit_price", "customer_id",
                 "country", "cancelled")
    li.select(
        F.concat(F.when(F.col("cancelled"), "C").otherwise(""), F.col("invoice_no")).alias("InvoiceNo"),
        F.col("stock_code").alias("StockCode"), F.col("description").alias("Description"),
        F.col("quantity").cast("int").alias("Quantity"),
        F.date_format("invoice_date", "yyyy-MM-dd HH:mm:ss").alias("InvoiceDate"), F.col("unit_price").alias("UnitPrice"),
        F.col("customer_id").alias("CustomerID"), F.col("country").alias("Country"),
    ).write.csv(path, header=True, encoding="ISO-8859-1")
    df = CL.positive_lines(CL.drop_cancelled(CL.drop_missing_keys(readers.read_invoices(t.spark, path))))
    return df.groupBy("customer_id").agg(F.count("*").alias("n"), F.sum(F.col("quantity").cast("long")).alias("units"),
                                         F.countDistinct("invoice_no").alias("invoices"))


@query("sc2_table_scan", "", "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 400000")
def _(t):
    return readers.read_table(t.spark, f"{t.path}/orders.parquet", ["o_orderkey", "o_custkey"],
                              "o_orderstatus = 'F' AND o_totalprice > 400000")


@query("sc3_artifact_or_empty", "rfm", "SELECT segment, count(*) AS n FROM rfm GROUP BY 1")
def _(t):
    path = shared_dir(t.spark, "artifacts")
    missing = readers.read_artifact(t.spark, path + "-none", S.RFM)
    t.rfm.write.parquet(path)
    return readers.read_artifact(t.spark, path, S.RFM).unionByName(missing).groupBy("segment").agg(F.count("*").alias("n"))


@query("sc4_chart_payload", "rfm", "SELECT segment, count(*) AS count FROM rfm GROUP BY 1")
def _(t):
    folder = shared_dir(t.spark, "viz")
    sinks.export_json(K.rfm_summary(t.rfm).select("segment", "count"), f"{folder}/phase3_viz.json")
    return readers.read_chart(t.spark, folder, "Clustering").select("segment", "count")


_LOG = """SELECT event_type AS label, CAST(floor(value * 10) AS BIGINT) AS elapsed, event_id % 50 <> 0 AS ok FROM events"""


@query("sc5_load_log", "", f"SELECT label, ok, count(*) AS n, CAST(sum(elapsed) AS BIGINT) AS ms FROM ({_LOG}) GROUP BY 1, 2")
def _(t):
    return _load_log(t).groupBy("label", "ok").agg(F.count("*").alias("n"), F.sum("elapsed").alias("ms"))


def _load_log(t):
    path = shared_dir(t.spark, "load")
    t.raw("events").select(
        F.unix_millis(F.col("ts").cast("timestamp")).alias("timeStamp"), F.floor(F.col("value") * 10).cast("long").alias("elapsed"),
        F.col("event_type").alias("label"), F.lit("200").alias("responseCode"),
        F.when(F.col("event_id") % 50 != 0, "true").otherwise("false").alias("success")).write.csv(path, header=True)
    return readers.read_load_log(t.spark, path)


@query("ag32_load_latency", "", f"""WITH l AS ({_LOG}), r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY elapsed) - 1 AS i,
    count(*) OVER (PARTITION BY label) AS n FROM l)
    SELECT label, max(n) AS total, count(*) FILTER (WHERE NOT ok) AS failed,
    round(100.0::DOUBLE * count(*) FILTER (WHERE NOT ok) / max(n), 4) AS error_pct,
    round(CAST(sum(elapsed) AS DOUBLE) / max(n), 4) AS mean_ms, max(elapsed) FILTER (WHERE i = CAST(floor(n * 0.95) AS BIGINT)) AS p95_ms,
    max(n) / 10.0::DOUBLE AS per_second FROM r GROUP BY 1""")
def _(t):
    return Q.load_summary(_load_log(t))


@query("sk1_full_refresh", "rfm", "SELECT segment, r_score, count(*) AS n FROM rfm GROUP BY 1, 2")
def _(t):
    path = shared_dir(t.spark, "refresh")
    sinks.full_refresh(t.rfm, path, ["segment"])
    again = t.rfm.where(F.col("segment") == S.SEG_POTENTIAL)
    sinks.full_refresh(again, path, ["segment"], partitions_only=True)
    return t.spark.read.parquet(path).groupBy("segment", "r_score").agg(F.count("*").alias("n"))


@query("sk2_write_if_absent", "churn", "SELECT is_churn_risk, count(*) AS n FROM churn GROUP BY 1")
def _(t):
    path = shared_dir(t.spark, "absent")
    sinks.write_if_absent(t.churn, path)
    sinks.write_if_absent(t.churn.where("is_churn_risk"), path)
    return t.spark.read.parquet(path).groupBy("is_churn_risk").agg(F.count("*").alias("n"))


@query("sk3_append", "ord", "SELECT status, count(*) AS n FROM ord GROUP BY 1")
def _(t):
    path = shared_dir(t.spark, "append")
    sinks.append(t.orders.where("status <> 'pending'"), path)
    sinks.append(t.orders.where("status = 'pending'"), path)
    return t.spark.read.parquet(path).groupBy("status").agg(F.count("*").alias("n"))


@query("sk4_metric_upsert", "metrics", "SELECT model_name, metric_name, metric_value, detail FROM metrics")
def _(t):
    cols = ["model_name", "metric_name", "metric_value", "detail", "created_at"]
    log = t.metric_log
    half = F.lit("2024-01-16").cast("timestamp")
    old = sinks.upsert_latest(log.where(F.col("created_at") < half), ["model_name", "metric_name"], ["id"]).select(*cols)
    new = sinks.upsert_latest(log.where(F.col("created_at") >= half), ["model_name", "metric_name"], ["id"]).select(*cols)
    return sinks.upsert_metrics(old, new).select(*cols[:4])


@query("sk5_json_export", "prod", """SELECT product_id, '{"product_id":' || product_id || ',"name":"' || name || '","price":' || price || '}' AS payload
    FROM prod""")
def _(t):
    p = t.products.select("product_id", "name", "price")
    return p.select("product_id", F.to_json(F.struct("product_id", "name", "price")).alias("payload"))


# ---------------------------------------------------------------- cleaning

_NULLED = """SELECT event_id AS invoice_no, CASE WHEN event_id % 7 = 0 THEN NULL ELSE user_id END AS customer_id,
    CASE WHEN event_id % 11 = 0 THEN NULL ELSE event_type END AS description FROM events"""


@query("cl1_drop_missing_keys", "", f"WITH e AS ({_NULLED}) SELECT * FROM e WHERE customer_id IS NOT NULL AND description IS NOT NULL")
def _(t):
    e = t.raw("events").select(
        F.col("event_id").alias("invoice_no"), F.when(F.col("event_id") % 7 != 0, F.col("user_id")).alias("customer_id"),
        F.when(F.col("event_id") % 11 != 0, F.col("event_type")).alias("description"))
    return CL.drop_missing_keys(e)


@query("cl2_drop_cancelled", "tx", "SELECT invoice_no, count(*) AS n FROM tx WHERE NOT cancelled GROUP BY 1")
def _(t):
    li = t.lines("invoice_no", "cancelled")
    return CL.drop_cancelled(li).groupBy("invoice_no").agg(F.count("*").alias("n"))


@query("cl3_positive_lines", "tx", "SELECT stock_code, count(*) AS n FROM tx WHERE quantity > 25 AND unit_price > 0 GROUP BY 1")
def _(t):
    li = t.lines("stock_code", "quantity", "unit_price").withColumn("quantity", F.col("quantity") - 25)
    return CL.positive_lines(li).groupBy("stock_code").agg(F.count("*").alias("n"))


@query("cl4_line_total", "sales", """SELECT CAST(invoice_date AS DATE) AS invoice_day, count(*) AS n,
    CAST(sum(CAST(round(quantity * unit_price * 100) AS BIGINT)) AS BIGINT) AS cents FROM sales GROUP BY 1""")
def _(t):
    li = CL.with_line_total(t.sales("invoice_date", "quantity", "unit_price"))
    return li.groupBy("invoice_day").agg(F.count("*").alias("n"), F.sum(X.to_cents(F.col("line_total"))).alias("cents"))


FENCED = """q1 AS (SELECT quantile_cont(quantity, 0.25) AS a, quantile_cont(quantity, 0.75) AS b FROM sales),
    s1 AS (SELECT sales.* FROM sales, q1 WHERE quantity BETWEEN a - 3 * (b - a) AND b + 3 * (b - a)),
    q2 AS (SELECT quantile_cont(unit_price, 0.25) AS a, quantile_cont(unit_price, 0.75) AS b FROM s1),
    fenced AS (SELECT s1.* FROM s1, q2 WHERE unit_price BETWEEN a - 3 * (b - a) AND b + 3 * (b - a))"""
_TIGHT = FENCED.replace("3 *", "0.4 *")


@query("cl5_iqr_fences", "sales", "SELECT invoice_no, count(*) AS n, CAST(sum(line_cents) AS BIGINT) AS cents FROM fenced GROUP BY 1", _TIGHT)
def _(t):
    li = CL.iqr_fences(t.sales("invoice_no", "quantity", "unit_price", "line_cents"), k=0.4)
    return li.groupBy("invoice_no").agg(F.count("*").alias("n"), F.sum("line_cents").alias("cents"))


@query("cl6_normalize_description", "", """SELECT upper(trim(p_name)) AS description, count(*) AS n FROM
    (SELECT CASE WHEN p_partkey % 9 = 0 THEN '   ' ELSE '  ' || p_name || ' ' END AS p_name FROM part) WHERE trim(p_name) <> '' GROUP BY 1""")
def _(t):
    p = t.raw("part").select(F.when(F.col("p_partkey") % 9 == 0, "   ").otherwise(
        F.concat(F.lit("  "), F.col("p_name"), F.lit(" "))).alias("description"))
    return CL.normalize_description(p).groupBy("description").agg(F.count("*").alias("n"))


@query("cl7_fill_and_impute", "", """WITH e AS (SELECT event_id, CASE WHEN event_id % 5 = 0 THEN NULL ELSE value END AS a,
    CASE WHEN event_id % 6 = 0 THEN NULL ELSE value END AS b FROM events)
    SELECT event_id, coalesce(a, 0.0::DOUBLE) AS a, coalesce(b, (SELECT quantile_cont(b, 0.5) FROM e)) AS b FROM e""")
def _(t):
    e = t.raw("events").select("event_id", F.when(F.col("event_id") % 5 != 0, F.col("value")).alias("a"),
                               F.when(F.col("event_id") % 6 != 0, F.col("value")).alias("b"))
    return CL.impute_median(CL.fill_features(e, ["a"]), ["b"])


@query("cl8_temporal_split", "sales", """SELECT CASE WHEN invoice_date <= DATE '2001-01-31' THEN 'train' ELSE 'label' END AS part,
    count(*) AS n, count(DISTINCT customer_id) AS customers FROM sales GROUP BY 1""")
def _(t):
    from ..sources.canonical import CUT_DATE
    a, b = CL.temporal_split(t.sales("customer_id", "invoice_date"), CUT_DATE)
    both = a.withColumn("part", F.lit("train")).unionByName(b.withColumn("part", F.lit("label")))
    return both.groupBy("part").agg(F.count("*").alias("n"), F.countDistinct("customer_id").alias("customers"))


# ---------------------------------------------------------------- filters


@query("fi1_catalogue_filter", "prod", """SELECT product_id, name, price FROM prod WHERE is_active AND category_name = 'ECONOMY'
    AND contains(name, 'red') AND price BETWEEN 90000 AND 150000""")
def _(t):
    return C.filter_products(t.products, category="ECONOMY", text="red", min_price=90000, max_price=150000).select(
        "product_id", "name", "price")


@query("fi3_orders_by_status", "ord", "SELECT order_id, created_at FROM ord WHERE status = 'paid' ORDER BY created_at DESC, order_id LIMIT 40 OFFSET 40")
def _(t):
    o = t.orders.where("status = 'paid'")
    return C.page_of(o, [F.desc("created_at"), F.asc("order_id")], 2, 40).select("order_id", "created_at")


@query("fi4_admin_search", "prod", "SELECT product_id, is_active FROM prod WHERE NOT is_active AND contains(name, 'bolt')")
def _(t):
    return C.filter_products(t.products, active=False, text="bolt").select("product_id", "is_active")


@query("fi5_purge_split", "ord usr", """SELECT CASE WHEN email LIKE '%7@customers.example' THEN 'keep' ELSE 'purge' END AS side, count(*) AS n
    FROM ord JOIN usr USING (user_id) GROUP BY 1""")
def _(t):
    keep, purge = CL.purge_split(t.orders, t.users, "7@customers.example")
    return keep.select(F.lit("keep").alias("side")).unionByName(purge.select(F.lit("purge").alias("side"))).groupBy("side").agg(
        F.count("*").alias("n"))


@query("fi6_metric_prefix", "metrics", "SELECT metric_name, metric_value FROM metrics WHERE metric_name LIKE 'feature\\_importance\\_%' ESCAPE '\\'")
def _(t):
    return t.metrics.where(F.col("metric_name").startswith("feature_importance_")).select("metric_name", "metric_value")


@query("fi7_favorite_check", "carts favs", """SELECT user_id, product_id, (user_id, product_id) IN (SELECT user_id, product_id FROM favs) AS is_favorite
    FROM carts""")
def _(t):
    c = t.cart_adds.select("user_id", "product_id").distinct()
    return C.membership(c, t.favorites, ["user_id", "product_id"], "is_favorite")


# ---------------------------------------------------------------- joins


@query("jn1_sort_by_rating", "prod reviews", """SELECT product_id, rating FROM prod LEFT JOIN (SELECT product_id, avg(rating) AS rating
    FROM reviews GROUP BY 1) USING (product_id) ORDER BY rating DESC NULLS LAST, product_id LIMIT 100""")
def _(t):
    df, order = C.sort_products(t.products, t.reviews, "rating", "desc")
    return C.page_of(df, order, 1, 100).select("product_id", "rating")


@query("jn2_churn_page", "churn usr rfm", """SELECT c.user_id, churn_prob AS churn_probability, email, name AS user_name, segment,
    CASE WHEN churn_prob >= 0.85 THEN 'high' WHEN churn_prob >= 0.5 THEN 'medium' ELSE 'low' END AS risk_level, c.status,
    strftime(c.created_at, '%Y-%m-%d') AS prediction_date
    FROM (SELECT * FROM churn WHERE is_churn_risk ORDER BY churn_prob DESC, user_id LIMIT 20 OFFSET 20) c
    JOIN usr USING (user_id) JOIN rfm USING (user_id)""")
def _(t):
    return K.churn_list(t.churn, t.users, t.rfm, page=2, per_page=20, risk_only=True)


_PREF = """SELECT user_id, category_name AS category, CAST(sum(line_cents) AS BIGINT) AS amount, count(*) AS count
    FROM ord JOIN items USING (order_id) JOIN prod USING (product_id) GROUP BY 1, 2"""


@query("jn3_category_items", "ord items prod", f"SELECT user_id, category, amount FROM ({_PREF})")
def _(t):
    return K.category_preference(t.orders, t.items, t.products).select("user_id", "category", "amount")


@query("jn5_feature_assembly", "sales", """SELECT customer_id, count(DISTINCT invoice_no) AS total_orders,
    round(avg(CASE WHEN isodow(invoice_date) >= 6 THEN 1.0::DOUBLE ELSE 0.0 END), 6) AS weekend_ratio,
    count(DISTINCT month(invoice_date)) AS active_months,
    count(DISTINCT CASE WHEN invoice_date >= DATE '2000-12-02' THEN invoice_no END) AS orders_early_30d FROM sales
    WHERE invoice_date <= DATE '2001-01-31' GROUP BY 1""")
def _(t):
    tr, _l = CL.temporal_split(t.sales("customer_id", "invoice_no", "invoice_date"), "2001-01-31")
    return tr.groupBy("customer_id").agg(
        F.countDistinct("invoice_no").alias("total_orders"),
        F.round(F.avg(F.when(F.weekday("invoice_date") >= 5, 1.0).otherwise(0.0)), 6).alias("weekend_ratio"),
        F.countDistinct(F.month("invoice_date")).alias("active_months"),
        F.countDistinct(F.when(F.col("invoice_date") >= "2000-12-02", F.col("invoice_no"))).alias("orders_early_30d"))


_SPLIT = """tr AS (SELECT * FROM sales WHERE invoice_date <= DATE '2001-01-31'), lb AS (SELECT * FROM sales WHERE invoice_date >= DATE '2001-02-01')"""


def _split(t, *cols):
    return CL.temporal_split(t.sales(*dict.fromkeys(["customer_id", "invoice_date", *cols])), "2001-01-31")


@query("jn6_churn_label", "sales", """SELECT customer_id, CAST(CASE WHEN customer_id IN (SELECT customer_id FROM lb) THEN 0 ELSE 1 END AS INTEGER)
    AS is_churn FROM tr GROUP BY 1""", _SPLIT)
def _(t):
    return D.churn_labels(*_split(t))


@query("jn7_first_label_purchase", "sales", """SELECT customer_id, CAST(min(lb.invoice_date) AS DATE) AS first_label
    FROM (SELECT DISTINCT customer_id FROM tr) LEFT JOIN lb USING (customer_id) GROUP BY 1""", _SPLIT)
def _(t):
    return D.first_label_purchase(*_split(t))


CLUSTER_SQL = "cl AS (SELECT user_id AS customer_id, CASE WHEN f_score >= 4 THEN 0 WHEN f_score = 3 THEN 1 ELSE 2 END AS cluster FROM rfm)"


def cluster_labels(t):
    """Deterministic three-way label used where a fitted model would give one."""
    return t.rfm.select(F.col("user_id").alias("customer_id"),
                        F.expr("CASE WHEN f_score >= 4 THEN 0 WHEN f_score = 3 THEN 1 ELSE 2 END").alias("cluster"))


@query("jn8_cluster_onehot", "rfm usr", """SELECT user_id AS customer_id, coalesce(cluster, -1) AS cluster_id,
    CAST(coalesce(cluster, -1) = 0 AS INTEGER) AS cluster_0, CAST(coalesce(cluster, -1) = 1 AS INTEGER) AS cluster_1,
    CAST(coalesce(cluster, -1) = 2 AS INTEGER) AS cluster_2 FROM usr LEFT JOIN cl ON user_id = customer_id""", CLUSTER_SQL)
def _(t):
    return D.inject_clusters(t.users.select(F.col("user_id").alias("customer_id")), cluster_labels(t), [0, 1, 2])


@query("jn9_resolve_users", "ord usr", "SELECT DISTINCT user_id AS customer_id, user_id FROM ord")
def _(t):
    return D.resolve_users(t.orders.select(F.col("user_id").alias("customer_id")).distinct(), t.users)


@query("jn10_order_items", "tx", """SELECT invoice_no, count(*) AS n, CAST(sum(quantity) AS BIGINT) AS units, CAST(sum(line_cents) AS BIGINT) AS cents
    FROM tx GROUP BY 1""")
def _(t):
    it = D.order_items(t.lines("invoice_no", "stock_code", "quantity", "line_cents"))
    return it.groupBy("order_id", "invoice_no").agg(F.count("*").alias("n"), F.sum("quantity").alias("units"),
                                                    F.sum("line_cents").alias("cents")).drop("order_id")


@query("jn11_names", "favs prod usr", """SELECT f.user_id, f.product_id, p.name AS product_name, u.name AS user_name FROM favs f
    LEFT JOIN prod p USING (product_id) LEFT JOIN usr u ON f.user_id = u.user_id""")
def _(t):
    return D.with_names(t.favorites.select("user_id", "product_id"), t.products, t.users)


def holidays_between(first, last):
    """Month-day holidays repeated over a span of years."""
    return [f"{y}-{md}" for y in range(first, last + 1) for md in ("01-01", "11-11", "11-25", "12-25", "12-27")]


_HOLS = ", ".join(f"DATE '{d}'" for d in holidays_between(1995, 2002))


@query("jn12_near_holiday", "ord", f"""SELECT date, CAST(EXISTS (SELECT 1 FROM (SELECT unnest([{_HOLS}]) AS h) WHERE abs(date_diff('day', h, date)) <= 7)
    AS INTEGER) AS has_holiday FROM (SELECT DISTINCT created_at AS date FROM ord)""")
def _(t):
    return D.near_holiday(t.orders.select(F.col("created_at").alias("date")).distinct(), holidays_between(1995, 2002))


@query("jn14_cart_lines", "carts prod", """SELECT user_id, product_id, quantity, price, stock, is_active, price * quantity AS subtotal
    FROM carts JOIN prod USING (product_id)""")
def _(t):
    return D.cart_lines(Q.merge_carts(t.cart_adds), t.products)


# ---------------------------------------------------------------- aggregates

_DASH = """SELECT (SELECT count(*) FROM usr) AS total_users, (SELECT count(*) FROM prod WHERE is_active) AS total_products,
    count(*) AS total_orders, CAST(sum(total_cents) FILTER (WHERE status IN ('paid','shipped','delivered')) AS BIGINT) AS total_revenue,
    count(*) FILTER (WHERE status <> 'cancelled') AS paid_orders, (SELECT count(*) FROM churn WHERE is_churn_risk) AS churn_risk_count,
    (SELECT CAST(floor(metric_value) AS BIGINT) FROM metrics WHERE model_name = 'Clustering' AND metric_name = 'K') AS clustering_k,
    (SELECT metric_value FROM metrics WHERE model_name = 'Churn' AND metric_name = 'test_auc') AS churn_auc,
    (SELECT metric_value FROM metrics WHERE model_name = 'SalesForecast' AND metric_name = 'best_smape') AS forecast_smape,
    (SELECT CAST(floor(metric_value) AS BIGINT) FROM metrics WHERE model_name = 'Association' AND metric_name = 'global_rules_count') AS association_rules_count
    FROM ord"""


def _dash(t):
    return K.dashboard(t.users, t.products, t.orders, t.churn, t.metrics)


@query("ag1_dashboard", "usr prod ord churn metrics", _DASH)
def _(t):
    return _dash(t)


@query("ag1_dashboard_segments", "usr prod ord churn metrics rfm", f"""SELECT total_users, total_orders, paid_orders,
    (SELECT string_agg(segment || '=' || n, ';' ORDER BY segment) FROM (SELECT segment, count(*) AS n FROM rfm GROUP BY 1)) AS segments FROM ({_DASH})""")
def _(t):
    d = K.dashboard(t.users, t.products, t.orders, t.churn, t.metrics, t.rfm)
    text = F.array_join(F.transform("rfm_segments", lambda s: F.concat(s["segment"], F.lit("="), s["count"].cast("string"))), ";")
    return d.select("total_users", "total_orders", "paid_orders", text.alias("segments"))


@query("ag2_gauges", "usr prod ord churn metrics", f"""SELECT least(round(100.0::DOUBLE * paid_orders / total_orders, 1), 100.0) AS paid_rate,
    least(round(100.0::DOUBLE * churn_risk_count / total_users, 1), 100.0) AS churn_rate,
    round(total_revenue / 100.0::DOUBLE / total_users, 2) AS revenue_per_user FROM ({_DASH})""")
def _(t):
    return K.gauges(_dash(t))


@query("ag3_sales_trend", "paid", "SELECT created_at AS date, CAST(sum(total_cents) AS BIGINT) AS amount, count(*) AS count FROM paid GROUP BY 1")
def _(t):
    return K.sales_trend(t.orders)


@query("ag4_monthly_sales", "paid", "SELECT strftime(created_at, '%Y-%m') AS month, CAST(sum(total_cents) AS BIGINT) AS amount, count(*) AS count FROM paid GROUP BY 1")
def _(t):
    return K.monthly_sales(t.orders)


@query("ag5_predictions_by_month", "paid", """WITH p AS (SELECT created_at AS d, sum(total_cents) / 100.0::DOUBLE AS a FROM paid GROUP BY 1)
    SELECT strftime(d, '%Y-%m') AS month, round(sum(a), 4) AS pred_amount, round(sum(CASE WHEN day(d) % 5 = 0 THEN 0 ELSE a * 1.5 END), 4) AS pred_upper,
    round(sum(a * 0.5), 4) AS pred_lower FROM p GROUP BY 1""")
def _(t):
    p = K.sales_trend(t.orders).select(
        F.col("date").alias("pred_date"), (F.col("amount") / 100).alias("pred_amount"),
        F.when(F.day("date") % 5 != 0, F.col("amount") / 100 * 1.5).alias("pred_upper"), (F.col("amount") / 100 * 0.5).alias("pred_lower"))
    m = K.predictions_by_month(p)
    return m.select("month", *[F.round(c, 4).alias(c) for c in m.columns[1:]])


@query("ag6_sales_heatmap", "paid", """WITH m AS (SELECT DISTINCT strftime(created_at, '%Y-%m') AS month FROM paid ORDER BY 1 DESC LIMIT 6),
    g AS (SELECT month, CAST(dense_rank() OVER (ORDER BY month) - 1 AS INTEGER) AS month_index, CAST(d AS INTEGER) AS dow FROM m, range(7) r(d)),
    s AS (SELECT strftime(created_at, '%Y-%m') AS month, dayofweek(created_at) AS dow, sum(total_cents) AS c FROM paid GROUP BY 1, 2)
    SELECT g.month, month_index, g.dow, list_extract(['周日', '周一', '周二', '周三', '周四', '周五', '周六'], g.dow + 1) AS day_name,
    round(coalesce(c, 0) / 100.0::DOUBLE, 0) AS amount FROM g LEFT JOIN s ON g.month = s.month AND g.dow = s.dow""")
def _(t):
    return K.sales_heatmap(t.orders)


@query("ag7_user_trend", "paid", """SELECT user_id, strftime(created_at, '%Y-%m') AS month, CAST(sum(total_cents) AS BIGINT) AS amount, count(*) AS count
    FROM paid GROUP BY 1, 2""")
def _(t):
    return K.monthly_sales(t.orders, by=["user_id"])


@query("ag8_category_preference", "ord items prod", f"""SELECT *, round(100.0::DOUBLE * amount / sum(amount) OVER (PARTITION BY user_id), 1) AS percent
    FROM ({_PREF})""")
def _(t):
    return K.category_preference(t.orders, t.items, t.products)


@query("ag9_rfm_summary", "rfm", """SELECT segment, count(*) AS count, round(avg(recency), 1) AS avg_recency, round(avg(frequency), 1) AS avg_frequency,
    round(CAST(sum(monetary) AS DOUBLE) / count(*), 1) AS avg_monetary FROM rfm GROUP BY 1""")
def _(t):
    return K.rfm_summary(t.rfm)


@query("ag10_segment_distribution", "rfm", """SELECT segment, count(*) AS value, round(100.0::DOUBLE * count(*) / (SELECT count(*) FROM rfm), 1) AS percent,
    (SELECT round(avg(r_score), 2) FROM rfm) AS avg_r_score, (SELECT round(avg(f_score), 2) FROM rfm) AS avg_f_score,
    (SELECT round(avg(m_score), 2) FROM rfm) AS avg_m_score FROM rfm GROUP BY 1""")
def _(t):
    return K.segment_distribution(t.rfm)


@query("ag11_churn_summary", "churn", """SELECT count(*) FILTER (WHERE churn_prob >= 0.85) AS high, count(*) FILTER (WHERE churn_prob >= 0.5 AND churn_prob < 0.85)
    AS medium, count(*) FILTER (WHERE churn_prob < 0.5) AS low, count(*) FILTER (WHERE status = 'resolved') AS resolved,
    count(*) FILTER (WHERE is_churn_risk) AS total_risk FROM churn""")
def _(t):
    return K.churn_summary(t.churn)


@query("ag12_churn_histogram", "churn", """WITH b AS (SELECT least(CAST(floor(churn_prob * 5) AS INTEGER), 4) AS i, count(*) AS n FROM churn GROUP BY 1)
    SELECT list_extract(['0-20%', '20-40%', '40-60%', '60-80%', '80-100%'], CAST(k AS INTEGER) + 1) AS bucket, coalesce(n, 0) AS count,
    round(100.0::DOUBLE * coalesce(n, 0) / (SELECT count(*) FROM churn), 1) AS rate FROM range(5) r(k) LEFT JOIN b ON i = k""")
def _(t):
    return K.churn_histogram(t.churn)


@query("ag13_category_counts", "prod", "SELECT category_name, count(*) AS count FROM prod WHERE is_active GROUP BY 1")
def _(t):
    return K.category_counts(t.products)


@query("ag14_category_share", "", "SELECT p_brand AS category_name, count(*) AS count FROM part GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 8")
def _(t):
    return K.category_share(t.products.select(F.col("brand").alias("category_name")))


@query("ag15_ratings", "prod reviews", """SELECT product_id, coalesce(round(avg(rating), 1), 0.0) AS average, count(rating) AS count
    FROM prod LEFT JOIN reviews USING (product_id) GROUP BY 1""")
def _(t):
    return K.ratings(t.products, t.reviews)


@query("ag16_cart_totals", "carts prod", """SELECT user_id, count(*) AS lines, CAST(sum(quantity) AS BIGINT) AS units,
    CAST(sum(price * quantity) AS BIGINT) AS total_cents FROM carts JOIN prod USING (product_id) GROUP BY 1""")
def _(t):
    return K.cart_totals(Q.merge_carts(t.cart_adds), t.products)


@query("ag17_metrics_by_model", "metrics", """SELECT model_name, array_to_string(list_sort(list(metric_name || '=' || detail)), ';') AS metrics, count(*) AS n
    FROM metrics GROUP BY 1""")
def _(t):
    g = K.metrics_by_model(t.metrics)
    items = F.transform(F.map_entries("metrics"), lambda e: F.concat(e["key"], F.lit("="), e["value"]["detail"]))
    return g.select("model_name", F.array_join(F.array_sort(items), ";").alias("metrics"), "n")


@query("ag18_last_compute", "metrics", "SELECT epoch_us(max(created_at)) AS last_us FROM metrics")
def _(t):
    return K.last_compute_time(t.metrics).select(F.unix_micros("last_compute").alias("last_us"))


@query("ag19_churn_importance", "metrics churn", """SELECT replace(metric_name, 'feature_importance_', '') AS feature, CAST(floor(metric_value) AS BIGINT) AS count,
    (SELECT count(*) FROM churn WHERE is_churn_risk) AS total_risk, (SELECT count(*) FROM churn) AS total_all FROM metrics
    WHERE model_name = 'Churn' AND starts_with(metric_name, 'feature_importance_')""")
def _(t):
    return K.churn_importance(t.metrics, t.churn)


@query("ag20_order_headers", "tx", """SELECT invoice_no, min(customer_id) AS customer_id, CAST(min(invoice_date) AS DATE) AS order_date,
    CAST(sum(line_cents) AS BIGINT) AS total_cents, count(*) AS n_lines FROM tx GROUP BY 1""")
def _(t):
    return D.order_headers(t.lines("invoice_no", "customer_id", "invoice_date", "line_cents"))


@query("ag21_product_dimension", "sales", f"""SELECT stock_code, min(description) AS description, '{S.CATEGORY_NAME_DEFAULT}' AS category_name,
    min(description) AS short_name, round(quantile_cont(unit_price, 0.5), 10) AS median_price FROM sales GROUP BY 1""")
def _(t):
    d = D.product_dimension(t.sales("stock_code", "description", "unit_price"))
    return d.withColumn("median_price", F.round("median_price", 10))


@query("ag22_user_dimension", "tx", """SELECT customer_id, min(country) AS country, 'customer_' || customer_id || '@customers.example' AS email FROM tx GROUP BY 1""")
def _(t):
    return D.user_dimension(t.lines("customer_id", "country")).select("customer_id", "country", "email")


@query("ag34_conditional_ratios", "", """SELECT user_id, round(avg(CASE WHEN isodow(ts) >= 6 THEN 1.0::DOUBLE ELSE 0 END), 6) AS weekend_ratio,
    round(avg(CASE WHEN hour(ts) >= 22 OR hour(ts) <= 5 THEN 1.0::DOUBLE ELSE 0 END), 6) AS night_ratio,
    round(avg(CASE WHEN hour(ts) BETWEEN 9 AND 17 THEN 1.0::DOUBLE ELSE 0 END), 6) AS office_ratio FROM events GROUP BY 1""")
def _(t):
    h = F.hour("ts")

    def share(c):
        return F.round(F.avg(F.when(c, 1.0).otherwise(0.0)), 6)
    return t.raw("events").groupBy("user_id").agg(
        share(F.weekday("ts") >= 5).alias("weekend_ratio"), share((h >= 22) | (h <= 5)).alias("night_ratio"),
        share(h.between(9, 17)).alias("office_ratio"))


@query("ag35_group_quantiles", "sales", """SELECT customer_id, round(quantile_cont(unit_price, 0.25), 10) AS p25, round(quantile_cont(unit_price, 0.75), 10) AS p75,
    round(stddev_samp(unit_price) / greatest(avg(unit_price), 0.01), 6) AS cv FROM sales GROUP BY 1""")
def _(t):
    s = t.sales("customer_id", "unit_price")
    q = exact_quantiles(s, "unit_price", [0.25, 0.75], keys=["customer_id"])
    cv = s.groupBy("customer_id").agg(F.round(F.stddev_samp("unit_price") / F.greatest(F.avg("unit_price"), F.lit(0.01)), 6).alias("cv"))
    return q.join(cv, "customer_id").select("customer_id", F.round(F.get("q", F.lit(0)), 10).alias("p25"),
                                            F.round(F.get("q", F.lit(1)), 10).alias("p75"), "cv")


# ---------------------------------------------------------------- sorts, paging, top-k


@query("lm1_sort_products", "prod", "SELECT product_id, price FROM prod WHERE is_active ORDER BY price DESC, product_id LIMIT 50")
def _(t):
    df, order = C.sort_products(C.filter_products(t.products), by="price", order="desc")
    return C.page_of(df, order, 1, 50).select("product_id", "price")


@query("lm2_paging", "prod", """SELECT product_id, (SELECT count(*) FROM prod WHERE is_active) AS total,
    CAST(ceil((SELECT count(*) FROM prod WHERE is_active) / 25.0) AS BIGINT) AS pages
    FROM prod WHERE is_active ORDER BY created_at DESC, product_id LIMIT 25 OFFSET 50""")
def _(t):
    df, order = C.sort_products(C.filter_products(t.products))
    return C.with_page_counts(C.page_of(df, order, 3, 25).select("product_id"), df, 25)


@query("lm4_hot_products", "prod", "SELECT product_id FROM prod WHERE is_active AND category_name = 'PROMO' ORDER BY created_at DESC, product_id LIMIT 6")
def _(t):
    return C.hot_products(t.products, "PROMO").select("product_id")


@query("lm4_hot_by_sales", "prod items", """SELECT product_id, CAST(sum(quantity) AS BIGINT) AS sold FROM prod JOIN items USING (product_id) WHERE is_active
    GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 6""")
def _(t):
    return C.hot_by_sales(t.products, t.items).select("product_id", "sold")


@query("lm5_top_per_group", "ord items prod", f"""SELECT user_id, category, amount, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER
    (PARTITION BY user_id ORDER BY amount DESC, category) AS rank FROM ({_PREF})) WHERE rank <= 3""")
def _(t):
    p = K.category_preference(t.orders, t.items, t.products).drop("percent", "count")
    return C.top_per_group(p, ["user_id"], [F.desc("amount"), F.asc("category")], 3)


@query("lm6_latest_first", "log", "SELECT order_id, to_status, created_at FROM log ORDER BY created_at DESC, order_id DESC, seq DESC LIMIT 100")
def _(t):
    return C.page_of(t.status_log, [F.desc("created_at"), F.desc("order_id"), F.desc("seq")], 1, 100).select(
        "order_id", "to_status", "created_at")


@query("lm7_seeded_sample")
def _(t):
    return C.seeded_sample(t.orders, "order_id", 1500)


# ---------------------------------------------------------------- set operations


@query("so2_distinct_pairs", "tx", """SELECT 'product' AS kind, count(*) AS n FROM (SELECT DISTINCT stock_code, description FROM tx) UNION ALL
    SELECT 'customer', count(*) FROM (SELECT DISTINCT customer_id, country FROM tx)""")
def _(t):
    a = t.line_products().select(F.lit("product").alias("kind"))
    b = t.line_customers().select(F.lit("customer").alias("kind"))
    return a.unionByName(b).groupBy("kind").agg(F.count("*").alias("n"))


@query("so3_lost_customers", "sales", "SELECT customer_id FROM tr EXCEPT SELECT customer_id FROM lb", _SPLIT)
def _(t):
    a, b = _split(t)
    return a.select("customer_id").distinct().join(b.select("customer_id").distinct(), "customer_id", "left_anti")


@query("so4_retained_customers", "sales", "SELECT customer_id FROM tr INTERSECT SELECT customer_id FROM lb", _SPLIT)
def _(t):
    a, b = _split(t)
    return a.select("customer_id").distinct().join(b.select("customer_id").distinct(), "customer_id", "left_semi")


@query("so5_distinct_times", "sales", "SELECT customer_id, count(DISTINCT invoice_date) AS n FROM sales GROUP BY 1")
def _(t):
    return t.sales("customer_id", "invoice_date").dropDuplicates().groupBy("customer_id").agg(F.count("*").alias("n"))


@query("so6_one_per_pair", "cart_adds reviews", """SELECT c.user_id, c.product_id, CAST(sum(c.quantity) AS BIGINT) AS quantity, max(c.created_at) AS last_added,
    arg_max(c.quantity, c.created_at * 1 + c.quantity) AS last_quantity FROM (SELECT user_id, product_id, quantity,
    date_diff('day', DATE '1990-01-01', created_at) * 1000 AS created_at FROM cart_adds) c GROUP BY 1, 2""".replace(
    "max(c.created_at) AS last_added", "DATE '1990-01-01' + CAST(max(c.created_at) / 1000 AS INTEGER) AS last_added"))
def _(t):
    return Q.merge_carts(t.cart_adds, keep_last=True)


# ---------------------------------------------------------------- RFM


@query("rf1_profile_scores", "sales", """WITH d AS (SELECT max(CAST(invoice_date AS DATE)) AS today FROM sales), p AS (SELECT customer_id,
    CAST(min(today) - max(CAST(invoice_date AS DATE)) AS INTEGER) AS recency, count(DISTINCT invoice_no) AS frequency, CAST(sum(line_cents) AS BIGINT) AS cents
    FROM sales, d GROUP BY 1)
    SELECT customer_id, recency, frequency, CAST(CASE WHEN recency <= 30 THEN 5 WHEN recency <= 90 THEN 4 WHEN recency <= 180 THEN 3 WHEN recency <= 365 THEN 2 ELSE 1 END AS INTEGER) AS r_score,
    CASE WHEN frequency >= 20 THEN 5 WHEN frequency >= 10 THEN 4 WHEN frequency >= 5 THEN 3 WHEN frequency >= 2 THEN 2 ELSE 1 END AS f_score,
    CASE WHEN cents >= 500000 THEN 5 WHEN cents >= 200000 THEN 4 WHEN cents >= 50000 THEN 3 WHEN cents >= 10000 THEN 2 ELSE 1 END AS m_score FROM p""")
def _(t):
    return _profile_rfm(t).select("customer_id", "recency", "frequency", "r_score", "f_score", "m_score")


def _profile_rfm(t):
    s = t.sales("customer_id", "invoice_no", "invoice_date", "line_cents")
    today = s.agg(F.max(F.to_date("invoice_date"))).scalar()
    p = s.groupBy("customer_id").agg(
        F.max(F.to_date("invoice_date")).alias("_l"), F.countDistinct("invoice_no").alias("total_orders"),
        (F.sum("line_cents") / 100).alias("total_spent")).withColumn("recency_days", F.datediff(today, "_l"))
    return R.rfm_from_profile(p)


@query("rf2_rfm_scores", "rfm", "SELECT user_id, recency, frequency, monetary, r_score, f_score, m_score FROM rfm")
def _(t):
    return t.rfm.drop("rfm_score", "segment")


@query("rf3_segments", "rfm", "SELECT user_id, segment FROM rfm")
def _(t):
    return t.rfm.select("user_id", "segment")


@query("rf4_profile_segments", "rfm", """SELECT CASE WHEN r_score <= 2 THEN '流失预警' WHEN f_score >= 4 AND m_score >= 4 THEN '高价值'
    WHEN r_score >= 4 AND f_score >= 3 THEN '忠诚' WHEN r_score >= 3 AND f_score >= 2 THEN '潜力' ELSE '一般' END AS segment, count(*) AS n
    FROM rfm GROUP BY 1""")
def _(t):
    return t.rfm.groupBy(R.profile_segment_of(F.col("r_score"), F.col("f_score"), F.col("m_score")).alias("segment")).agg(
        F.count("*").alias("n"))


@query("rf5_replace_rfm", "rfm", "SELECT user_id, rfm_score, segment FROM rfm")
def _(t):
    stale = t.rfm.where("user_id % 2 = 0").withColumns({"rfm_score": F.lit(0), "v": F.lit(0)})
    both = stale.unionByName(t.rfm.withColumn("v", F.lit(1)))
    return sinks.upsert_latest(both, ["user_id"], ["v"]).select("user_id", "rfm_score", "segment")


@query("rf6_rename_segments", "rfm", """SELECT CASE segment WHEN '高价值客户' THEN '高价值客户' WHEN '潜力客户' THEN '忠诚客户' WHEN '一般客户' THEN '活跃客户'
    ELSE segment END AS segment, count(*) AS n FROM rfm GROUP BY 1""")
def _(t):
    before = {S.SEG_HIGH: "高价值忠诚客户", S.SEG_POTENTIAL: "Champions", S.SEG_GENERAL: "一般活跃客户"}
    named = t.rfm.select(F.coalesce(X.lookup("segment", before), F.col("segment")).alias("segment"))
    return R.rename_segments(named).groupBy("segment").agg(F.count("*").alias("n"))
