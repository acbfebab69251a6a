"""The retail views every operator starts from, over the given tables.

Views are lazy and narrow: ``lines`` joins part, customer and nation only when a
requested column comes from them, so no query pays for a join it does not read.
"""

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import even_parts

CUT_DATE = "2001-01-31"
DRIFT_DATE = "1998-07-01"
PART_COLS = {"description", "brand", "category"}

# What the test tables lack is derived with integer arithmetic; each fragment is
# the SQL twin of the Spark view of the same name.
CTES = {
    "ord": """SELECT o_orderkey AS order_id, o_custkey AS user_id, CAST(round(o_totalprice * 100) AS BIGINT) AS total_cents,
        CASE o_orderstatus WHEN 'F' THEN 'delivered' WHEN 'P' THEN 'paid' ELSE 'pending' END AS status,
        CAST(o_orderdate AS DATE) AS created_at FROM orders""",
    "paid": "SELECT * FROM ord WHERE status IN ('paid', 'shipped', 'delivered')",
    "cal": "SELECT CAST(max(o_orderdate) AS DATE) + 1 AS as_of FROM orders",
    "tx": """SELECT l_orderkey AS invoice_no, l_partkey AS stock_code, p_name AS description, p_brand AS brand, p_type AS category,
        l_quantity AS quantity, l_extendedprice / l_quantity AS unit_price, l_extendedprice AS line_total,
        CAST(round(l_extendedprice * 100) AS BIGINT) AS line_cents, o_orderdate AS invoice_date, o_custkey AS customer_id,
        n_name AS country, l_returnflag = 'R' AS cancelled
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey
        JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey""",
    "sales": "SELECT * FROM tx WHERE NOT cancelled AND quantity > 0 AND unit_price > 0",
    "prod": """SELECT p_partkey AS product_id, p_name AS name, p_brand AS brand, p_type AS category_name,
        CAST(round(p_retailprice * 100) AS BIGINT) AS price, 50 + p_size AS stock, p_size % 10 <> 0 AS is_active,
        DATE '2000-01-01' + CAST(p_partkey % 365 AS INTEGER) AS created_at FROM part""",
    "items": """SELECT l_orderkey AS order_id, l_partkey AS product_id, CAST(l_quantity AS BIGINT) AS quantity,
        CAST(round(l_extendedprice * 100) AS BIGINT) AS line_cents FROM lineitem""",
    "usr": """SELECT c_custkey AS user_id, c_name AS name, 'customer_' || c_custkey || '@customers.example' AS email,
        c_nationkey AS nation_key, CAST(round(c_acctbal * 100) AS BIGINT) AS balance FROM customer""",
    "reviews": """SELECT DISTINCT o_custkey AS user_id, l_partkey AS product_id, 1 + (o_custkey * 7 + l_partkey * 3) % 5 AS rating
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "cart_adds": """SELECT o_custkey AS user_id, l_partkey AS product_id, CAST(l_quantity AS BIGINT) AS quantity,
        CAST(o_orderdate AS DATE) AS created_at
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus = 'O'""",
    "carts": "SELECT user_id, product_id, CAST(sum(quantity) AS BIGINT) AS quantity FROM cart_adds GROUP BY 1, 2",
    "favs": """SELECT o_custkey AS user_id, l_partkey AS product_id, CAST(min(o_orderdate) AS DATE) AS created_at
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_quantity >= 40 GROUP BY 1, 2""",
    "ship": "SELECT l_orderkey AS order_id, CAST(min(l_shipdate) AS DATE) AS shipped_on FROM lineitem GROUP BY 1",
    "log": """SELECT order_id, CAST(NULL AS VARCHAR) AS from_status, 'pending' AS to_status, created_at, 0 AS seq FROM ord
        UNION ALL SELECT order_id, 'pending', 'paid', created_at + 1, 1 FROM ord WHERE status IN ('paid', 'delivered')
        UNION ALL SELECT order_id, 'paid', 'shipped', shipped_on, 2 FROM ord JOIN ship USING (order_id) WHERE status = 'delivered'
        UNION ALL SELECT order_id, 'shipped', 'delivered', shipped_on + 3, 3 FROM ord JOIN ship USING (order_id)
        WHERE status = 'delivered'""",
    "rfm0": """SELECT user_id, CAST(min(as_of) - max(created_at) AS INTEGER) AS recency, count(*) AS frequency,
        CAST(sum(total_cents) AS BIGINT) AS monetary FROM paid, cal GROUP BY user_id""",
    "rfm1": """SELECT *, CASE WHEN recency <= 30 THEN 5 WHEN recency <= 90 THEN 4 WHEN recency <= 180 THEN 3
        WHEN recency <= 365 THEN 2 ELSE 1 END AS r_score,
        CASE WHEN frequency >= 20 THEN 5 WHEN frequency >= 10 THEN 4 WHEN frequency >= 5 THEN 3 WHEN frequency >= 2 THEN 2
        ELSE 1 END AS f_score,
        CASE WHEN monetary >= 500000 THEN 5 WHEN monetary >= 200000 THEN 4 WHEN monetary >= 50000 THEN 3
        WHEN monetary >= 10000 THEN 2 ELSE 1 END AS m_score FROM rfm0""",
    "rfm": """SELECT *, r_score + f_score + m_score AS rfm_score, CASE WHEN r_score >= 4 AND f_score >= 4 AND m_score >= 4
        THEN '高价值客户' WHEN r_score >= 3 AND f_score >= 3 AND m_score >= 3 THEN '潜力客户'
        WHEN r_score <= 2 AND f_score <= 2 AND m_score <= 2 THEN '低价值客户' WHEN r_score <= 2 AND f_score >= 3
        THEN '流失预警' ELSE '一般客户' END AS segment FROM rfm1""",
    "churn": """SELECT user_id, least(1.0::DOUBLE, recency / 365.0::DOUBLE) AS churn_prob,
        least(1.0::DOUBLE, recency / 365.0::DOUBLE) >= 0.5 AS is_churn_risk,
        CASE user_id % 3 WHEN 0 THEN 'pending' WHEN 1 THEN 'contacted' ELSE 'resolved' END AS status,
        (SELECT as_of FROM cal) AS created_at FROM rfm""",
    "beh": """SELECT event_id, user_id, CASE event_type WHEN 'view' THEN 'view' WHEN 'click' THEN 'add_to_cart'
        ELSE 'purchase' END AS action, value, ts FROM events WHERE event_type IN ('view', 'click', 'purchase')""",
    "metric_log": """SELECT CASE event_type WHEN 'click' THEN 'Clustering' WHEN 'view' THEN 'Churn' WHEN 'purchase'
        THEN 'SalesForecast' WHEN 'signup' THEN 'Association' ELSE 'Prophet' END AS model_name,
        CASE event_type WHEN 'click' THEN list_extract(['K', 'silhouette_score', 'stability_ari', 'n_outliers'], event_id % 4 + 1)
        WHEN 'view' THEN list_extract(['test_auc', 'optimal_threshold', 'feature_importance_recency_days',
        'feature_importance_total_orders'], event_id % 4 + 1)
        WHEN 'purchase' THEN list_extract(['best_smape', 'best_mae', 'best_rmse', 'cv_smape_mean'], event_id % 4 + 1)
        WHEN 'signup' THEN list_extract(['global_rules_count', 'avg_lift', 'max_lift', 'avg_confidence'], event_id % 4 + 1)
        ELSE list_extract(['smape', 'mape', 'mae', 'rmse'], event_id % 4 + 1) END AS metric_name,
        value AS metric_value, props AS detail, ts AS created_at, event_id AS id FROM events""",
    "metrics": """SELECT model_name, metric_name, arg_max(metric_value, id) AS metric_value, arg_max(detail, id) AS detail,
        max(created_at) AS created_at, max(id) AS id FROM metric_log GROUP BY 1, 2""",
}
_NEEDS = {
    "paid": ["ord"], "sales": ["tx"], "carts": ["cart_adds"], "log": ["ord", "ship"], "rfm0": ["paid", "cal"],
    "rfm1": ["rfm0"], "rfm": ["rfm1"], "churn": ["rfm", "cal"], "metrics": ["metric_log"],
}


def with_ctes(names, body, extra=""):
    """Prefix ``body`` with the named fragments and what they build on."""
    order = []

    def visit(n):
        for m in _NEEDS.get(n, []):
            visit(m)
        if n not in order:
            order.append(n)

    for n in names.split():
        visit(n)
    parts = [f"{n} AS ({CTES[n]})" for n in order] + ([extra.strip().rstrip(",")] if extra.strip() else [])
    if not parts:
        return body
    own = body.lstrip()
    joint = ",\n" + own[5:] if own.startswith("WITH ") else "\n" + body
    return "WITH " + ",\n".join(parts) + joint


def cents(col):
    return F.bround(F.col(col) * 100, 0).cast("long")


class Tables:
    """Lazy canonical views over one folder of parquet tables."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def raw(self, name) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}.parquet")

    @cached_property
    def orders(self):
        return self.raw("orders").select(
            F.col("o_orderkey").alias("order_id"), F.col("o_custkey").alias("user_id"),
            cents("o_totalprice").alias("total_cents"),
            F.expr("CASE o_orderstatus WHEN 'F' THEN 'delivered' WHEN 'P' THEN 'paid' ELSE 'pending' END").alias("status"),
            F.to_date("o_orderdate").alias("created_at"))

    @cached_property
    def as_of(self):
        """One row: the day after the last order."""
        return self.raw("orders").agg(F.date_add(F.max(F.to_date("o_orderdate")), 1).alias("as_of"))

    def lines(self, *cols) -> DataFrame:
        """Invoice lines with the columns asked for, all lines included."""
        want = set(cols)
        li = self.raw("lineitem").select(
            F.col("l_orderkey").alias("invoice_no"), F.col("l_partkey").alias("stock_code"),
            F.col("l_quantity").alias("quantity"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("unit_price"),
            F.col("l_extendedprice").alias("line_total"), cents("l_extendedprice").alias("line_cents"),
            (F.col("l_returnflag") == "R").alias("cancelled"))
        if want & {"invoice_date", "customer_id", "country"}:
            o = self.raw("orders").select(
                F.col("o_orderkey").alias("invoice_no"), F.col("o_orderdate").cast("timestamp").alias("invoice_date"),
                F.col("o_custkey").alias("customer_id"))
            li = li.join(o, "invoice_no")
        if want & PART_COLS:
            p = self.raw("part").select(
                F.col("p_partkey").alias("stock_code"), F.col("p_name").alias("description"),
                F.col("p_brand").alias("brand"), F.col("p_type").alias("category"))
            li = li.join(p, "stock_code")
        if "country" in want:
            c = self.raw("customer").select(F.col("c_custkey").alias("customer_id"), "c_nationkey")
            n = self.raw("nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("country"))
            li = li.join(c.join(n, "c_nationkey"), "customer_id")
        return li.select(*cols)

    def line_products(self) -> DataFrame:
        """The distinct (stock_code, description) of the lines; the codes are made distinct before they meet their names."""
        p = self.raw("part").select(F.col("p_partkey").alias("stock_code"), F.col("p_name").alias("description"))
        return self.lines("stock_code").distinct().join(p, "stock_code").select("stock_code", "description").distinct()

    def line_customers(self) -> DataFrame:
        """The distinct (customer_id, country) of the lines: orders that have a line, in even parts, then their distinct customers."""
        n = even_parts(self.raw("lineitem"))
        o = self.raw("orders").select(F.col("o_orderkey").alias("invoice_no"), F.col("o_custkey").alias("customer_id"))
        li = self.lines("invoice_no").repartition(n, "invoice_no")
        buyers = o.repartition(n, "invoice_no").join(li, "invoice_no", "left_semi").select("customer_id").distinct()
        c = self.raw("customer").select(F.col("c_custkey").alias("customer_id"), "c_nationkey")
        k = self.raw("nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("country"))
        return buyers.join(c, "customer_id").join(k, "c_nationkey").select("customer_id", "country").distinct()

    def sales(self, *cols) -> DataFrame:
        """Cleaned lines: not cancelled, positive quantity and price."""
        need = list(dict.fromkeys([*cols, "cancelled", "quantity", "unit_price"]))
        return self.lines(*need).where("NOT cancelled AND quantity > 0 AND unit_price > 0").select(*cols)

    @cached_property
    def products(self):
        return self.raw("part").select(
            F.col("p_partkey").alias("product_id"), F.col("p_name").alias("name"), F.col("p_brand").alias("brand"),
            F.col("p_type").alias("category_name"), cents("p_retailprice").alias("price"),
            (F.col("p_size") + 50).alias("stock"), (F.col("p_size") % 10 != 0).alias("is_active"),
            F.expr("date_add(DATE'2000-01-01', CAST(p_partkey % 365 AS INT))").alias("created_at"))

    @cached_property
    def items(self):
        return self.raw("lineitem").select(
            F.col("l_orderkey").alias("order_id"), F.col("l_partkey").alias("product_id"),
            F.col("l_quantity").cast("long").alias("quantity"), cents("l_extendedprice").alias("line_cents"))

    @cached_property
    def users(self):
        return self.raw("customer").select(
            F.col("c_custkey").alias("user_id"), F.col("c_name").alias("name"),
            F.concat(F.lit("customer_"), F.col("c_custkey").cast("string"), F.lit("@customers.example")).alias("email"),
            F.col("c_nationkey").alias("nation_key"), cents("c_acctbal").alias("balance"))

    def _line_orders(self):
        return self.raw("lineitem").join(self.raw("orders"), F.col("l_orderkey") == F.col("o_orderkey"))

    @cached_property
    def reviews(self):
        return self._line_orders().select(
            F.col("o_custkey").alias("user_id"), F.col("l_partkey").alias("product_id"),
            F.expr("1 + (o_custkey * 7 + l_partkey * 3) % 5").alias("rating")).distinct()

    @cached_property
    def cart_adds(self):
        return self._line_orders().where("o_orderstatus = 'O'").select(
            F.col("o_custkey").alias("user_id"), F.col("l_partkey").alias("product_id"),
            F.col("l_quantity").cast("long").alias("quantity"), F.to_date("o_orderdate").alias("created_at"))

    @cached_property
    def favorites(self):
        return self._line_orders().where("l_quantity >= 40").groupBy(
            F.col("o_custkey").alias("user_id"), F.col("l_partkey").alias("product_id")).agg(
            F.to_date(F.min("o_orderdate")).alias("created_at"))

    @cached_property
    def status_log(self):
        o = self.orders
        ship = self.raw("lineitem").groupBy(F.col("l_orderkey").alias("order_id")).agg(
            F.to_date(F.min("l_shipdate")).alias("shipped_on"))
        done = o.where("status = 'delivered'").join(ship, "order_id")
        steps = [
            o.selectExpr("order_id", "CAST(NULL AS STRING) AS from_status", "'pending' AS to_status", "created_at", "0 AS seq"),
            o.where("status IN ('paid', 'delivered')").selectExpr(
                "order_id", "'pending' AS from_status", "'paid' AS to_status", "date_add(created_at, 1) AS created_at", "1 AS seq"),
            done.selectExpr("order_id", "'paid' AS from_status", "'shipped' AS to_status", "shipped_on AS created_at", "2 AS seq"),
            done.selectExpr("order_id", "'shipped' AS from_status", "'delivered' AS to_status",
                            "date_add(shipped_on, 3) AS created_at", "3 AS seq"),
        ]
        out = steps[0]
        for s in steps[1:]:
            out = out.unionByName(s)
        return out

    @cached_property
    def rfm(self):
        from ..operators.rfm import rfm_from_orders
        return rfm_from_orders(self.orders, self.as_of)

    @cached_property
    def churn(self):
        """Stand-in predictions: recency over a year as the score."""
        p = F.least(F.lit(1.0), F.col("recency") / F.lit(365.0))
        return self.rfm.select(
            "user_id", p.alias("churn_prob"), (p >= 0.5).alias("is_churn_risk"),
            F.expr("CASE user_id % 3 WHEN 0 THEN 'pending' WHEN 1 THEN 'contacted' ELSE 'resolved' END").alias("status"),
            self.as_of.scalar().alias("created_at"))

    @cached_property
    def behaviors(self):
        return self.raw("events").where("event_type IN ('view', 'click', 'purchase')").select(
            "event_id", "user_id",
            F.expr("CASE event_type WHEN 'view' THEN 'view' WHEN 'click' THEN 'add_to_cart' ELSE 'purchase' END").alias("action"),
            "value", F.col("ts").cast("timestamp").alias("ts"))

    @cached_property
    def metric_log(self):
        names = {
            "click": ("Clustering", ["K", "silhouette_score", "stability_ari", "n_outliers"]),
            "view": ("Churn", ["test_auc", "optimal_threshold", "feature_importance_recency_days",
                               "feature_importance_total_orders"]),
            "purchase": ("SalesForecast", ["best_smape", "best_mae", "best_rmse", "cv_smape_mean"]),
            "signup": ("Association", ["global_rules_count", "avg_lift", "max_lift", "avg_confidence"]),
        }
        model, metric = F.lit("Prophet"), F.array(*[F.lit(m) for m in ["smape", "mape", "mae", "rmse"]])
        for kind, (name, metrics) in names.items():
            is_kind = F.col("event_type") == kind
            model = F.when(is_kind, name).otherwise(model)
            metric = F.when(is_kind, F.array(*[F.lit(m) for m in metrics])).otherwise(metric)
        return self.raw("events").select(
            model.alias("model_name"), F.get(metric, (F.col("event_id") % 4).cast("int")).alias("metric_name"),
            F.col("value").alias("metric_value"), F.col("props").alias("detail"),
            F.col("ts").cast("timestamp").alias("created_at"), F.col("event_id").alias("id"))

    @cached_property
    def metrics(self):
        from .sinks import upsert_latest
        return upsert_latest(self.metric_log, ["model_name", "metric_name"], ["id"])
