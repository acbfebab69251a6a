"""Order life cycle, scoring given scores, and row-callable equivalents (OL*, ML8, ML9, ML15, ML20, WN15, WN16, UD*)."""

from pyspark.sql import functions as F

from .. import schemas as S
from ..functions import scalars as X
from ..operators import lifecycle as O
from ..operators import quality as Q
from ..operators import scoring as SC
from ..session import even_parts, materialize
from .registry import query

_LEGAL = " OR ".join(f"(from_status = '{a}' AND to_status = '{b}')" for a, b in S.TRANSITIONS)
_BAD = "SELECT * REPLACE (CASE WHEN order_id % 97 = 0 AND seq = 1 THEN 'delivered' ELSE to_status END AS to_status) FROM log"


@query("ol1_transition_audit", "log", f"""SELECT order_id, seq, illegal, broken FROM (SELECT *, from_status IS NOT NULL AND NOT coalesce({_LEGAL}, FALSE) AS illegal,
    from_status IS DISTINCT FROM lag(to_status) OVER (PARTITION BY order_id ORDER BY created_at, seq) AS broken FROM bad) WHERE illegal OR broken""", f"bad AS ({_BAD})")
def _(t):
    bad = t.status_log.withColumn("to_status", F.when((F.col("order_id") % 97 == 0) & (F.col("seq") == 1), "delivered").otherwise(F.col("to_status")))
    return O.audit_transitions(bad).select("order_id", "seq", "illegal", "broken")


@query("ol2_current_status", "log", "SELECT order_id, arg_max(to_status, date_diff('day', DATE '1990-01-01', created_at) * 10 + seq) AS status, max(created_at) AS since FROM log GROUP BY 1")
def _(t):
    return O.current_status(t.status_log)


@query("ol2_time_in_status", "log", """SELECT status, count(*) AS n, CAST(sum(days) AS BIGINT) AS days FROM (SELECT to_status AS status,
    lead(created_at) OVER (PARTITION BY order_id ORDER BY created_at, seq) - created_at AS days FROM log) WHERE days IS NOT NULL GROUP BY 1""")
def _(t):
    return O.time_in_status(t.status_log).where("days IS NOT NULL").groupBy("status").agg(F.count("*").alias("n"), F.sum("days").alias("days"))


@query("ol3_price_carts", "carts prod", """SELECT user_id, bool_and(is_active) AS accepted, CAST(sum(price * quantity) AS BIGINT) AS total_cents
    FROM carts JOIN prod USING (product_id) GROUP BY 1""")
def _(t):
    return O.price_carts(Q.merge_carts(t.cart_adds), t.products)


_DEM = "dem AS (SELECT l_orderkey AS order_id, l_partkey AS product_id, CAST(sum(l_quantity) AS BIGINT) AS quantity, CAST(o_orderdate AS DATE) AS created_at FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL)"


def demand(t):
    n = even_parts(t.raw("lineitem"))
    li = t.raw("lineitem").select("l_orderkey", "l_partkey", "l_quantity").repartition(n, "l_orderkey")
    o = t.raw("orders").select("o_orderkey", "o_orderdate").repartition(n, "o_orderkey")
    return li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).groupBy(
        F.col("l_orderkey").alias("order_id"), F.col("l_partkey").alias("product_id"), F.to_date("o_orderdate").alias("created_at")).agg(
        F.sum("l_quantity").cast("long").alias("quantity"))


@query("ol4_oversell", "prod", """SELECT product_id, order_id, running, running <= stock AS fits FROM (SELECT *, CAST(sum(quantity) OVER (PARTITION BY product_id
    ORDER BY created_at, order_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS running FROM dem) JOIN prod USING (product_id)""", _DEM)
def _(t):
    return O.oversell_check(demand(t), t.products).select("product_id", "order_id", "running", "fits")


@query("ol5_stock_position", "prod", """SELECT product_id, CAST(max(stock) + coalesce(sum(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE -l_quantity END), 0) AS BIGINT) AS position
    FROM prod LEFT JOIN lineitem ON l_partkey = product_id GROUP BY 1""")
def _(t):
    m = t.raw("lineitem").select(F.col("l_partkey").alias("product_id"), F.col("l_quantity").cast("long").alias("quantity"),
                                 (F.col("l_returnflag") == "R").alias("restock"))
    return O.stock_position(t.products, m)


@query("ol6_balance_ledger", "usr ord", """SELECT user_id, ref, kind, balance, balance < 0 AS overdrawn, abs(amount) > 20000000 AS above_cap FROM (SELECT *, CAST(sum(amount) OVER
    (PARTITION BY user_id ORDER BY created_at, kind, ref ROWS UNBOUNDED PRECEDING) AS BIGINT) AS balance FROM (
    SELECT user_id, DATE '1990-01-01' AS created_at, 'a_opening' AS kind, 0::BIGINT AS ref, balance * 100 AS amount FROM usr UNION ALL
    SELECT user_id, created_at, CASE status WHEN 'pending' THEN 'recharge' ELSE 'payment' END, order_id, CASE status WHEN 'pending' THEN total_cents ELSE -total_cents END FROM ord))""")
def _(t):
    opening = t.users.select("user_id", F.lit("1990-01-01").cast("date").alias("created_at"), F.lit("a_opening").alias("kind"),
                             F.lit(0).cast("long").alias("ref"), (F.col("balance") * 100).alias("amount"))
    pend = F.col("status") == "pending"
    moves = t.orders.select("user_id", "created_at", F.when(pend, "recharge").otherwise("payment").alias("kind"), F.col("order_id").alias("ref"),
                            F.when(pend, F.col("total_cents")).otherwise(-F.col("total_cents")).alias("amount"))
    return O.balance_ledger(opening, moves, 20000000).select("user_id", "ref", "kind", "balance", "overdrawn", "above_cap")


@query("ol7_funnel", "beh", """SELECT user_id, count(*) FILTER (WHERE action = 'view') AS view, count(*) FILTER (WHERE action = 'add_to_cart') AS add_to_cart,
    count(*) FILTER (WHERE action = 'purchase') AS purchase FROM beh GROUP BY 1""")
def _(t):
    return O.funnel(t.behaviors)


# ---------------------------------------------------------------- given scores

SCO = """sc AS (SELECT user_id AS customer_id, least(1.0::DOUBLE, recency / 365.0::DOUBLE) AS score, CAST((user_id * 7 + recency) % 10 < 4 AS INTEGER) AS label FROM rfm)"""


def scores(t):
    """Recency stand-in scores with a label derived from ids."""
    return t.rfm.select(F.col("user_id").alias("customer_id"), F.least(F.lit(1.0), F.col("recency") / F.lit(365.0)).alias("score"),
                        F.when((F.col("user_id") * 7 + F.col("recency")) % 10 < 4, 1).otherwise(0).alias("label"))


_RK = SCO + """, cs AS (SELECT score, sum(label) AS pos, sum(1 - label) AS neg FROM sc GROUP BY 1),
    rk AS (SELECT *, sum(pos) OVER (ORDER BY score DESC) AS tp, sum(neg) OVER (ORDER BY score DESC) AS fp, (SELECT sum(label) FROM sc) AS np, (SELECT sum(1 - label) FROM sc) AS nn,
    row_number() OVER (ORDER BY score DESC) AS i, count(*) OVER () AS n FROM cs)"""


@query("ml8_metrics", "rfm", """SELECT round(1 - sum(pos * (fp - neg / 2.0::DOUBLE)) / (max(np) * max(nn))::DOUBLE, 6) AS auc, round(sum(pos * tp / (tp + fp)::DOUBLE) / sum(pos), 6) AS pr_auc,
    (SELECT round(avg(pow(score - label, 2)), 6) FROM sc) AS brier, (SELECT count(*) FROM sc WHERE score >= 0.5 AND label = 1) AS tp,
    (SELECT round(2 * count(*) FILTER (WHERE score >= 0.5 AND label = 1) / (2 * count(*) FILTER (WHERE score >= 0.5 AND label = 1) + count(*) FILTER (WHERE (score >= 0.5) <> (label = 1)))::DOUBLE, 6) FROM sc) AS f1,
    (SELECT round(1 - avg(pow(score - label, 2)) / (avg(label) * (1 - avg(label))), 6) FROM sc) AS brier_skill FROM rk""", _RK)
def _(t):
    s = materialize(scores(t))
    m = SC.binary_metrics(s).withColumns({"auc": SC.roc_auc(s).scalar(), "pr_auc": SC.average_precision(s).scalar()})
    return m.select(*[F.round(c, 6).alias(c) for c in ("auc", "pr_auc", "brier", "brier_skill", "f1")], "tp")


@query("ml8_class_report", "rfm", """WITH p AS (SELECT CAST(r_score AS INTEGER) AS y, CAST(f_score AS INTEGER) AS q FROM rfm), c AS (SELECT y AS class, count(*) AS support, count(*) FILTER (WHERE y = q) AS tp FROM p GROUP BY 1),
    d AS (SELECT q AS class, count(*) AS predicted FROM p GROUP BY 1) SELECT class, support, round(coalesce(tp / predicted::DOUBLE, 0), 6) AS precision, round(tp / support::DOUBLE, 6) AS recall,
    round(2 * tp / (support + coalesce(predicted, 0))::DOUBLE, 6) AS f1 FROM c LEFT JOIN d USING (class)""")
def _(t):
    r = SC.class_report(t.rfm, "r_score", "f_score")
    return r.select("class", "support", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


_TH = SCO + """, th AS (SELECT k / 100.0::DOUBLE AS threshold, count(*) FILTER (WHERE floor(score * 100 + 1e-9) >= k AND label = 1) AS tp, count(*) FILTER (WHERE floor(score * 100 + 1e-9) >= k AND label = 0) AS fp,
    count(*) FILTER (WHERE floor(score * 100 + 1e-9) < k AND label = 1) AS fn FROM sc, range(5, 95) r(k) GROUP BY k),
    tt AS (SELECT *, tp / (tp + fp)::DOUBLE AS precision, tp / (tp + fn)::DOUBLE AS recall, 2 * tp / (2 * tp + fp + fn)::DOUBLE AS f1 FROM th)"""


@query("ml9_threshold_sweep", "rfm", "SELECT threshold, tp, fp, fn, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM tt", _TH)
def _(t):
    x = SC.threshold_table(scores(t))
    return x.select("threshold", "tp", "fp", "fn", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


@query("ml9_best_thresholds", "rfm", """SELECT * FROM (SELECT 'f1' AS rule, threshold, round(f1, 6) AS value FROM tt ORDER BY round(f1, 12) DESC, threshold LIMIT 1) UNION ALL SELECT * FROM
    (SELECT 'business', threshold, round(precision, 6) FROM tt WHERE recall >= 0.6 ORDER BY round(precision, 12) DESC, threshold LIMIT 1) UNION ALL SELECT * FROM
    (SELECT 'recall', threshold, round(recall, 6) FROM tt WHERE precision >= 0.35 ORDER BY round(recall, 12) DESC, threshold LIMIT 1)""", _TH)
def _(t):
    b = SC.best_thresholds(materialize(SC.threshold_table(scores(t))), min_recall=0.6)
    return b.select("rule", "threshold", F.round("value", 6).alias("value"))


_CAMP = """cam AS (SELECT user_id, churn_prob, monetary / 100.0::DOUBLE AS clv, user_id % 3 AS win, churn_prob * ln(1 + monetary / 100.0::DOUBLE) * (1 + user_id % 3) AS p FROM churn JOIN rfm USING (user_id))"""


def campaign(t):
    d = t.churn.join(t.rfm.select("user_id", "monetary"), "user_id").select(
        "user_id", F.col("churn_prob").alias("churn_probability"), (F.col("monetary") / 100).alias("predicted_clv"), (F.col("user_id") % 3).alias("pw_label"))
    return SC.campaign_priority(d)


@query("ml15_campaign_top", "churn rfm", """SELECT user_id, round(10 * (p - (SELECT min(p) FROM cam)) / ((SELECT max(p) - min(p) FROM cam) + 1e-9), 6) AS priority_score FROM cam
    ORDER BY round(p, 9) DESC, user_id LIMIT 10""", _CAMP)
def _(t):
    c = campaign(t)
    return c.orderBy(F.desc(F.round("priority", 9)), "user_id").limit(10).select("user_id", F.round("priority_score", 6).alias("priority_score"))


@query("wn15_priority_score", "churn rfm", "SELECT user_id, round(10 * (p - min(p) OVER ()) / (max(p) OVER () - min(p) OVER () + 1e-9), 6) AS priority_score FROM cam", _CAMP)
def _(t):
    return campaign(t).select("user_id", F.round("priority_score", 6).alias("priority_score"))


@query("wn16_roc_curve", "rfm", """SELECT 0.0::DOUBLE AS fpr, 0.0::DOUBLE AS tpr UNION ALL SELECT round(fp / nn::DOUBLE, 6), round(tp / np::DOUBLE, 6) FROM rk WHERE n + 1 <= 50 OR i IN
    (SELECT CAST(floor(k * (SELECT max(n) FROM rk) / 49.0::DOUBLE) AS BIGINT) FROM range(50) r(k))""", _RK)
def _(t):
    return SC.roc_points(materialize(scores(t))).select(F.round("fpr", 6).alias("fpr"), F.round("tpr", 6).alias("tpr"))


@query("ml20_case_status", "churn", """WITH u AS (SELECT user_id, arg_max(event_type, event_id) AS s FROM (SELECT user_id, event_id, CASE event_type WHEN 'view' THEN 'contacted' WHEN 'purchase' THEN 'resolved' ELSE 'closed' END AS event_type
    FROM events) WHERE event_type IN ('pending', 'contacted', 'resolved') GROUP BY 1) SELECT user_id, coalesce(s, status) AS status FROM churn LEFT JOIN u USING (user_id)""")
def _(t):
    u = t.raw("events").select("user_id", F.expr("CASE event_type WHEN 'view' THEN 'contacted' WHEN 'purchase' THEN 'resolved' ELSE 'closed' END").alias("new_status"),
                               "ts", F.col("event_id").alias("seq"))
    return SC.overlay_status(t.churn, u).select("user_id", "status")


# ---------------------------------------------------------------- forms of the row callables


@query("ud1_aggregate_callables", "", """SELECT user_id, round(avg(hour(ts)), 6) AS hour_mean, round(coalesce(stddev_samp(hour(ts)), 0), 6) AS hour_std, round(quantile_cont(value, 0.25), 6) AS p25,
    round(stddev_samp(value) / greatest(avg(value), 0.01), 6) AS cv FROM events GROUP BY 1""")
def _(t):
    h = F.hour("ts")
    return t.raw("events").groupBy("user_id").agg(
        F.round(F.avg(h), 6).alias("hour_mean"), F.round(F.coalesce(F.stddev_samp(h), F.lit(0.0)), 6).alias("hour_std"),
        F.round(F.percentile("value", 0.25), 6).alias("p25"), F.round(F.stddev_samp("value") / F.greatest(F.avg("value"), F.lit(0.01)), 6).alias("cv"))


@query("ud2_scalar_callables", "rfm", "SELECT segment, r_score, count(*) AS n FROM rfm GROUP BY 1, 2")
def _(t):
    from ..operators.rfm import segment_of
    r = t.rfm.drop("segment").withColumn("segment", segment_of(F.col("r_score"), F.col("f_score"), F.col("m_score")))
    return r.groupBy("segment", "r_score").agg(F.count("*").alias("n"))


@query("ud3_group_loops", "ord", """SELECT user_id, count(*) AS visits, round((max(created_at) - min(created_at)) / greatest(count(*) - 1, 1)::DOUBLE, 6) AS mean_gap FROM (SELECT DISTINCT user_id, created_at FROM ord) GROUP BY 1""")
def _(t):
    from ..operators.features import purchase_gaps
    g = purchase_gaps(t.orders.select("user_id", F.col("created_at").cast("timestamp").alias("invoice_date")), "user_id")
    short = t.orders.groupBy("user_id").agg(F.datediff(F.max("created_at"), F.min("created_at")).alias("span"))
    gap = F.when(F.col("n_times") > 2, F.col("interval_mean")).otherwise(F.col("span") / F.greatest(F.col("n_times") - 1, F.lit(1)))
    return g.join(short, "user_id").select("user_id", F.col("n_times").alias("visits"), F.round(gap, 6).alias("mean_gap"))


@query("ud4_dictionary_rewrite", "", """WITH w AS (SELECT p_brand, CASE WHEN contains(p_name, 'red') OR contains(p_name, 'blue') THEN 1 ELSE 0 END AS hit FROM part)
    SELECT p_brand AS brand, count(*) AS n, CAST(sum(hit) AS BIGINT) AS colored FROM w GROUP BY 1""")
def _(t):
    p = X.normalize_names(t.raw("part").select("p_brand", "p_name"), "p_name", "o")
    return p.groupBy(F.col("p_brand").alias("brand")).agg(F.count("*").alias("n"), F.sum(F.when(F.col("o").rlike("红色|蓝色"), 1).otherwise(0)).alias("colored"))


@query("ud5_row_to_many", "ord", "SELECT order_id, CAST(k AS INTEGER) AS step, created_at + CAST(k AS INTEGER) * 7 AS due FROM ord, range(1, 4) r(k)")
def _(t):
    return t.orders.select("order_id", "created_at", F.explode(F.sequence(F.lit(1), F.lit(3))).alias("step")).select(
        "order_id", "step", F.date_add("created_at", F.col("step") * 7).alias("due"))
