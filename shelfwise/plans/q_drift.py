"""Drift queries (PS*, SK6, JN15)."""

from pyspark.sql import functions as F

from .. import schemas as S
from ..operators import baskets as B
from ..operators import dims as D
from ..operators import drift as DR
from ..operators import features as FT
from ..session import materialize, shared_dir
from ..sources import sinks
from ..sources.canonical import DRIFT_DATE
from .q_baskets import itemset_sql, rule_sql
from .q_features import LINE_COLS, PROF
from .registry import query

SIDES = {"x": f"invoice_date < DATE '{DRIFT_DATE}'", "y": f"invoice_date >= DATE '{DRIFT_DATE}'"}


def sides(t, *cols):
    """Lines before and after the drift date."""
    li = materialize(t.sales(*dict.fromkeys(["invoice_date", *cols])))
    at = F.lit(DRIFT_DATE).cast("timestamp")
    return li.where(F.col("invoice_date") < at), li.where(F.col("invoice_date") >= at)


def psi_sql(feature, base, cur, col=None):
    """PSI of one feature between two fragments, as a one-row select."""
    c = f"CAST({col or feature} AS DOUBLE)"
    qs = ", ".join(str(i / 10) for i in range(11))
    e = f"(SELECT list_sort(list_distinct(quantile_cont({c}, [{qs}]))) FROM {base})"

    def side(src):
        return f"""(SELECT greatest(least(len(list_filter(e, lambda z: z <= v)), len(e) - 1), 1) AS bin, count(*) AS n FROM (SELECT {c} AS v, {e} AS e FROM {src})
        WHERE v BETWEEN e[1] AND e[len(e)] GROUP BY 1)"""
    return f"""SELECT '{feature}' AS feature, coalesce(sum((p - q) * ln(p / q)), 0) AS psi FROM (SELECT
    least(greatest(coalesce(a.n, 0) / (SELECT sum(n) FROM {side(base)})::DOUBLE, 1e-6), 1) AS p,
    least(greatest(coalesce(b.n, 0) / (SELECT sum(n) FROM {side(cur)})::DOUBLE, 1e-6), 1) AS q
    FROM range(1, (SELECT len({e}))) r(k) LEFT JOIN {side(base)} a ON a.bin = k LEFT JOIN {side(cur)} b ON b.bin = k)"""


STATUS = "CASE WHEN {p} <= 0.1 THEN 'stable' WHEN {p} <= 0.25 THEN 'warning' ELSE 'drifted' END"


def report_sql(rows):
    return f"""SELECT feature, round(psi, 6) AS psi, {STATUS.format(p='psi')} AS status, round(avg(psi) OVER (), 6) AS model_psi,
    {STATUS.format(p='round(avg(psi) OVER (), 6)')} AS model_status FROM ({rows})"""


def flat(r):
    return r.select("feature", "psi", "status", "model_psi", "model_status")


@query("ps1_psi", "sales", f"SELECT feature, round(psi, 6) AS psi FROM ({psi_sql('quantity', 'x', 'y')} UNION ALL {psi_sql('unit_price', 'x', 'y')} UNION ALL {psi_sql('line_total', 'x', 'y')})",
       ", ".join(f"{k} AS (SELECT * FROM sales WHERE {w})" for k, w in SIDES.items()))
def _(t):
    a, b = sides(t, "quantity", "unit_price", "line_total")
    cols = ["quantity", "unit_price", "line_total"]
    return DR.psi_long(DR.unpivot(a, cols), DR.unpivot(b, cols)).select("feature", F.round("psi", 6).alias("psi"))


@query("ps3_status", "rfm", f"SELECT user_id, {STATUS.format(p='recency / 2400.0')} AS status FROM rfm")
def _(t):
    return t.rfm.select("user_id", DR.status_of(F.col("recency") / F.lit(2400.0)).alias("status"))


def _prof_sides():
    out = []
    for k, w in SIDES.items():
        p = PROF.replace("FROM sales", f"FROM sales WHERE {w}").replace("p0", f"p0{k}").replace("prof AS", f"prof{k} AS")
        out.append(p)
    return ", ".join(out)


_PS = _prof_sides()


def profiles(t):
    a, b = sides(t, *LINE_COLS)
    return materialize(FT.profile_features(a, S.CLUSTER_MONITOR)), materialize(FT.profile_features(b, S.CLUSTER_MONITOR))


_PS4 = " UNION ALL ".join(psi_sql(f, "profx", "profy") for f in S.CLUSTER_MONITOR)


def clustering_report(t):
    a, b = profiles(t)
    return DR.monitor_features("clustering", a, b, S.CLUSTER_MONITOR)


@query("ps4_clustering", "sales", report_sql(_PS4), _PS)
def _(t):
    return flat(clustering_report(t))


def churn_sides(t):
    """Churn features of each side at its own cut, with the recency stand-in as the score."""
    out = []
    for part, cut in zip(sides(t, *LINE_COLS), ("1998-06-30", "2001-08-01")):
        b = FT.churn_base(part, cut, S.CHURN_MONITOR).withColumn("product_diversity", F.col("unique_products") / F.col("total_orders"))
        out.append(materialize(b.select("customer_id", *S.CHURN_MONITOR, F.least(F.lit(1.0), F.col("recency_days") / 365).alias("churn_probability"))))
    return out


_CH = ", ".join(f"""ch{k} AS (SELECT *, CAST(DATE '{d}' - lp AS INTEGER) AS recency_days, DATE '{d}' - fp AS tenure_days, total_orders / greatest(lp - fp, 1)::DOUBLE * 30 AS order_frequency,
    unique_products / total_orders::DOUBLE AS product_diversity, total_spent / total_orders AS avg_spend_per_order, least(1.0::DOUBLE, (DATE '{d}' - lp) / 365.0::DOUBLE) AS churn_probability
    FROM p0{k})""" for k, d in (("x", "1998-07-01"), ("y", "2001-08-02")))
_PS5 = " UNION ALL ".join(psi_sql(f, "chx", "chy") for f in [*S.CHURN_MONITOR, "churn_probability"])


def churn_report(t):
    a, b = churn_sides(t)
    return DR.monitor_features("churn", a, b, [*S.CHURN_MONITOR, "churn_probability"])


@query("ps5_churn", "sales", report_sql(_PS5), _PS + ", " + _CH)
def _(t):
    return flat(churn_report(t))


_HALF = "m{k} AS (SELECT metric_name, arg_max(metric_value, id) AS v FROM metric_log WHERE model_name = 'SalesForecast' AND created_at {op} TIMESTAMP '2024-01-16' GROUP BY 1)"


def metric_sides(t):
    at = F.lit("2024-01-16").cast("timestamp")
    m = t.metric_log.where("model_name = 'SalesForecast'")
    return [sinks.upsert_latest(m.where(c), ["model_name", "metric_name"], ["id"]) for c in (F.col("created_at") < at, F.col("created_at") >= at)]


def forecast_report(t):
    a, b = metric_sides(t)
    return DR.metric_shift(a, b, ["best_smape", "best_mae", "best_rmse"], ["cv_smape_mean"])


@query("ps6_metric_shift", "metric_log", f"""SELECT metric_name AS feature, round(ma.v, 4) AS baseline, round(mb.v, 4) AS current, round(sg, 6) AS psi_signal, {STATUS.format(p='sg')} AS status FROM
    (SELECT metric_name, CASE WHEN metric_name = 'cv_smape_mean' THEN least(abs(mb.v - ma.v) * 5, 1) ELSE abs(ln((mb.v + 1e-6) / (ma.v + 1e-6))) END AS sg FROM ma JOIN mb USING (metric_name))
    JOIN ma USING (metric_name) JOIN mb USING (metric_name)""", _HALF.format(k="a", op="<") + ", " + _HALF.format(k="b", op=">="))
def _(t):
    return forecast_report(t)


_RD = ", ".join(itemset_sql("brand", w, 0.01, 2, k) + ", " + rule_sql(k) for k, w in SIDES.items())


def association_report(t):
    a, b = sides(t, "invoice_no", "brand")
    ra, rb = [materialize(B.rules_from(materialize(B.frequent_itemsets(materialize(B.baskets(B.basket_pairs(p, "brand"))), 0.01, 2)))) for p in (a, b)]
    return DR.rule_drift(ra, rb)


@query("ps7_rule_drift", "sales", report_sql(psi_sql("support_distribution", "xrules", "yrules", "support") + " UNION ALL " +
                                               psi_sql("lift_distribution", "xrules", "yrules", "lift")), _RD)
def _(t):
    return flat(association_report(t))


def all_reports(t):
    f = forecast_report(t).select("feature", F.col("psi_signal").alias("psi"))
    parts = [clustering_report(t), churn_report(t), DR.model_report("forecast", f), association_report(t)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return materialize(out)


_ST = "round(avg(psi), 6)"


@query("ps8_overall", "sales metric_log", f"""SELECT CASE WHEN len(d) > 0 THEN 'drifted' WHEN len(w) > 0 THEN 'warning' ELSE 'healthy' END AS overall_status,
    CASE WHEN len(d) + len(w) = 0 THEN 'All models are stable. No action required.' ELSE concat_ws(' ', CASE WHEN len(d) > 0 THEN (CASE WHEN len(d) > 1 THEN 'Models ' ELSE 'Model ' END) || array_to_string(d, ', ') ||
    (CASE WHEN len(d) > 1 THEN ' show' ELSE ' shows' END) || ' significant drift (PSI > 0.25). Consider retraining.' END, CASE WHEN len(w) > 0 THEN (CASE WHEN len(w) > 1 THEN 'Models ' ELSE 'Model ' END) ||
    array_to_string(w, ', ') || (CASE WHEN len(w) > 1 THEN ' are' ELSE ' is' END) || ' in warning range (0.1 < PSI ≤ 0.25). Investigate data changes.' END) END AS recommendation FROM (SELECT
    coalesce(list_sort(list(model) FILTER (WHERE st = 'drifted')), []) AS d, coalesce(list_sort(list(model) FILTER (WHERE st = 'warning')), []) AS w FROM (SELECT model, {STATUS.format(p='m')} AS st FROM (
    SELECT 'clustering' AS model, {_ST} AS m FROM ({_PS4}) UNION ALL SELECT 'churn', {_ST} FROM ({_PS5}) UNION ALL
    SELECT 'forecast', {_ST} FROM (SELECT CASE WHEN metric_name = 'cv_smape_mean' THEN least(abs(mb.v - ma.v) * 5, 1) ELSE abs(ln((mb.v + 1e-6) / (ma.v + 1e-6))) END AS psi FROM ma JOIN mb USING (metric_name))
    UNION ALL SELECT 'association', {_ST} FROM ({psi_sql('s', 'xrules', 'yrules', 'support')} UNION ALL {psi_sql('l', 'xrules', 'yrules', 'lift')}))))""",
       _PS + ", " + _CH + ", " + _HALF.format(k="a", op="<") + ", " + _HALF.format(k="b", op=">=") + ", " + _RD)
def _(t):
    return DR.overall(all_reports(t))


@query("sk6_drift_report")
def _(t):
    path = shared_dir(t.spark, "report")
    sinks.export_json(DR.drift_report(all_reports(t), "before", "after"), path)
    return t.spark.read.json(path).select("overall_status", "recommendation", F.size("models").alias("n_models"))


@query("jn15_align_features", "sales", " UNION ALL ".join(f"""SELECT '{f}' AS feature, count(profx.{f}) AS n_base, round(avg(profx.{f}), 6) AS mean_base,
    (SELECT count({f}) FROM profy) AS n_current, (SELECT round(avg({f}), 6) FROM profy) AS mean_current FROM profx""" for f in ("recency_days", "total_orders", "unique_products", "weekend_ratio")), _PS)
def _(t):
    a, b = profiles(t)
    d = D.align_features(a, b, ["recency_days", "total_orders", "unique_products", "weekend_ratio"])
    return d.select("feature", "n_base", F.round("mean_base", 6).alias("mean_base"), "n_current", F.round("mean_current", 6).alias("mean_current"))
