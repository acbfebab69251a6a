"""Series windows and forecasting queries (WN*, TS*)."""

from functools import reduce

from pyspark.sql import functions as F

from ..operators import drift as DR
from ..operators import forecast as FC
from ..operators import smoothing as SM
from ..session import materialize
from .q_basics import _HOLS, CLUSTER_SQL, cluster_labels, holidays_between
from .registry import query

COLS = ("invoice_date", "invoice_no", "customer_id", "quantity", "line_cents")
BUCKET_SQL = {
    "daily": "CAST(invoice_date AS DATE)",
    "weekly": "CAST(date_trunc('week', invoice_date - INTERVAL 1 DAY) + INTERVAL 1 DAY AS DATE)",
    "monthly": "CAST(date_trunc('month', invoice_date) AS DATE)",
}


def series_sql(grain, name="s", key="", src="sales"):
    k = f"{key}, " if key else ""
    g = f"{key}, 2" if key else "1"
    return f"""{name} AS (SELECT {k}{BUCKET_SQL[grain]} AS date, CAST(sum(line_cents) AS BIGINT) / 100.0::DOUBLE AS revenue, sum(quantity) AS quantity,
    count(DISTINCT invoice_no) AS orders, count(DISTINCT customer_id) AS customers FROM {src} GROUP BY {g})"""


def series(t, grain, *keys):
    return materialize(FC.series(t.sales(*COLS, *keys), grain, keys))


def feat_sql(grain, src="s", name="f"):
    lags = ", ".join(f"lag(revenue, {k}) OVER (ORDER BY date) AS lag_{k}" for k in FC.LAGS[grain])
    return f"{name} AS (SELECT *, {lags}, row_number() OVER (ORDER BY date) - 1 AS i, count(*) OVER () AS n FROM {src})"


def held_sql(grain, share="0.8", last=None):
    """Featured series less its head, with row index, size of the training part and the split."""
    cut = f"n - {last}" if last else f"CAST(floor(n * {share}::DOUBLE) AS BIGINT)"
    return feat_sql(grain) + f""", g AS (SELECT *, row_number() OVER (ORDER BY date) - 1 AS j FROM f WHERE i >= {max(FC.LAGS[grain])}),
    h AS (SELECT * REPLACE ({cut} AS n), j >= {cut} AS is_test FROM (SELECT * REPLACE ((SELECT count(*) FROM g) AS n) FROM g))"""


def held(t, grain="weekly", **kw):
    return materialize(FC.holdout(FC.build_features(series(t, grain), grain), **kw))


@query("ag23_monthly_aggregate", "sales", "SELECT strftime(date, '%Y-%m') AS month, round(revenue, 2) AS revenue, orders, customers FROM s", series_sql("monthly"))
def _(t):
    s = FC.series(t.sales(*COLS), "monthly")
    return s.select(F.date_format("date", "yyyy-MM").alias("month"), F.round("revenue", 2).alias("revenue"), "orders", "customers")


@query("ag24_daily_weekly", "sales", "SELECT 'daily' AS grain, date, round(revenue, 2) AS revenue, orders, customers, quantity FROM d UNION ALL SELECT 'weekly', date, round(revenue, 2), orders, customers, quantity FROM w",
       series_sql("daily", "d") + ", " + series_sql("weekly", "w"))
def _(t):
    li = t.sales(*COLS)
    return reduce(lambda a, b: a.unionByName(b), [FC.series(li, g).select(
        F.lit(g).alias("grain"), "date", F.round("revenue", 2).alias("revenue"), "orders", "customers", "quantity") for g in ("daily", "weekly")])


@query("ts1_series", "sales", " UNION ALL ".join(f"SELECT '{g}' AS grain, count(*) AS n, CAST(round(sum(revenue) * 100) AS BIGINT) AS cents, CAST(sum(orders) AS BIGINT) AS orders FROM {g}" for g in FC.LAGS),
       ", ".join(series_sql(g, g) for g in FC.LAGS))
def _(t):
    li = t.sales(*COLS)
    return reduce(lambda a, b: a.unionByName(b), [FC.series(li, g).agg(
        F.lit(g).alias("grain"), F.count("*").alias("n"), F.round(F.sum("revenue") * 100).cast("long").alias("cents"), F.sum("orders").alias("orders")) for g in FC.LAGS])


@query("wn1_lags", "sales", "SELECT date, " + ", ".join(f"lag_{k}" for k in FC.LAGS["daily"]) + " FROM f", series_sql("daily") + ", " + feat_sql("daily"))
def _(t):
    return FC.lag_features(series(t, "daily"), "daily").select("date", *[f"lag_{k}" for k in FC.LAGS["daily"]])


def _roll_sql(n):
    w = f"OVER (ORDER BY date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return ", ".join(f"round(CASE WHEN count(*) {w} = {n} THEN {f}(revenue) {w} END, 6) AS roll_{k}_{n}"
                     for k, f in (("mean", "avg"), ("std", "stddev_samp"), ("max", "max"), ("min", "min")))


_ROLLS = [f"roll_{k}_{n}" for n in FC.WINDOWS["weekly"] for k in ("mean", "std", "max", "min")]


@query("wn2_rolling", "sales", "SELECT date, " + ", ".join(_roll_sql(n) for n in FC.WINDOWS["weekly"]) + " FROM s", series_sql("weekly"))
def _(t):
    return FC.rolling_features(series(t, "weekly"), "weekly").select("date", *[F.round(c, 6).alias(c) for c in _ROLLS])


@query("wn3_growth", "sales", "SELECT date, round(coalesce((revenue - lag(revenue) OVER (ORDER BY date)) / nullif(lag(revenue) OVER (ORDER BY date), 0), 0), 6) AS growth_1 FROM s", series_sql("daily"))
def _(t):
    return FC.growth(series(t, "daily")).select("date", F.round("growth_1", 6).alias("growth_1"))


@query("wn4_time_index", "sales", "SELECT date, CAST(row_number() OVER (ORDER BY date) - 1 AS INTEGER) AS time_idx FROM s", series_sql("daily"))
def _(t):
    return FC.time_index(series(t, "daily")).select("date", "time_idx")


@query("wn5_holdout", "sales", "SELECT date, CAST(j AS INTEGER) AS row_idx, CAST(n AS INTEGER) AS train_n, is_test FROM h", series_sql("weekly") + ", " + held_sql("weekly"))
def _(t):
    return held(t).select("date", "row_idx", "train_n", "is_test")


@query("ts2_feature_table", "sales", "SELECT date, year(date)::INTEGER AS year, month(date)::INTEGER AS month, quarter(date)::INTEGER AS quarter, week(date)::INTEGER AS week_of_year, CAST(i AS INTEGER) AS time_idx, "
       + ", ".join(f"lag_{k}" for k in FC.LAGS["weekly"]) + ", roll_mean_4, orders FROM h JOIN (SELECT date, " + _roll_sql(4) + " FROM s) USING (date)", series_sql("weekly") + ", " + held_sql("weekly"))
def _(t):
    f = FC.build_features(series(t, "weekly"), "weekly")
    return f.select("date", "year", "month", "quarter", "week_of_year", "time_idx", *[f"lag_{k}" for k in FC.LAGS["weekly"]],
                    F.round("roll_mean_4", 6).alias("roll_mean_4"), "orders")


@query("ts3_calendar", "sales", f"""SELECT date, CAST(least(greatest(date_diff('day', date, make_date(year(date), 12, 25)), -30), 365) AS INTEGER) AS days_to_christmas,
    CAST(month(date) >= 11 AS INTEGER) AS is_christmas_season, CAST(month(date) = 1 AS INTEGER) AS is_jan_sale,
    CAST(month(date) = 11 AND week(date) >= 47 AS INTEGER) AS is_black_friday_week, CAST(day(date) >= 25 AS INTEGER) AS is_month_end,
    CAST(week(date) BETWEEN 49 AND 52 AS INTEGER) AS is_xmas_peak, round(sin(2 * pi() * week(date) / 52), 6) AS woy_sin, round(cos(2 * pi() * month(date) / 12), 6) AS month_cos,
    CAST(EXISTS (SELECT 1 FROM (SELECT unnest([{_HOLS}]) AS h) WHERE abs(date_diff('day', h, date)) <= 7) AS INTEGER) AS has_holiday FROM s""", series_sql("weekly"))
def _(t):
    c = FC.calendar_features(series(t, "weekly"), holidays_between(1995, 2002))
    return c.select("date", "days_to_christmas", "is_christmas_season", "is_jan_sale", "is_black_friday_week", "is_month_end", "is_xmas_peak",
                    F.round("woy_sin", 6).alias("woy_sin"), F.round("month_cos", 6).alias("month_cos"), "has_holiday")


@query("ts4_decay_weights", "sales", """SELECT date, round(pow(0.97, n - 1 - j) / sum(pow(0.97, n - 1 - j)) OVER () * n, 6) AS weight FROM h WHERE NOT is_test""", series_sql("weekly") + ", " + held_sql("weekly"))
def _(t):
    return FC.decay_weights(held(t)).where("NOT is_test").select("date", F.round("weight", 6).alias("weight"))


NAIVE = """sn AS (SELECT a.date, a.revenue, b.revenue AS yhat FROM h a JOIN h b ON NOT b.is_test AND b.j = a.n - least(52, a.n) + (a.j - a.n) % least(52, a.n) WHERE a.is_test)"""
_W = series_sql("weekly") + ", " + held_sql("weekly")


@query("ts5_seasonal_naive", "sales", "SELECT date, revenue, yhat FROM sn", _W + ", " + NAIVE)
def _(t):
    return FC.seasonal_naive(held(t), "weekly").select("date", "revenue", "yhat")


HYB = """hx AS (SELECT *, date_diff('day', DATE '1970-01-01', date)::DOUBLE AS x FROM h), ft AS (SELECT regr_slope(revenue, x) AS b, regr_intercept(revenue, x) AS a FROM hx WHERE NOT is_test),
    rs AS (SELECT week(date) AS wk, greatest(revenue - (a + b * x), 0) AS r FROM hx, ft WHERE NOT is_test), bk AS (SELECT wk, avg(r) AS s FROM rs GROUP BY 1),
    hy AS (SELECT date, revenue, greatest(a + b * x + coalesce(s, (SELECT avg(r) FROM rs)), 0) AS yhat FROM hx JOIN ft ON TRUE LEFT JOIN bk ON wk = week(date) WHERE is_test)"""


@query("ts6_trend_seasonal", "sales", "SELECT date, revenue, round(yhat, 2) AS yhat FROM hy", _W + ", " + HYB)
def _(t):
    return FC.trend_seasonal(held(t), "week_of_year").select("date", "revenue", F.round("yhat", 2).alias("yhat"))


def err_sql(src, k=""):
    return f"""SELECT {k} round(avg(CASE WHEN abs(revenue) + abs(yhat) > 0 THEN abs(revenue - yhat) / ((abs(revenue) + abs(yhat)) / 2) END) * 100, 6) AS smape,
    round(avg(CASE WHEN revenue > 0 THEN abs((revenue - yhat) / revenue) END) * 100, 6) AS mape, round(avg(abs(revenue - yhat)), 2) AS mae,
    round(sqrt(avg((revenue - yhat) * (revenue - yhat))), 2) AS rmse, count(*) AS n FROM {src}"""


def round_err(e, *keys):
    return e.select(*keys, F.round("smape", 6).alias("smape"), F.round("mape", 6).alias("mape"), F.round("mae", 2).alias("mae"), F.round("rmse", 2).alias("rmse"), "n")


@query("ts9_errors", "sales", f"{err_sql('sn', chr(39) + 'naive' + chr(39) + ' AS model,')} UNION ALL {err_sql('hy', chr(39) + 'hybrid' + chr(39) + ' AS model,')}", _W + ", " + NAIVE + ", " + HYB)
def _(t):
    h = held(t)
    both = FC.seasonal_naive(h, "weekly").select("date", "revenue", "yhat", F.lit("naive").alias("model")).unionByName(
        FC.trend_seasonal(h, "week_of_year").select("date", "revenue", "yhat", F.lit("hybrid").alias("model")))
    return round_err(FC.errors(both, ["model"]), "model")


SEASON_KEY = {"daily": "dow", "weekly": "week_of_year", "monthly": "month"}
_TOUR_KEY = {"daily": "isodow(date)", "weekly": "week(date)", "monthly": "month(date)"}


def _tour_sql():
    out, sel = [], []
    for g, season in FC.SEASON.items():
        p = g[0]
        body = series_sql(g) + ", " + held_sql(g) + ", " + NAIVE.replace("52", str(season)) + ", " + HYB.replace("week(date)", _TOUR_KEY[g])
        for name in ("s", "f", "g", "h", "sn", "hx", "ft", "rs", "bk", "hy"):
            import re
            body = re.sub(rf"(?<![\w.']){name}(?= AS \(SELECT)", f"{p}_{name}", body)
            body = re.sub(rf"(FROM|JOIN|,) {name}(?![\w(])", rf"\1 {p}_{name}", body)
        out.append(body)
        for m, src in (("naive", "sn"), ("hybrid", "hy")):
            sel.append(f"SELECT '{m}' AS model, '{g}' AS grain, smape FROM ({err_sql(f'{p}_{src}')})")
    return ", ".join(out), " UNION ALL ".join(sel)


_TOUR, _TOUR_SEL = _tour_sql()


def tournament(t):
    rows = None
    for g in FC.LAGS:
        h = held(t, g)
        for m, f in (("naive", FC.seasonal_naive(h, g)), ("hybrid", FC.trend_seasonal(h, SEASON_KEY[g]))):
            e = FC.errors(f).select(F.lit(m).alias("model"), F.lit(g).alias("grain"), F.round("smape", 6).alias("smape"))
            rows = e if rows is None else rows.unionByName(e)
    return materialize(rows)


@query("ag28_tournament_pivot", "sales", f"SELECT model, max(smape) FILTER (WHERE grain = 'daily') AS daily, max(smape) FILTER (WHERE grain = 'weekly') AS weekly, max(smape) FILTER (WHERE grain = 'monthly') AS monthly FROM ({_TOUR_SEL}) GROUP BY 1", _TOUR)
def _(t):
    return FC.tournament_pivot(tournament(t))


@query("ts10_tournament_best", "sales", f"SELECT grain, arg_min(model, smape) AS model, min(smape) AS smape, min(smape) = (SELECT min(smape) FROM ({_TOUR_SEL})) AS best_overall FROM ({_TOUR_SEL}) GROUP BY 1", _TOUR)
def _(t):
    return FC.tournament_best(tournament(t))


@query("ts11_rolling_origin", "sales", f"""SELECT CAST(o AS INTEGER) AS fold, smape, mae, n FROM ({err_sql('fold', 'o,').replace(' FROM fold', ' FROM fold GROUP BY o')})""",
       series_sql("weekly") + ", " + held_sql("weekly") + """, oo AS (SELECT (SELECT count(*) FROM g) // 3 + k * 2 AS o FROM range(10) r(k) WHERE (SELECT count(*) FROM g) // 3 + k * 2 < (SELECT count(*) FROM g) - 4),
    fold AS (SELECT o, a.revenue, b.revenue AS yhat FROM oo JOIN g a ON a.j >= o AND a.j < o + 4 JOIN g b ON b.j = o - least(52, o) + (a.j - o) % least(52, o))""")
def _(t):
    r = FC.rolling_origin(FC.build_features(series(t, "weekly"), "weekly"), "weekly")
    e = FC.errors(FC.seasonal_naive(r, "weekly", keys=["fold"]), ["fold"])
    return round_err(e, "fold").select("fold", "smape", "mae", "n")


_OO = """oo AS (SELECT (SELECT count(*) FROM g) // 3 + k * 2 AS o FROM range(10) r(k) WHERE (SELECT count(*) FROM g) // 3 + k * 2 < (SELECT count(*) FROM g) - 4),
    gx AS (SELECT *, date_diff('day', DATE '2000-01-01', date)::DOUBLE AS x FROM g),
    of AS (SELECT o, regr_slope(revenue, x) AS b, regr_intercept(revenue, x) AS a FROM oo JOIN gx ON j < o GROUP BY o)"""


@query("ts11_linear_origins", "sales", "SELECT CAST(o AS INTEGER) AS fold, date, round(b, 4) AS slope, round(a + b * x, 2) AS yhat FROM of JOIN gx ON j >= o AND j < o + 4",
       series_sql("weekly") + ", " + held_sql("weekly") + ", " + _OO)
def _(t):
    r = FC.linear_at_origins(FC.build_features(series(t, "weekly"), "weekly"), "weekly")
    return r.select("fold", "date", F.round("slope", 4).alias("slope"), F.round("yhat", 2).alias("yhat"))


@query("ts11_linear_errors", "sales", f"""SELECT CAST(o AS INTEGER) AS fold, smape, mae, n FROM ({err_sql('fold', 'o,').replace(' FROM fold', ' FROM fold GROUP BY o')})""",
       series_sql("weekly") + ", " + held_sql("weekly") + ", " + _OO + ", fold AS (SELECT o, revenue, a + b * x AS yhat FROM of JOIN gx ON j >= o AND j < o + 4)")
def _(t):
    r = FC.linear_at_origins(FC.build_features(series(t, "weekly"), "weekly"), "weekly")
    return round_err(FC.errors(r, ["fold"]), "fold").select("fold", "smape", "mae", "n")


@query("ts11_hybrid_origins", "sales", f"""SELECT CAST(o AS INTEGER) AS fold, smape, mae, n FROM ({err_sql('fold', 'o,').replace(' FROM fold', ' FROM fold GROUP BY o')})""",
       series_sql("weekly") + ", " + held_sql("weekly") + ", " + _OO + """, res AS (SELECT o, week(date) AS wk, greatest(revenue - (a + b * x), 0) AS r FROM of JOIN gx ON j < o),
    eff AS (SELECT o, wk, avg(r) AS s FROM res GROUP BY 1, 2), ov AS (SELECT o, avg(r) AS s0 FROM res GROUP BY 1),
    fold AS (SELECT o, revenue, greatest(a + b * x + coalesce(s, s0), 0) AS yhat FROM of JOIN gx ON j >= o AND j < o + 4 JOIN ov USING (o) LEFT JOIN eff ON eff.o = of.o AND wk = week(date))""".replace("SELECT o, revenue, greatest", "SELECT of.o, revenue, greatest"))
def _(t):
    r = FC.rolling_origin(FC.build_features(series(t, "weekly"), "weekly"), "weekly")
    e = FC.errors(FC.trend_seasonal(r, "week_of_year", keys=["fold"]), ["fold"])
    return round_err(e, "fold").select("fold", "smape", "mae", "n")


@query("ts12_segment_naive", "sales rfm", f"""SELECT cluster, {err_sql('z').replace('SELECT', '', 1).replace(' FROM z', '')} FROM (SELECT a.cluster, a.revenue, b.revenue AS yhat FROM sh a JOIN sh b ON a.cluster = b.cluster AND NOT b.is_test
    AND b.j = a.n - least(52, a.n) + (a.j - a.n) % least(52, a.n) WHERE a.is_test) GROUP BY 1""", CLUSTER_SQL + ", sc AS (SELECT s.*, cluster FROM sales s JOIN cl USING (customer_id)), " + series_sql("weekly", "s", "cluster", "sc") + """,
    sg AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY date) - 1 AS i, count(*) OVER (PARTITION BY cluster) AS m FROM s) WHERE i >= 12 AND m >= 20),
    sj AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY date) - 1 AS j, CAST(floor(count(*) OVER (PARTITION BY cluster) * 0.8::DOUBLE) AS BIGINT) AS n FROM sg),
    sh AS (SELECT *, j >= n AS is_test FROM sj)""")
def _(t):
    li = t.sales(*COLS).join(cluster_labels(t), "customer_id")
    s = FC.series(li, "weekly", ["cluster"])
    f = FC.build_features(s, "weekly", ["cluster"])
    ok = s.groupBy("cluster").agg(F.count("*").alias("_n")).where("_n >= 20").select("cluster")
    h = FC.holdout(f.join(ok, "cluster", "left_semi"), ["cluster"])
    return round_err(FC.errors(FC.seasonal_naive(h, "weekly", ["cluster"]), ["cluster"]), "cluster")


@query("ts13_diagnostics", "sales", """SELECT round(avg(r), 2) AS residual_mean, round(stddev_pop(r), 2) AS residual_std, round(sum((r - mu) * (r1 - mu)) / sum((r - mu) * (r - mu)), 6) AS rho1,
    round(max(n) * (max(n) + 2) * pow(sum((r - mu) * (r1 - mu)) / sum((r - mu) * (r - mu)), 2) / (max(n) - 1), 5) AS ljung_box_q, round(corr(yhat, abs(r)), 6) AS hetero_corr
    FROM (SELECT *, lag(r) OVER (ORDER BY date) AS r1, avg(r) OVER () AS mu, count(*) OVER () AS n FROM (SELECT *, revenue - yhat AS r FROM sn))""", _W + ", " + NAIVE)
def _(t):
    d = FC.residual_diagnostics(FC.seasonal_naive(held(t), "weekly"))
    return d.select(F.round("residual_mean", 2).alias("residual_mean"), F.round("residual_std", 2).alias("residual_std"), F.round("rho1", 6).alias("rho1"),
                    F.round("ljung_box_q", 5).alias("ljung_box_q"), F.round("hetero_corr", 6).alias("hetero_corr"))


@query("ts13_normality")
def _(t):
    return FC.residual_diagnostics(FC.seasonal_naive(held(t), "weekly")).select("k2", "normality_p", "adf_stat")


def _fitted_parts(t):
    """Training rows with the trend's own fit, and test rows with their forecast."""
    h = held(t)
    both = FC.trend_seasonal(h.withColumn("is_test", F.lit(True)).unionByName(h.where("NOT is_test")), "week_of_year")
    fit = both.select("date", "revenue", "yhat", "row_idx", "train_n")
    return fit.where("row_idx < train_n"), fit.where("row_idx >= train_n")


@query("ts14_bootstrap")
def _(t):
    tr, te = _fitted_parts(t)
    return FC.bootstrap_interval(tr, te)


_REFIT = _W + """, dr AS (SELECT *, date_diff('day', DATE '2000-01-01', date)::DOUBLE AS x, week(date) AS wk, CAST('0x' || substr(md5(b || ':' || j || ':42'), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE AS u
    FROM h, range(1, 101) r(b) WHERE NOT is_test), dw AS (SELECT b, wk, x, revenue AS y, (""" + " + ".join(f"(u >= {c!r}::DOUBLE)::INTEGER" for c in FC.POISSON) + """)::DOUBLE AS w FROM dr),
    sm AS (SELECT b, wk, sum(w) AS s0, sum(w * x) AS sx, sum(w * y) AS sy, sum(w * x * x) AS sxx, sum(w * x * y) AS sxy FROM dw WHERE w > 0 GROUP BY 1, 2),
    tt AS (SELECT b, sum(s0) AS s0, sum(sx) AS sx, sum(sy) AS sy, sum(sxx) AS sxx, sum(sxy) AS sxy FROM sm GROUP BY 1),
    ln AS (SELECT *, (sy - slope * sx) / s0 AS icept FROM (SELECT *, (s0 * sxy - sx * sy) / (s0 * sxx - sx * sx) AS slope FROM tt)),
    ef AS (SELECT sm.b, wk, (sm.sy - icept * sm.s0 - slope * sm.sx) / sm.s0 AS e FROM sm JOIN ln USING (b)),
    pr AS (SELECT date, revenue, greatest(icept + slope * date_diff('day', DATE '2000-01-01', date) + coalesce(e, 0), 0) AS p
    FROM h JOIN ln ON TRUE LEFT JOIN ef ON ef.b = ln.b AND wk = week(date) WHERE is_test),
    bd AS (SELECT date, revenue AS actual, avg(p) AS m, stddev_pop(p) AS s FROM pr GROUP BY 1, 2)"""


@query("ts14_refit_lines", "sales", "SELECT CAST(b AS INTEGER) AS round, round(slope, 4) AS slope, round(icept, 1) AS icept FROM ln", _REFIT)
def _(t):
    return FC.refits(held(t), "week_of_year")[0].select("round", F.round("slope", 4).alias("slope"), F.round("icept", 1).alias("icept"))


@query("ts14_refits", "sales", """SELECT date, actual, round(m, 2) AS pred_mean, round(greatest(m - 1.96::DOUBLE * s, 0), 2) AS lower, round(m + 1.96::DOUBLE * s, 2) AS upper,
    actual BETWEEN greatest(m - 1.96::DOUBLE * s, 0) AND m + 1.96::DOUBLE * s AS covered, round(m + 1.96::DOUBLE * s - greatest(m - 1.96::DOUBLE * s, 0), 2) AS width FROM bd""", _REFIT)
def _(t):
    r = FC.refit_interval(held(t), "week_of_year")
    return r.select("date", "actual", *[F.round(c, 2).alias(c) for c in ("pred_mean", "lower", "upper", "width")], "covered")


@query("ts15_business_checks", "sales", """SELECT count(*) FILTER (WHERE yhat < 0) AS negative_predictions, count(*) FILTER (WHERE yhat > 2 * (SELECT max(revenue) FROM h WHERE NOT is_test)) AS extreme_predictions,
    (avg(revenue) FILTER (WHERE k <= 4) > avg(revenue) FILTER (WHERE k BETWEEN 5 AND 8)) = (avg(yhat) FILTER (WHERE k <= 4) > avg(yhat) FILTER (WHERE k BETWEEN 5 AND 8)) AS direction_match,
    round(abs(avg(revenue) - (SELECT avg(revenue) FROM h WHERE NOT is_test)) / (SELECT avg(revenue) FROM h WHERE NOT is_test) * 100, 6) AS shift_pct
    FROM (SELECT *, row_number() OVER (ORDER BY date DESC) AS k FROM sn)""", _W + ", " + NAIVE)
def _(t):
    h = held(t)
    c = FC.business_checks(h.where("NOT is_test"), FC.seasonal_naive(h, "weekly"))
    return c.select("negative_predictions", "extreme_predictions", "direction_match", F.round("shift_pct", 6).alias("shift_pct"))


@query("ts16_projection", "sales", """SELECT pred_date, round(amt, 1) AS pred_amount, round(amt + ci, 1) AS pred_upper, round(greatest(amt - ci, 0), 1) AS pred_lower, 'linear_x_seasonal' AS model_name FROM (
    SELECT pred_date, greatest(0, (a + b * x) * coalesce((SELECT arg_max(fac, date) FROM fs WHERE wk = week(pred_date)), 1)) * 100 AS amt,
    1.96 * (SELECT stddev_pop(revenue - (a + b * x)) FROM q, ft WHERE NOT is_test) * sqrt(1 + 1 / n + pow(x - mx, 2) / sxx) * 100 AS ci FROM fu)""", series_sql("weekly") + """,
    q AS (SELECT *, date_diff('day', min(date) OVER (), date)::DOUBLE AS x, row_number() OVER (ORDER BY date DESC) <= 4 AS is_test FROM s),
    ft AS (SELECT regr_slope(revenue, x) AS b, regr_intercept(revenue, x) AS a, count(*)::DOUBLE AS n, avg(x) AS mx, regr_sxx(revenue, x) AS sxx FROM q WHERE NOT is_test),
    fs AS (SELECT date, week(date) AS wk, CASE WHEN a + b * x > 0 THEN revenue / (a + b * x) ELSE 1 END AS fac FROM q, ft WHERE is_test),
    fu AS (SELECT CAST(max(date) + CAST(k AS INTEGER) * 7 AS DATE) AS pred_date, (max(x) + k * 7)::DOUBLE AS x, max(a) AS a, max(b) AS b, max(n) AS n, max(mx) AS mx, max(sxx) AS sxx
    FROM q, ft, range(1, 13) r(k) GROUP BY k)""")
def _(t):
    p = FC.linear_projection(series(t, "weekly"))
    return p.select("pred_date", *[F.round(c, 1).alias(c) for c in ("pred_amount", "pred_upper", "pred_lower")], "model_name")


@query("ts17_r2_from_rmse", "sales", "SELECT round(1 - avg((revenue - yhat) * (revenue - yhat)) / (SELECT var_samp(revenue) FROM (SELECT revenue FROM s ORDER BY date DESC LIMIT 4)), 6) AS r2 FROM sn", _W + ", " + NAIVE)
def _(t):
    e = FC.errors(FC.seasonal_naive(held(t), "weekly")).select("rmse")
    return FC.r2_from_rmse(series(t, "weekly"), e).select(F.round("r2", 6).alias("r2"))


@query("ts18_residual_histogram", "sales", """SELECT bin, count(*) AS count, round(max(lo + (bin - 0.5) * w), 1) AS center FROM (SELECT CAST(least(floor((r - lo) / w) + 1, 15) AS INTEGER) AS bin, lo, w FROM
    (SELECT revenue - yhat AS r, min(revenue - yhat) OVER () AS lo, (max(revenue - yhat) OVER () - min(revenue - yhat) OVER ()) / 15 AS w FROM sn)) GROUP BY 1""", _W + ", " + NAIVE)
def _(t):
    return FC.residual_histogram(FC.seasonal_naive(held(t), "weekly")).withColumn("center", F.round("center", 1))


@query("ag29_seasonality", "sales", "SELECT CAST(month(date) AS INTEGER) AS month, round(avg(revenue), 2) AS avg_revenue FROM s GROUP BY 1", series_sql("weekly"))
def _(t):
    return FC.seasonality(series(t, "weekly")).withColumn("avg_revenue", F.round("avg_revenue", 2))


@query("ps2_equal_width", "sales", """SELECT round(sum((b - a) * ln(b / a)), 6) AS psi FROM (SELECT k, (SELECT count(*) FROM z WHERE bin = k AND NOT is_test) / (SELECT count(*) FROM z WHERE NOT is_test)::DOUBLE + 1e-10 AS a,
    (SELECT count(*) FROM z WHERE bin = k AND is_test) / (SELECT count(*) FROM z WHERE is_test)::DOUBLE + 1e-10 AS b FROM range(1, 11) r(k))""",
       _W + ", z AS (SELECT is_test, least(floor((revenue - min(revenue) OVER ()) / ((max(revenue) OVER () - min(revenue) OVER ()) / 10)) + 1, 10) AS bin FROM h)")
def _(t):
    h = held(t)
    return DR.psi_equal_width(h.where("NOT is_test"), h.where("is_test"), "revenue").select(F.round("psi", 6).alias("psi"))


def _smooth_sql(m, src, name):
    """A recursion over the periods: every grid point's state is a row, its seasons a list."""
    grid = ", ".join(f"({a}::DOUBLE, {b}::DOUBLE, {g}::DOUBLE)" for a, b, g in SM.GRID)
    return f"""{name}_o AS (SELECT revenue AS v, row_number() OVER (ORDER BY date) AS i FROM {src}), {name}_y AS (SELECT list(v ORDER BY i) AS y, count(*) AS n FROM {name}_o),
    {name} AS (WITH RECURSIVE f AS (
        SELECT a, b, g, {m}::BIGINT AS i, n, list_sum(y[1:{m}]) / {m} AS l, (list_sum(y[{m} + 1:{2 * m}]) / {m} - list_sum(y[1:{m}]) / {m}) / {m} AS t,
            list_transform(y[1:{m}], lambda x: x - list_sum(y[1:{m}]) / {m}) AS s, 0::DOUBLE AS sse, 0::DOUBLE AS sae
        FROM {name}_y, (VALUES {grid}) w(a, b, g) WHERE n >= {2 * m}
        UNION ALL
        SELECT a, b, g, i, n, l2, b * (l2 - l) + (1 - b) * t, list_append(s[2:], g * (v - l2) + (1 - g) * s[1]), sse + (v - (l + t + s[1])) ** 2, sae + abs(v - (l + t + s[1]))
        FROM (SELECT f.* REPLACE (o.i AS i), v, a * (v - s[1]) + (1 - a) * (l + t) AS l2 FROM f JOIN {name}_o o ON o.i = f.i + 1))
        SELECT *, sqrt(sse / (n - {m})) AS rmse, sae / (n - {m}) AS mae FROM f WHERE i = n)"""


_SMOOTH = (("daily", 7), ("monthly", 12))


@query("ts7_level_trend_season", "sales", " UNION ALL ".join(
    f"""SELECT '{g}' AS grain, a AS alpha, b AS beta, g AS gamma, CAST(n AS INT) AS periods, round(l, 2) AS level, round(t, 4) AS trend, round(s[1], 2) AS next_season,
    round(s[{m}], 2) AS last_season, round(rmse, 2) AS rmse, round(mae, 2) AS mae FROM f{g}""" for g, m in _SMOOTH),
    ", ".join(series_sql(g, g) + ", " + _smooth_sql(m, g, "f" + g) for g, m in _SMOOTH))
def _(t):
    return reduce(lambda a, b: a.unionByName(b), [SM.level_trend_season(FC.series(t.sales(*COLS), g), m).select(
        F.lit(g).alias("grain"), "alpha", "beta", "gamma", "periods", F.round("level", 2).alias("level"), F.round("trend", 4).alias("trend"),
        F.round(F.col("seasons")[0], 2).alias("next_season"), F.round(F.element_at("seasons", -1), 2).alias("last_season"),
        F.round("rmse", 2).alias("rmse"), F.round("mae", 2).alias("mae")) for g, m in _SMOOTH])


@query("ts7_blended_holdout", "sales", f"""SELECT 'smoothed' AS model, e.* FROM ({err_sql('sm')}) e UNION ALL SELECT 'trend_seasonal', e.* FROM ({err_sql('hy')}) e
    UNION ALL SELECT 'blend', e.* FROM ({err_sql('bl')}) e""",
       _W + ", " + HYB + ", tr AS (SELECT date, revenue FROM h WHERE NOT is_test), " + _smooth_sql(52, "tr", "fs") + """,
    sm AS (SELECT date, revenue, greatest(l + (j - h.n + 1) * t + s[(j - h.n) % 52 + 1], 0) AS yhat FROM h, (SELECT * EXCLUDE (n) FROM fs ORDER BY rmse, a, b, g LIMIT 1) WHERE is_test),
    bl AS (SELECT sm.date, sm.revenue, (0.4::DOUBLE * sm.yhat + 0.6::DOUBLE * hy.yhat) / (0.4::DOUBLE + 0.6::DOUBLE) AS yhat FROM sm JOIN hy USING (date))""")
def _(t):
    df = held(t)
    models = {"smoothed": materialize(SM.smoothed_holdout(df, 52)), "trend_seasonal": FC.trend_seasonal(df, "week_of_year")}
    models["blend"] = SM.blend(models, {"smoothed": 0.4, "trend_seasonal": 0.6})
    return reduce(lambda a, b: a.unionByName(b), [FC.errors(f).select(
        F.lit(m).alias("model"), *[F.round(c, d).alias(c) for c, d in (("smape", 6), ("mape", 6), ("mae", 2), ("rmse", 2))], "n") for m, f in models.items()])
