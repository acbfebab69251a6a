"""Sales series, calendar and lag features, closed-form forecasts, and their evaluation.

Every function takes ``keys`` for the series it runs over; windows partition by
them, so many series run side by side. A series is an aggregate with one row per
day, week or month, so its windows are short whatever the size of the lines.
"""

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions import scalars as X
from ..functions.quantiles import attach, exact_quantiles
from .dims import near_holiday

LAGS = {"daily": [1, 3, 7, 14, 30], "weekly": [1, 2, 4, 8, 12], "monthly": [1, 2, 3, 6, 12]}
WINDOWS = {"daily": [7, 14, 30], "weekly": [4, 8, 12], "monthly": [3, 6, 12]}
SEASON = {"daily": 7, "weekly": 52, "monthly": 12}


def bucket(grain, ts="invoice_date") -> Column:
    c = F.col(ts)
    return {"daily": F.to_date(c), "weekly": X.week_bucket(c), "monthly": F.trunc(c, "month")}[grain]


def series(lines: DataFrame, grain, keys=()) -> DataFrame:
    """Revenue, orders, customers and units per bucket.

    Lines are first summed per visit; the distinct counts then run over visits,
    and Spark groups them by bucket and id before it counts, so a busy bucket
    is spread over its orders and customers.
    """
    k = [*keys, "date"]
    visits = lines.groupBy(*keys, bucket(grain).alias("date"), "invoice_no", "customer_id").agg(
        F.sum("line_cents").alias("_c"), F.sum("quantity").alias("_q"))
    return visits.groupBy(*k).agg((F.sum("_c") / 100).alias("revenue"), F.sum("_q").alias("quantity"),
                                  F.count_distinct("invoice_no").alias("orders"), F.count_distinct("customer_id").alias("customers"))


def _w(keys):
    return Window.partitionBy(*(keys or [F.lit(0)]))


def lag_features(s: DataFrame, grain, keys=(), y="revenue") -> DataFrame:
    w = _w(keys).orderBy("date")
    return s.withColumns({f"lag_{k}": F.lag(y, k).over(w) for k in LAGS[grain]})


def rolling_features(s: DataFrame, grain, keys=(), y="revenue", leaky=True) -> DataFrame:
    """Rolling mean, deviation, maximum and minimum over full windows.

    The window ends at the row itself; ``leaky=False`` ends it one row earlier.
    """
    out = {}
    for n in WINDOWS[grain]:
        lo, hi = (-(n - 1), 0) if leaky else (-n, -1)
        w = _w(keys).orderBy("date").rowsBetween(lo, hi)
        full = F.count(y).over(w) == n
        for name, f in (("mean", F.avg), ("std", F.stddev_samp), ("max", F.max), ("min", F.min)):
            out[f"roll_{name}_{n}"] = F.when(full, f(y).over(w))
    return s.withColumns(out)


def growth(s: DataFrame, keys=(), y="revenue") -> DataFrame:
    prev = F.lag(y, 1).over(_w(keys).orderBy("date"))
    return s.withColumn("growth_1", F.coalesce(F.try_divide(F.col(y) - prev, prev), F.lit(0.0)))


def time_index(s: DataFrame, keys=()) -> DataFrame:
    return s.withColumn("time_idx", F.row_number().over(_w(keys).orderBy("date")) - 1)


def time_features(s: DataFrame, grain) -> DataFrame:
    d = F.col("date")
    out = {"year": F.year(d), "month": F.month(d), "quarter": F.quarter(d)}
    if grain == "daily":
        out |= {"dow": F.weekday(d), "is_weekend": (F.weekday(d) >= 5).cast("int"), "day_of_year": F.dayofyear(d)}
    elif grain == "weekly":
        out["week_of_year"] = F.weekofyear(d)
    else:
        out["month_of_year"] = F.month(d)
    return s.withColumns(out)


def build_features(s: DataFrame, grain, keys=(), y="revenue", leaky=True, drop_head=True) -> DataFrame:
    """Lags, rolling statistics, dates, index and growth; the rows without a full lag history are dropped."""
    df = growth(time_index(time_features(rolling_features(lag_features(s, grain, keys, y), grain, keys, y, leaky), grain), keys), keys, y)
    return df.where(F.col("time_idx") >= max(LAGS[grain])) if drop_head else df


def calendar_features(s: DataFrame, holidays=S.HOLIDAYS) -> DataFrame:
    """Weekly calendar flags: Christmas distance and season, sales weeks, holidays, month and week cycles."""
    d, m, w = F.col("date"), F.month("date"), F.weekofyear("date")
    xmas = F.datediff(F.make_date(F.year(d), F.lit(12), F.lit(25)), d)
    out = s.withColumns({
        "days_to_christmas": F.least(F.greatest(xmas, F.lit(-30)), F.lit(365)), "is_christmas_season": (m >= 11).cast("int"),
        "is_jan_sale": (m == 1).cast("int"), "is_black_friday_week": ((m == 11) & (w >= 47)).cast("int"),
        "month_sin": F.sin(2 * F.pi() * m / 12), "month_cos": F.cos(2 * F.pi() * m / 12),
        "woy_sin": F.sin(2 * F.pi() * w / 52), "woy_cos": F.cos(2 * F.pi() * w / 52),
        "is_month_end": (F.day(d) >= 25).cast("int"), "is_xmas_peak": w.between(49, 52).cast("int")})
    return near_holiday(out, holidays)


def holdout(df: DataFrame, keys=(), share=0.2, last=None) -> DataFrame:
    """Mark each row train or test: the last ``last`` rows, or the last ``share`` of a series."""
    i = F.row_number().over(_w(keys).orderBy("date")) - 1
    n = F.count("*").over(_w(keys))
    split = n - last if last is not None else F.floor(n * F.lit(1 - share))
    return df.withColumns({"_i": i, "_n": n}).withColumn("is_test", F.col("_i") >= split).withColumns(
        {"train_n": split.cast("int")}).drop("_n").withColumnRenamed("_i", "row_idx")


def decay_weights(df: DataFrame, keys=(), decay=0.97) -> DataFrame:
    """Weights that fall with age, scaled to sum to the number of training rows."""
    age = F.col("train_n") - 1 - F.col("row_idx")
    raw = F.when(~F.col("is_test"), F.pow(F.lit(decay), age))
    return df.withColumn("_w", raw).withColumn("weight", F.col("_w") / F.sum("_w").over(_w(keys)) * F.col("train_n")).drop("_w")


def seasonal_naive(df: DataFrame, grain, keys=(), y="revenue", season=None) -> DataFrame:
    """Repeat the last season of the training part over the test part."""
    m = F.least(F.lit(season or SEASON[grain]), F.col("train_n"))
    test = df.where("is_test").withColumn("src", F.col("train_n") - m + (F.col("row_idx") - F.col("train_n")) % m)
    src = df.where("NOT is_test").select(*keys, F.col("row_idx").alias("src"), F.col(y).alias("yhat"))
    return test.join(src, [*keys, "src"]).drop("src")


def trend_seasonal(df: DataFrame, season_key, keys=(), y="revenue") -> DataFrame:
    """Linear trend plus the mean floored residual of the season key; unseen keys take the overall mean."""
    x = F.datediff("date", F.lit("1970-01-01").cast("date")).cast("double")
    train = df.where("NOT is_test").withColumn("_x", x)
    fit = train.groupBy(*keys).agg(F.regr_slope(y, "_x").alias("slope"), F.regr_intercept(y, "_x").alias("icept"))
    res = attach(train, fit, keys).withColumn("_r", F.greatest(F.col(y) - (F.col("icept") + F.col("slope") * F.col("_x")), F.lit(0.0)))
    by_key = res.groupBy(*keys, season_key).agg(F.avg("_r").alias("_s"))
    overall = res.groupBy(*keys).agg(F.avg("_r").alias("_o"))
    out = attach(attach(df.where("is_test").withColumn("_x", x), fit, keys), overall, keys).join(by_key, [*keys, season_key], "left")
    yhat = F.col("icept") + F.col("slope") * F.col("_x") + F.coalesce("_s", "_o")
    return out.withColumn("yhat", F.greatest(yhat, F.lit(0.0))).drop("_x", "slope", "icept", "_s", "_o")


def errors(df: DataFrame, keys=(), y="revenue", yhat="yhat") -> DataFrame:
    """sMAPE (zero denominators skipped), MAPE (positive actuals), MAE and RMSE."""
    a, p = F.col(y), F.col(yhat)
    den = (F.abs(a) + F.abs(p)) / 2
    return df.groupBy(*keys).agg(
        (F.avg(F.when(den > 0, F.abs(F.try_divide(a - p, den)))) * 100).alias("smape"),
        (F.avg(F.when(a > 0, F.abs(F.try_divide(a - p, a)))) * 100).alias("mape"),
        F.avg(F.abs(a - p)).alias("mae"), F.sqrt(F.avg((a - p) * (a - p))).alias("rmse"), F.count("*").alias("n"))


def tournament_pivot(results: DataFrame) -> DataFrame:
    """sMAPE per model and grain side by side."""
    return results.groupBy("model").pivot("grain", ["daily", "weekly", "monthly"]).agg(F.avg("smape"))


def tournament_best(results: DataFrame) -> DataFrame:
    """Best model per grain, and overall."""
    per = results.groupBy("grain").agg(F.min_by("model", F.struct("smape", "model")).alias("model"), F.min("smape").alias("smape"))
    return per.withColumn("best_overall", F.col("smape") == results.agg(F.min("smape")).scalar())


#: Step between two origins and rows to forecast from each.
STEPS = {"daily": (7, 30), "weekly": (2, 4), "monthly": (1, 2)}


def _origins(n, grain, max_folds):
    """Sizes of the growing training window: from a third of the ``n`` rows in fixed steps, as long as the horizon fits."""
    step, horizon = STEPS[grain]
    return F.filter(F.transform(F.sequence(F.lit(0), F.lit(max_folds - 1)), lambda f: F.floor(n / 3) + f * step), lambda o: o < n - horizon)


def _line(n, sx, sy, sxx, sxy):
    """Slope and intercept of the least-squares line from its sums; a level line where there is no spread."""
    n, sx, sy, sxx, sxy = (F.col(c) for c in (n, sx, sy, sxx, sxy))
    slope = F.coalesce(F.try_divide(n * sxy - sx * sy, n * sxx - sx * sx), F.lit(0.0))
    return slope, (sy - slope * sx) / n


def _days(date="date"):
    return F.datediff(date, F.lit("2000-01-01").cast("date")).cast("double")


def linear_at_origins(df: DataFrame, grain, max_folds=10, keys=(), y="revenue") -> DataFrame:
    """The line refitted at every origin of ``rolling_origin`` and its forecast over the horizon: fold, date, y, slope, icept, yhat.

    The sums of the normal equations run along the series once; an origin's fit is read off at its row, so training rows
    are not repeated per fold.
    """
    horizon, before = STEPS[grain][1], _w(keys).orderBy("date").rowsBetween(Window.unboundedPreceding, -1)
    x, v = F.col("_x"), F.col(y).cast("double")
    d = df.select(*keys, "date", y).withColumns({"_x": _days(), "row_idx": F.row_number().over(_w(keys).orderBy("date")) - 1, "_n": F.count("*").over(_w(keys))})
    d = d.withColumns({"_s0": F.count("*").over(before), "_sx": F.sum(x).over(before), "_sy": F.sum(v).over(before),
                       "_sxx": F.sum(x * x).over(before), "_sxy": F.sum(x * v).over(before), "_o": _origins(F.col("_n"), grain, max_folds)})
    slope, icept = _line("_s0", "_sx", "_sy", "_sxx", "_sxy")
    fits = d.where(F.array_contains("_o", F.col("row_idx").cast("long"))).select(*keys, F.col("row_idx").alias("fold"), slope.alias("slope"), icept.alias("icept"))
    ahead = F.filter("_o", lambda o: (o <= F.col("row_idx")) & (F.col("row_idx") < o + horizon))
    test = d.select(*keys, "date", y, "_x", F.explode(ahead.cast("array<int>")).alias("fold"))
    return test.join(fits, [*keys, "fold"]).withColumn("yhat", F.col("icept") + F.col("slope") * x).drop("_x")


def rolling_origin(df: DataFrame, grain, max_folds=10, keys=()) -> DataFrame:
    """Folds of a growing training window: start at n/3, fixed step and horizon, at most ``max_folds``.

    Each row is repeated once per fold it belongs to; a fold id then acts as one more series key.
    """
    horizon = STEPS[grain][1]
    i = F.row_number().over(_w(keys).orderBy("date")) - 1
    d = df.withColumns({"row_idx": i, "_n": F.count("*").over(_w(keys))})
    d = d.withColumn("train_n", F.explode(_origins(F.col("_n"), grain, max_folds))).where(F.col("row_idx") < F.col("train_n") + horizon)
    return d.withColumn("fold", F.col("train_n").cast("int")).withColumn("train_n", F.col("train_n").cast("int")).withColumn(
        "is_test", F.col("row_idx") >= F.col("train_n")).drop("_n")


def linear_projection(s: DataFrame, horizon=12, held=4, y="revenue", scale=100, keys=()) -> DataFrame:
    """The stored weekly projection: a line on all but the last weeks, times the ratio of the matching
    held-out ISO week, with a 1.96 sigma band."""
    h = holdout(s, keys, last=held)
    first = h.groupBy(*keys).agg(F.min("date").alias("_d0"), F.max("date").alias("_dl"))
    h = attach(h, first, keys).withColumn("x", F.datediff("date", "_d0").cast("double"))
    tr = h.where("NOT is_test")
    fit = tr.groupBy(*keys).agg(F.regr_slope(y, "x").alias("b"), F.regr_intercept(y, "x").alias("a"), F.count("*").alias("n"),
                                F.avg("x").alias("mx"), F.regr_sxx(y, "x").alias("sxx"))
    res = attach(tr, fit, keys).groupBy(*keys).agg(F.stddev_pop(F.col(y) - (F.col("a") + F.col("b") * F.col("x"))).alias("sigma"))
    pred = F.col("a") + F.col("b") * F.col("x")
    seas = attach(h.where("is_test"), fit, keys).select(
        *keys, "date", F.weekofyear("date").alias("wk"), F.when(pred > 0, F.col(y) / pred).otherwise(1.0).alias("f")).groupBy(*keys, "wk").agg(
        F.max_by("f", "date").alias("f"))
    fut = attach(attach(first, fit, keys), res, keys).withColumn("h", F.explode(F.sequence(F.lit(1), F.lit(horizon)))).withColumn(
        "pred_date", F.date_add("_dl", F.col("h") * 7)).withColumn("x", F.datediff("pred_date", "_d0").cast("double")).withColumn(
        "wk", F.weekofyear("pred_date"))
    out = fut.join(seas, [*keys, "wk"], "left")
    amount = F.greatest(F.lit(0.0), pred * F.coalesce("f", F.lit(1.0))) * scale
    ci = 1.96 * F.col("sigma") * F.sqrt(1 + 1 / F.col("n") + (F.col("x") - F.col("mx")) * (F.col("x") - F.col("mx")) / F.col("sxx")) * scale
    return out.select(*keys, "pred_date", amount.alias("pred_amount"), (amount + ci).alias("pred_upper"),
                      F.greatest(F.lit(0.0), amount - ci).alias("pred_lower"), F.lit("linear_x_seasonal").alias("model_name"))


def r2_from_rmse(s: DataFrame, rmse: DataFrame, last=4, y="revenue") -> DataFrame:
    """R2 of a model from its RMSE and the sample variance of the last weeks; 0 without variance."""
    tail = s.orderBy(F.desc("date")).limit(last).agg(F.var_samp(y).alias("v"))
    return tail.select(F.coalesce(1 - F.try_divide(F.pow(rmse.scalar(), 2), F.col("v")), F.lit(0.0)).alias("r2"))


def residual_histogram(df: DataFrame, bins=15, y="revenue", yhat="yhat") -> DataFrame:
    """Equal-width residual counts with bin centres."""
    r = df.select((F.col(y) - F.col(yhat)).alias("r"))
    rng = r.agg(F.struct(F.min("r").alias("lo"), F.max("r").alias("hi")))
    b = r.withColumn("_q", rng.scalar()).withColumn("width", (F.col("_q.hi") - F.col("_q.lo")) / bins).withColumn(
        "bin", F.least(F.coalesce(F.floor(F.try_divide(F.col("r") - F.col("_q.lo"), F.col("width"))), F.lit(0)) + 1, F.lit(bins)).cast("int"))
    return b.groupBy("bin").agg(F.count("*").alias("count"), F.max(F.col("_q.lo") + (F.col("bin") - 0.5) * F.col("width")).alias("center"))


def residual_diagnostics(df: DataFrame, y="revenue", yhat="yhat", lags=7) -> DataFrame:
    """Moments, normality (D'Agostino K2), autocorrelation (Ljung-Box Q, lag 1), stationarity
    (Dickey-Fuller t) and the correlation of |residual| with the forecast."""
    w = Window.partitionBy(F.lit(0)).orderBy("date")
    r = df.select("date", (F.col(y) - F.col(yhat)).alias("r"), F.col(yhat).alias("p"))
    r = r.withColumns({"r1": F.lag("r", 1).over(w), "n": F.count("*").over(Window.partitionBy(F.lit(0))),
                       "mu": F.avg("r").over(Window.partitionBy(F.lit(0)))}).withColumn("d", F.col("r") - F.col("r1"))
    g = r.agg(
        F.avg("r").alias("residual_mean"), F.stddev_pop("r").alias("residual_std"), F.min("r").alias("residual_min"),
        F.max("r").alias("residual_max"), F.skewness("r").alias("skew"), F.kurtosis("r").alias("kurt"), F.max("n").alias("n"),
        (F.sum((F.col("r") - F.col("mu")) * (F.col("r1") - F.col("mu"))) / F.sum((F.col("r") - F.col("mu")) * (F.col("r") - F.col("mu")))).alias("rho1"),
        F.corr("p", F.abs("r")).alias("hetero_corr"), F.regr_slope("d", "r1").alias("g"), F.regr_sxx("d", "r1").alias("sxx"),
        F.regr_syy("d", "r1").alias("syy"), F.regr_count("d", "r1").alias("m"))
    n, k = F.col("n").cast("double"), F.col("kurt")
    # skewness and kurtosis tests turned into one chi-square with two degrees of freedom
    yv = F.col("skew") * F.sqrt((n + 1) * (n + 3) / (6 * (n - 2)))
    b2 = 3 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9))
    w2 = F.sqrt(2 * (b2 - 1)) - 1
    u = yv / F.sqrt(2 / (w2 - 1))
    z1 = F.ln(u + F.sqrt(u * u + 1)) / F.sqrt(F.ln(F.sqrt(w2)))
    e, v = 3 * (n - 1) / (n + 1), 24 * n * (n - 2) * (n - 3) / ((n + 1) * (n + 1) * (n + 3) * (n + 5))
    xk = (k + 3 - e) / F.sqrt(v)
    sb = 6 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * F.sqrt(6 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3)))
    a = 6 + 8 / sb * (2 / sb + F.sqrt(1 + 4 / (sb * sb)))
    z2 = (1 - 2 / (9 * a) - F.cbrt((1 - 2 / a) / (1 + xk * F.sqrt(2 / (a - 4))))) / F.sqrt(2 / (9 * a))
    k2 = z1 * z1 + z2 * z2
    q = n * (n + 2) * F.col("rho1") * F.col("rho1") / (n - 1)
    se = F.sqrt((F.col("syy") - F.col("g") * F.col("g") * F.col("sxx")) / (F.col("m") - 2) / F.col("sxx"))
    return g.select("residual_mean", "residual_std", "residual_min", "residual_max", k2.alias("k2"), F.exp(-k2 / 2).alias("normality_p"),
                    "rho1", q.alias("ljung_box_q"), F.try_divide("g", se).alias("adf_stat"), "hetero_corr")


def bootstrap_interval(train: DataFrame, test: DataFrame, rounds=100, seed=42, y="revenue", yhat="yhat") -> DataFrame:
    """95 % band per test row from resampled training residuals.

    Residuals of the fitted line are drawn by hash for every (round, row); the
    band is the forecast plus and minus 1.96 deviations of the resampled means.
    """
    res = train.select((F.col(y) - F.col(yhat)).alias("r"), (F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("date")) - 1).alias("i"))
    n = res.agg(F.count("*")).scalar()
    draws = test.select("date", y, yhat).withColumn("_n", n).withColumn("b", F.explode(F.sequence(F.lit(1), F.lit(rounds)))).withColumn(
        "i", F.pmod(F.xxhash64("date", "b", F.lit(seed)), F.col("_n")).cast("int"))
    paths = draws.join(res, "i").withColumn("p", F.greatest(F.col(yhat) + F.col("r"), F.lit(0.0)))
    g = paths.groupBy("date", y).agg(F.avg("p").alias("pred_mean"), F.stddev_pop("p").alias("s"))
    lo, hi = F.greatest(F.col("pred_mean") - 1.96 * F.col("s"), F.lit(0.0)), F.col("pred_mean") + 1.96 * F.col("s")
    return g.select("date", F.col(y).alias("actual"), "pred_mean", lo.alias("lower"), hi.alias("upper"),
                    F.col(y).between(lo, hi).alias("covered"), (hi - lo).alias("width"))


#: Chances that a Poisson draw of mean 1 is at most 0, 1, 2, ...
POISSON = [math.exp(-1) * sum(1 / math.factorial(j) for j in range(k + 1)) for k in range(9)]


def refits(df: DataFrame, season_key, rounds=100, seed=42, y="revenue"):
    """Trend and season refitted on ``rounds`` bootstrap samples of the training rows: (lines, seasons).

    A row counts in a sample as often as a Poisson draw from the md5 of (round, row, seed) says. The sums of the weighted normal
    equations per round and season key are one aggregate; lines (round, slope, icept) come from their totals, and seasons
    (round, key, effect), the mean distance from the line, from the same sums.
    """
    u = F.conv(F.substring(F.md5(F.concat_ws(":", "round", "row_idx", F.lit(seed))), 1, 8), 16, 10).cast("double") / 2 ** 32
    draws = df.where("NOT is_test").withColumn("round", F.explode(F.sequence(F.lit(1), F.lit(rounds)))).withColumn("_u", u)
    w, x, v = sum((F.col("_u") >= c).cast("int") for c in POISSON), _days(), F.col(y).cast("double")
    sums = draws.withColumns({"_w": w.cast("double"), "_x": x}).where("_w > 0").groupBy("round", season_key).agg(
        F.sum("_w").alias("_s0"), F.sum(F.col("_w") * F.col("_x")).alias("_sx"), F.sum(F.col("_w") * v).alias("_sy"),
        F.sum(F.col("_w") * F.col("_x") * F.col("_x")).alias("_sxx"), F.sum(F.col("_w") * F.col("_x") * v).alias("_sxy"))
    total = ("_s0", "_sx", "_sy", "_sxx", "_sxy")
    slope, icept = _line(*total)
    lines = sums.groupBy("round").agg(*[F.sum(c).alias(c) for c in total]).select("round", slope.alias("slope"), icept.alias("icept"))
    effect = (F.col("_sy") - F.col("icept") * F.col("_s0") - F.col("slope") * F.col("_sx")) / F.col("_s0")
    return lines, sums.join(lines, "round").select("round", season_key, effect.alias("effect"))


def refit_interval(df: DataFrame, season_key, rounds=100, seed=42, y="revenue") -> DataFrame:
    """95 % band per test row from the forecasts of ``refits``, none below 0: mean, band, whether it covers the actual, width. A
    season key that a sample lacks has no effect in it."""
    lines, seasons = refits(df, season_key, rounds, seed, y)
    test = df.where("is_test").select("date", y, season_key).withColumns({"_x": _days(), "round": F.explode(F.sequence(F.lit(1), F.lit(rounds)))})
    p = test.join(lines, "round").join(seasons, ["round", season_key], "left").withColumn(
        "_p", F.greatest(F.col("icept") + F.col("slope") * F.col("_x") + F.coalesce("effect", F.lit(0.0)), F.lit(0.0)))
    g = p.groupBy("date", y).agg(F.avg("_p").alias("pred_mean"), F.stddev_pop("_p").alias("s"))
    lo, hi = F.greatest(F.col("pred_mean") - 1.96 * F.col("s"), F.lit(0.0)), F.col("pred_mean") + 1.96 * F.col("s")
    return g.select("date", F.col(y).alias("actual"), "pred_mean", lo.alias("lower"), hi.alias("upper"), F.col(y).between(lo, hi).alias("covered"), (hi - lo).alias("width"))


def business_checks(train: DataFrame, test: DataFrame, y="revenue", yhat="yhat") -> DataFrame:
    """Negative and extreme forecasts, recent trend direction, and the shift of the mean."""
    w = Window.partitionBy(F.lit(0)).orderBy(F.desc("date"))
    t = test.withColumn("_k", F.row_number().over(w))
    hist = train.agg(F.struct(F.max(y).alias("mx"), F.avg(y).alias("mu"))).scalar()
    near, far = F.col("_k") <= 4, (F.col("_k") > 4) & (F.col("_k") <= 8)

    def mean(c, cond):
        return F.avg(F.when(cond, F.col(c)))
    g = t.withColumn("_h", hist).agg(
        F.count(F.when(F.col(yhat) < 0, 1)).alias("negative_predictions"),
        F.count(F.when(F.col(yhat) > F.col("_h.mx") * 2, 1)).alias("extreme_predictions"),
        ((mean(y, near) > mean(y, far)) == (mean(yhat, near) > mean(yhat, far))).alias("direction_match"),
        F.avg(y).alias("_t"), F.max("_h.mu").alias("_m"))
    shift = F.abs(F.col("_t") - F.col("_m")) / F.col("_m") * 100
    return g.select("negative_predictions", "extreme_predictions", "direction_match", shift.alias("shift_pct"), (shift < 20).alias("stable"))


def seasonality(s: DataFrame, y="revenue") -> DataFrame:
    """Mean weekly revenue per month of the year."""
    return s.groupBy(F.month("date").alias("month")).agg(F.avg(y).alias("avg_revenue"))


def median_ape(df: DataFrame, y, yhat) -> DataFrame:
    ape = df.select((F.abs((F.col(y) - F.col(yhat)) / (F.col(y) + 1)) * 100).alias("ape"))
    return exact_quantiles(ape, "ape", [0.5]).select(F.get("q", F.lit(0)).alias("median_ape"))
