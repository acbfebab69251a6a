"""Additive level, trend and season smoothed along each series, for a grid of weights, and blends of forecasts.

A series is folded in one native expression over its ordered values: every period moves the level towards the value less
its season, the trend towards the change of the level, and the season towards the value less the level. All weights of the
grid run side by side, a row a series and grid point. A series is an aggregate with one row per period, so its array is short
whatever the size of the lines; many series are dealt to tasks by their keys.

The first season gives the first level (its mean) and seasons, the means of the first two seasons the first trend, and errors are
counted from the second season on. Rows count as consecutive periods in the order of ``date``; of rows with one date the smaller
value comes first. A null or NaN value takes the forecast's place and counts no error. Rows without a date take no part, and a
series shorter than two seasons, or with no value in one of the first two, has no fit.
"""

from functools import reduce
from itertools import product

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Weights of level, trend and season.
GRID = tuple(product((0.1, 0.3, 0.6), (0.0, 0.05, 0.2), (0.05, 0.2, 0.5)))

_STATE = "struct<level:double,trend:double,seasons:array<double>,sse:double,sae:double,counted:bigint>"


def _mean(values):
    known = F.filter(values, lambda v: v.isNotNull())
    return F.try_divide(F.aggregate(known, F.lit(0.0), lambda a, v: a + v), F.size(known))


def level_trend_season(s: DataFrame, season, keys=(), y="revenue", grid=GRID, damping=1.0) -> DataFrame:
    """Per series and (alpha, beta, gamma) of ``grid``: periods, last_date, the final level, trend and seasons (the next period's
    first), and the one-step errors rmse and mae over ``counted`` periods. ``damping`` multiplies the trend at each step."""
    if season < 1 or not grid:
        raise ValueError("a season of at least one period and a grid of at least one point")
    value = F.col(y).cast("double")
    row = F.struct("date", F.when(~F.isnan(value), value).alias("v"))
    ordered = s.where(F.col("date").isNotNull()).groupBy(*keys).agg(F.array_sort(F.collect_list(row)).alias("_rows"))
    ordered = ordered.select(*keys, F.transform("_rows", lambda r: r["v"]).alias("_y"), F.element_at("_rows", -1)["date"].alias("last_date"))
    ordered = ordered.where(F.size("_y") >= 2 * season)
    first = ordered.withColumn("_level", _mean(F.slice("_y", 1, season)))
    first = first.withColumn("_trend", (_mean(F.slice("_y", season + 1, season)) - F.col("_level")) / season)
    first = first.where(F.col("_level").isNotNull() & F.col("_trend").isNotNull())
    points = F.array(*[F.struct(*[F.lit(float(w)).alias(n) for w, n in zip(p, ("alpha", "beta", "gamma"))]) for p in grid])
    each = first.select("*", F.inline(points))
    seasons = F.transform(F.slice("_y", 1, season), lambda v: F.coalesce(v - F.col("_level"), F.lit(0.0)))
    start = F.struct(F.col("_level"), F.col("_trend"), seasons, F.lit(0.0), F.lit(0.0), F.lit(0).cast("long")).cast(_STATE)

    def step(state, v):
        alpha, beta, gamma = F.col("alpha"), F.col("beta"), F.col("gamma")
        drift = state["trend"] * damping
        flat, old = state["level"] + drift, F.element_at(state["seasons"], 1)
        seen = F.coalesce(v, flat + old)
        level = alpha * (seen - old) + (1 - alpha) * flat
        miss = F.coalesce(v - (flat + old), F.lit(0.0))
        return F.struct(level.alias("level"), (beta * (level - state["level"]) + (1 - beta) * drift).alias("trend"),
                        F.concat(F.slice(state["seasons"], 2, season), F.array(gamma * (seen - level) + (1 - gamma) * old)).alias("seasons"),
                        (state["sse"] + miss * miss).alias("sse"), (state["sae"] + F.abs(miss)).alias("sae"),
                        (state["counted"] + F.when(v.isNull(), 0).otherwise(1)).cast("long").alias("counted")).cast(_STATE)
    done = each.withColumn("_s", F.aggregate(F.slice("_y", F.lit(season + 1), F.size("_y")), start, step))
    return done.select(*keys, "alpha", "beta", "gamma", F.size("_y").alias("periods"), "last_date", "_s.level", "_s.trend", "_s.seasons",
                       F.sqrt(F.try_divide("_s.sse", "_s.counted")).alias("rmse"), F.try_divide("_s.sae", "_s.counted").alias("mae"), "_s.counted")


def least_error(fits: DataFrame, keys=()) -> DataFrame:
    """The fit of least rmse of each series; ties go to the smaller weights."""
    order = F.struct(F.col("rmse").isNull(), "rmse", "alpha", "beta", "gamma")
    best = fits.groupBy(*keys).agg(F.min_by(F.struct(*[c for c in fits.columns if c not in keys]), order).alias("_b"))
    return best.where(F.col("_b").isNotNull()).select(*keys, "_b.*")


def _yhat(fit, step, floor, damping):
    drift = step if damping == 1.0 else damping * (1 - F.pow(F.lit(damping), step)) / (1 - damping)
    yhat = fit("level") + drift * fit("trend") + F.element_at(fit("seasons"), ((step - 1) % F.size(fit("seasons")) + 1).cast("int"))
    return yhat if floor is None else F.greatest(yhat, F.lit(float(floor)))


def ahead(fits: DataFrame, horizon, floor=0.0, damping=1.0) -> DataFrame:
    """``horizon`` (at least one) periods ahead of each fit, a row each: ``step`` from 1, and ``yhat``, not below ``floor`` (None: no
    floor)."""
    out = fits.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(horizon))))
    kept = [c for c in fits.columns if c not in ("seasons", "level", "trend", "step", "yhat")]
    return out.select(*kept, "step", _yhat(F.col, F.col("step"), floor, damping).alias("yhat"))


def smoothed_holdout(df: DataFrame, season, keys=(), y="revenue", grid=GRID, floor=0.0, damping=1.0) -> DataFrame:
    """The test part of a frame with ``row_idx``, ``train_n`` and ``is_test``, with ``yhat`` from the training part's fit of least
    error; series without a fit are left out."""
    best = least_error(level_trend_season(df.where("NOT is_test"), season, keys, y, grid, damping), keys)
    fit, test = F.struct("level", "trend", "seasons").alias("_fit"), df.where("is_test")
    if keys:
        named = best.select(*[F.col(k).alias(f"_key{i}") for i, k in enumerate(keys)], fit)
        same = [F.col(k).eqNullSafe(F.col(f"_key{i}")) for i, k in enumerate(keys)]
        out = test.join(named, reduce(lambda a, b: a & b, same)).drop(*[f"_key{i}" for i in range(len(keys))])
    else:
        out = test.withColumn("_fit", best.select(fit).scalar()).where(F.col("_fit").isNotNull())
    step = F.col("row_idx") - F.col("train_n") + 1
    return out.withColumn("yhat", _yhat(lambda c: F.col("_fit")[c], step, floor, damping)).drop("_fit")


def blend(forecasts: dict, weights: dict, on=("date",), y="revenue") -> DataFrame:
    """Weighted mean of the ``yhat`` of several forecasts of the same rows; a row that some of them lack takes the mean of the
    others. Weights need not add up to one; negative ones and a sum of zero are refused."""
    if set(forecasts) != set(weights) or min(weights.values()) < 0 or not sum(weights.values()):
        raise ValueError("one weight, none negative and not all zero, for each forecast")
    rows = None
    for name, f in forecasts.items():
        part = f.select(*on, y, "yhat", F.lit(float(weights[name])).alias("_w"))
        rows = part if rows is None else rows.unionByName(part)
    w = F.when(F.col("yhat").isNotNull(), F.col("_w"))
    return rows.groupBy(*on).agg(F.max(y).alias(y), F.try_divide(F.sum(F.col("yhat") * w), F.sum(w)).alias("yhat"))
