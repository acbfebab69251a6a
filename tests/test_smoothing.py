"""The smoothing fold against a plain loop, and its edges."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from shelfwise.operators import forecast as FC
from shelfwise.operators import smoothing as SM

POINTS = ((0.1, 0.0, 0.2), (0.5, 0.3, 0.1), (1.0, 1.0, 1.0))


def plain(ys, m, alpha, beta, gamma, damping=1.0):
    ys = [None if y is None or math.isnan(y) else y for y in ys]
    if len(ys) < 2 * m:
        return None
    one, two = [y for y in ys[:m] if y is not None], [y for y in ys[m:2 * m] if y is not None]
    if not one or not two:
        return None
    level = sum(one) / len(one)
    trend = (sum(two) / len(two) - level) / m
    seasons = [0.0 if y is None else y - level for y in ys[:m]]
    misses = []
    for y in ys[m:]:
        flat = level + damping * trend
        guess = flat + seasons[0]
        if y is not None:
            misses.append(y - guess)
        seen = guess if y is None else y
        before, level = level, alpha * (seen - seasons[0]) + (1 - alpha) * flat
        trend = beta * (level - before) + (1 - beta) * damping * trend
        seasons = seasons[1:] + [gamma * (seen - level) + (1 - gamma) * seasons[0]]
    return level, trend, seasons, math.sqrt(sum(e * e for e in misses) / len(misses)), sum(map(abs, misses)) / len(misses), len(misses)


def day(i):
    return dt.date(2024, 1, 1) + dt.timedelta(days=i)


SERIES = {
    "clean": [100 + 2 * i + (10, -4, -6)[i % 3] for i in range(20)],
    "holes": [None if i in (1, 9, 10) else math.nan if i == 15 else 5.0 + (i * 7 % 11) for i in range(18)],
    "short": [1.0] * 5,
    "blank start": [None, None, None] + [4.0] * 8,
    "two seasons": [3.0, 1.0, 2.0, 6.0, 5.0, 4.0],
    None: [float(i % 4) for i in range(13)],
}


@pytest.fixture(scope="module")
def series(spark):
    rows = [(k, day(i), y, "x") for k, ys in SERIES.items() for i, y in enumerate(map(lambda v: None if v is None else float(v), ys))]
    rows.append(("clean", None, 1e9, "x"))
    return spark.createDataFrame(rows, "shop string, date date, revenue double, level string").repartition(7)


@pytest.mark.parametrize("damping", [1.0, 0.9])
def test_every_grid_point_is_that_of_a_plain_loop(series, damping):
    got = {(r["shop"], r["alpha"], r["beta"], r["gamma"]): r for r in SM.level_trend_season(series, 3, ["shop"], grid=POINTS, damping=damping).collect()}
    want = {(k, *p): f for k, ys in SERIES.items() for p in POINTS if (f := plain(ys, 3, *p, damping))}
    assert set(got) == set(want) and {k[0] for k in want} == {"clean", "holes", "two seasons", None}
    for k, (level, trend, seasons, rmse, mae, n) in want.items():
        r = got[k]
        assert [r["level"], r["trend"], *r["seasons"], r["rmse"], r["mae"]] == pytest.approx([level, trend, *seasons, rmse, mae], abs=1e-9)
        assert r["counted"] == n and r["periods"] == len(SERIES[k[0]]) and r["last_date"] == day(len(SERIES[k[0]]) - 1)


def test_exact_series_goes_on_and_forecasts_keep_the_floor(series):
    fits = SM.level_trend_season(series.where("shop = 'clean'"), 3, ["shop"])
    exact = SM.least_error(SM.level_trend_season(series.where("shop = 'clean'"), 3, ["shop"], grid=[(0.0, 0.0, 0.0)]), ["shop"])
    # the mean of the first season belongs to its middle, one period before its end: the trend is exact, the level one step low
    assert [round(r["yhat"] - (100 + 2 * i + (10, -4, -6)[i % 3]), 9) for i, r in zip(range(20, 29), SM.ahead(exact, 9).orderBy("step").collect())] == [
        round(e, 9) for e in _first_offsets(9)]
    best = SM.least_error(fits, ["shop"]).first()
    assert best["rmse"] == min(r["rmse"] for r in fits.collect())
    low = exact.withColumn("level", F.lit(-1e6))
    assert {r["yhat"] for r in SM.ahead(low, 4).collect()} == {0.0}
    assert min(r["yhat"] for r in SM.ahead(low, 4, floor=None).collect()) < -9e5
    damped = SM.ahead(exact, 3, damping=0.5, floor=None).orderBy("step").collect()
    e = exact.first()
    assert [r["yhat"] for r in damped] == pytest.approx([e["level"] + d * e["trend"] + x for d, x in zip((0.5, 0.75, 0.875), e["seasons"])])


def _first_offsets(n):
    level, trend, seasons = plain(SERIES["clean"], 3, 0.0, 0.0, 0.0)[:3]
    return [level + (h + 1) * trend + seasons[h % 3] - (100 + 2 * (20 + h) + (10, -4, -6)[(20 + h) % 3]) for h in range(n)]


def test_holdout_by_series_and_without_keys(series):
    df = FC.holdout(series.where("date IS NOT NULL"), ["shop"], last=4)
    got = {(r["shop"], r["date"]): r["yhat"] for r in SM.smoothed_holdout(df, 3, ["shop"], grid=POINTS).collect()}
    assert {k[0] for k in got} == {"clean", "holes", None}
    for k in ("clean", "holes", None):
        train = SERIES[k][:-4]
        fits = [(f[3], p, f) for p in POINTS if (f := plain(train, 3, *p))]
        level, trend, seasons = min(fits)[2][:3]
        for h in range(4):
            assert got[k, day(len(train) + h)] == pytest.approx(max(0.0, level + (h + 1) * trend + seasons[h % 3]))
    alone = FC.holdout(series.where("shop = 'clean' AND date IS NOT NULL"), last=4)
    assert sorted(r["yhat"] for r in SM.smoothed_holdout(alone, 3, grid=POINTS).collect()) == pytest.approx(sorted(v for k, v in got.items() if k[0] == "clean"))


def test_blend_takes_rows_that_one_forecast_lacks(spark):
    a = spark.createDataFrame([(day(0), 10.0, 8.0), (day(1), 20.0, None), (day(2), 30.0, 33.0)], "date date, revenue double, yhat double")
    b = spark.createDataFrame([(day(0), 10.0, 12.0), (day(1), 20.0, 18.0)], "date date, revenue double, yhat double")
    rows = {r["date"]: (r["revenue"], r["yhat"]) for r in SM.blend({"a": a, "b": b}, {"a": 3, "b": 1}).collect()}
    assert rows == {day(0): (10.0, 9.0), day(1): (20.0, 18.0), day(2): (30.0, 33.0)}
    for bad in ({"a": 1}, {"a": -1, "b": 2}, {"a": 0, "b": 0}):
        with pytest.raises(ValueError):
            SM.blend({"a": a, "b": b}, bad)


def test_empty_and_odd_arguments(series):
    none = series.where("shop = 'nowhere'")
    assert SM.level_trend_season(none, 3, ["shop"]).count() == 0
    assert SM.least_error(SM.level_trend_season(none, 3)).count() == 0
    assert SM.ahead(SM.least_error(SM.level_trend_season(none, 3)), 5).count() == 0
    with pytest.raises(ValueError):
        SM.level_trend_season(series, 0)
