"""Split paths against brute force, with one key holding most rows, and measure invariants."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from shelfwise.functions import quantiles as QT
from shelfwise.operators import baskets as B
from shelfwise.operators import cleaning as CL
from shelfwise.operators import drift as DR
from shelfwise.operators import features as FT
from shelfwise.operators import forecast as FC
from shelfwise.operators import scoring as SC


@pytest.fixture(scope="module")
def skewed():
    rng = np.random.default_rng(3)
    key = np.where(rng.random(4000) < 0.6, 0, rng.integers(1, 40, 4000))
    val = np.round(rng.gamma(2, 10, 4000), 1)
    val[rng.random(4000) < 0.3] = 7.5
    return pd.DataFrame({"k": key, "v": val, "day": rng.integers(0, 30, 4000), "id": np.arange(4000)})


@pytest.mark.parametrize("per_key", [False, True])
@pytest.mark.parametrize("splits", [8, 100])
def test_split_quantiles(spark, skewed, per_key, splits):
    ps = [0.0, 0.2, 0.25, 0.5, 0.9, 1.0]
    q = QT.exact_quantiles(spark.createDataFrame(skewed), "v", ps, keys=["k"], splits=splits, edges_per_key=per_key)
    got = {r["k"]: r["q"] for r in q.collect()}
    for k, g in skewed.groupby("k"):
        np.testing.assert_allclose(got[k], np.quantile(g.v, ps), rtol=1e-12)


def test_split_quantiles_global_and_columns(spark, skewed):
    df = spark.createDataFrame(skewed)
    want = np.quantile(skewed.v, [0.1, 0.5])
    np.testing.assert_allclose(QT.exact_quantiles(df, "v", [0.1, 0.5]).first()["q"], want, rtol=1e-12)
    row = QT.column_quantiles(df, ["v", "day"], [0.1, 0.5]).first()
    np.testing.assert_allclose(row["v"], want, rtol=1e-12)
    np.testing.assert_allclose(row["day"], np.quantile(skewed.day, [0.1, 0.5]), rtol=1e-12)


def test_qcut_matches_pandas(spark, skewed):
    got = QT.qcut(spark.createDataFrame(skewed), {"b": "v"}, 5).toPandas().sort_values("id")
    want = pd.qcut(skewed.v, 5, labels=False, duplicates="drop")
    assert (got.b.to_numpy() == want.to_numpy()).all()


def test_split_running_sum_and_neighbor(spark, skewed):
    df = spark.createDataFrame(skewed.astype({"k": int}))
    d = skewed.sort_values(["k", "day", "id"])
    got = QT.split_running_sum(df, ["k"], "day", ["id"], {"id": "run", "day": "days"}).toPandas().set_index("id").loc[d.id]
    assert (got.run.to_numpy() == d.groupby("k").id.cumsum().to_numpy()).all()
    assert (got.days.to_numpy() == d.groupby("k").day.cumsum().to_numpy()).all()
    for ahead, shift in ((False, 1), (True, -1)):
        n = QT.split_neighbor(df, ["k"], "day", ["day", "id"], "id", "nb", ahead).toPandas().set_index("id").loc[d.id]
        want = d.groupby("k").id.shift(shift)
        assert np.array_equal(n.nb.to_numpy(dtype=float), want.to_numpy(dtype=float), equal_nan=True)


@pytest.fixture(scope="module")
def visits():
    rng = np.random.default_rng(5)
    n = 1500
    cust = np.where(rng.random(n) < 0.5, 1, rng.integers(2, 60, n))
    ts = pd.Timestamp("2010-01-01") + pd.to_timedelta(rng.integers(0, 700 * 24, n), unit="h")
    return pd.DataFrame({"customer_id": cust, "invoice_no": rng.integers(0, 900, n), "invoice_date": ts, "line_cents": rng.integers(1, 9999, n),
                         "quantity": rng.integers(1, 9, n).astype(float), "unit_price": np.round(rng.gamma(2, 3, n), 2), "stock_code": rng.integers(0, 80, n)})


def test_purchase_gaps_and_trends(spark, visits):
    df = spark.createDataFrame(visits)
    gaps = {r["customer_id"]: r for r in FT.purchase_gaps(df).collect()}
    half = {r["customer_id"]: r for r in FT.half_trends(df).collect()}
    for c, g in visits.groupby("customer_id"):
        times = np.sort(g.invoice_date.unique())
        got = gaps[c]
        assert got["n_times"] == len(times)
        if len(times) < 3:
            assert got["interval_mean"] == 0 and c not in half
            continue
        iv = (np.diff(times) // np.timedelta64(1, "D")).astype(int)
        assert got["interval_mean"] == pytest.approx(iv.mean())
        assert got["interval_std"] == pytest.approx(iv.std(), abs=1e-6)
        assert got["last_interval_ratio"] == pytest.approx(min(iv[-1] / max(iv[:-1].mean(), 1), 10))
        mid = times[len(times) // 2]
        a, b = g[g.invoice_date < mid], g[g.invoice_date >= mid]
        assert half[c]["relative_freq_trend"] == pytest.approx(min(b.invoice_no.nunique() / max(a.invoice_no.nunique(), 1), 5))
        assert half[c]["relative_spend_trend"] == pytest.approx(min(b.line_cents.sum() / max(a.line_cents.sum(), 1), 5))


def test_profile_same_on_other_partitions(spark, visits):
    df = spark.createDataFrame(visits)
    a = FT.profile_features(df).toPandas().sort_values("customer_id").reset_index(drop=True)
    b = FT.profile_features(df.repartition(7)).toPandas().sort_values("customer_id").reset_index(drop=True)
    pd.testing.assert_frame_equal(a, b[a.columns], rtol=1e-9)
    one = visits[visits.customer_id == 1]
    row = a[a.customer_id == 1].iloc[0]
    days = np.sort(one.invoice_date.dt.normalize().unique())
    assert row.avg_purchase_interval == pytest.approx(np.diff(days).astype("timedelta64[D]").astype(int).mean())
    assert row.is_night == pytest.approx((one.invoice_date.dt.hour < 6).mean())
    assert row.price_std == pytest.approx(one.unit_price.std())


def test_fences_run_in_turn(spark, visits):
    df = visits.copy()
    df.loc[::50, "quantity"] = 500.0
    df.loc[::70, "unit_price"] = 900.0
    want = df
    for c in ("quantity", "unit_price"):
        a, b = want[c].quantile([0.25, 0.75])
        want = want[(want[c] >= a - 3 * (b - a)) & (want[c] <= b + 3 * (b - a))]
    assert CL.iqr_fences(spark.createDataFrame(df)).count() == len(want)


def numpy_psi(base, cur, bins=10):
    e = np.unique(np.percentile(base, np.linspace(0, 100, bins + 1)))
    p, q = np.histogram(base, e)[0], np.histogram(cur, e)[0]
    p, q = np.clip(p / p.sum(), 1e-6, 1), np.clip(q / q.sum(), 1e-6, 1)
    return float(((p - q) * np.log(p / q)).sum())


def test_psi(spark, skewed):
    rng = np.random.default_rng(1)
    cur = rng.normal(25, 12, 3000)
    base = spark.createDataFrame(skewed[["v"]]).withColumn("c", F.lit(3.0))
    now = spark.createDataFrame(pd.DataFrame({"v": cur})).withColumn("c", F.lit(3.0))
    same = {r["feature"]: r["psi"] for r in DR.psi_long(DR.unpivot(base, ["v", "c"]), DR.unpivot(base, ["v", "c"])).collect()}
    assert same == {"v": 0.0, "c": 0.0}
    got = {r["feature"]: r["psi"] for r in DR.psi_long(DR.unpivot(base, ["v", "c"]), DR.unpivot(now, ["v", "c"])).collect()}
    assert got["v"] == pytest.approx(numpy_psi(skewed.v, cur)) and got["c"] == 0.0
    assert [r[0] for r in spark.createDataFrame([(0.1,), (0.11,), (0.25,), (0.26,)], "p double").select(DR.status_of(F.col("p"))).collect()] == [
        "stable", "warning", "warning", "drifted"]


def test_auc_and_thresholds(spark):
    rng = np.random.default_rng(2)
    s = np.round(rng.random(600), 2)
    y = (rng.random(600) < s).astype(int)
    df = spark.createDataFrame(pd.DataFrame({"label": y, "score": s}))
    pos, neg = s[y == 1], s[y == 0]
    want = np.mean([(a > neg).mean() + 0.5 * (a == neg).mean() for a in pos])
    auc = SC.roc_auc(df).first()[0]
    assert auc == pytest.approx(want)
    assert SC.roc_auc(df.withColumn("score", 1 - F.col("score"))).first()[0] == pytest.approx(1 - want)
    pts = SC.roc_points(df).orderBy("fpr", "tpr").collect()
    assert pts[0]["fpr"] == 0 and pts[-1]["tpr"] == 1 and len(pts) <= 51
    for r in SC.threshold_table(df).collect():
        hit = s >= r["threshold"] - 1e-9
        assert (r["tp"], r["fp"], r["fn"]) == (int((hit & (y == 1)).sum()), int((hit & (y == 0)).sum()), int((~hit & (y == 1)).sum()))


def test_split_is_stratified_and_stable(spark):
    df = spark.range(2000).select(F.col("id").alias("customer_id"), (F.col("id") % 3).alias("g"))
    a = SC.stratified_split(df, ["g"], bin_col="g")
    got = {r["g"]: r["s"] for r in a.groupBy("g").agg(F.avg(F.col("is_train").cast("int")).alias("s")).collect()}
    assert all(abs(v - 0.7) < 0.01 for v in got.values())
    b = SC.stratified_split(df.repartition(5), ["g"], bin_col="g")
    assert a.exceptAll(b.select(a.columns)).count() == 0
    f = SC.stratified_folds(df, "g").groupBy("g", "fold").count().toPandas()
    assert f.groupby("g")["count"].agg(lambda c: c.max() - c.min()).max() <= 1


@pytest.fixture(scope="module")
def bought():
    rng = np.random.default_rng(9)
    rows = [(b, f"i{i}") for b in range(400) for i in rng.choice(30, rng.integers(1, 7), replace=False)]
    return pd.DataFrame(rows, columns=["invoice_no", "item"])


def test_rules_against_brute_force(spark, bought):
    import itertools
    bk = B.baskets(B.basket_pairs(spark.createDataFrame(bought), "item"), top_n=12)
    got = bk.toPandas()
    assert len(got) == 400 and (got["items"].map(len) == 0).any()
    sets = [frozenset(x) for x in got["items"]]
    counts = {}
    for s in sets:
        for k in (1, 2, 3):
            for c in itertools.combinations(sorted(s), k):
                counts[c] = counts.get(c, 0) + 1
    want = {c: n for c, n in counts.items() if n >= np.ceil(0.01 * 400)}
    its = B.frequent_itemsets(bk, 0.01, 3)
    assert {tuple(r["items"]): r["freq"] for r in its.collect()} == want
    for r in B.rules_from(its, threshold=0.0).collect():
        a, c = tuple(r["antecedents"]), tuple(r["consequents"])
        both = counts[tuple(sorted(a + c))]
        assert r["confidence"] == pytest.approx(both / counts[a]) and r["confidence"] <= 1
        assert r["lift"] == pytest.approx(both * 400 / counts[a] / counts[c])
    tops = {tuple(r["items"]) for r in B.maximal_itemsets(its).collect()}
    assert tops == {c for c in want if not any(set(c) < set(d) for d in want)}


def test_rolling_and_naive(spark):
    s = pd.DataFrame({"date": pd.date_range("2020-01-07", periods=90, freq="7D").date, "revenue": np.arange(90.0) ** 1.5})
    f = FC.build_features(spark.createDataFrame(s), "weekly", drop_head=False).toPandas().sort_values("date")
    for n in (4, 8, 12):
        np.testing.assert_allclose(f[f"roll_mean_{n}"], s.revenue.rolling(n).mean(), equal_nan=True)
        np.testing.assert_allclose(f[f"roll_std_{n}"], s.revenue.rolling(n).std(), equal_nan=True)
    np.testing.assert_allclose(f["lag_12"], s.revenue.shift(12), equal_nan=True)
    safe = FC.rolling_features(spark.createDataFrame(s), "weekly", leaky=False).toPandas().sort_values("date")
    np.testing.assert_allclose(safe["roll_mean_4"], s.revenue.shift(1).rolling(4).mean(), equal_nan=True)
    h = FC.holdout(spark.createDataFrame(s), last=60)
    got = FC.seasonal_naive(h, "weekly").toPandas().sort_values("date").yhat.to_numpy()
    np.testing.assert_allclose(got, np.tile(s.revenue[:30], 2)[:60])


def test_diagnostics_match_formulas(spark):
    rng = np.random.default_rng(4)
    r = rng.gamma(2, 3, 60)
    df = spark.createDataFrame(pd.DataFrame({"date": pd.date_range("2020-01-01", periods=60).date, "revenue": r + 50, "yhat": 50 + np.arange(60) * 0.01}))
    d = FC.residual_diagnostics(df).first()
    e = r - np.arange(60) * 0.01
    c = e - e.mean()
    assert d["rho1"] == pytest.approx((c[1:] * c[:-1]).sum() / (c * c).sum())
    assert 0 <= d["normality_p"] <= 1 and d["adf_stat"] < 0
