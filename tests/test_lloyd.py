"""K-means fits that share their passes, against plain numpy and Spark's own evaluator."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfwise.operators import clustering as KC
from shelfwise.operators import lloyd as LL
from shelfwise.operators.segments import adjusted_rand


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(3)
    x = np.vstack([rng.normal(c, 0.4, (60, 3)) for c in ((0, 0, 0), (3, 0, 1), (0, 4, 2), (5, 5, 5))])
    return np.arange(len(x)) * 7 + 1, x


@pytest.fixture(scope="module")
def frame(spark, data):
    ids, x = data
    rows = [(int(i), *map(float, v)) for i, v in zip(ids, x)]
    return KC.vectors(spark.createDataFrame(rows, "customer_id long, a double, b double, c double").repartition(3), ["a", "b", "c"])


def plain_fit(x, c, w=None, steps=50):
    w = np.ones(len(x)) if w is None else w
    for _ in range(steps):
        near = ((x[:, None] - c[None]) ** 2).sum(2).argmin(1)
        new = np.array([np.average(x[near == k], axis=0, weights=w[near == k]) if w[near == k].sum() else c[k] for k in range(len(c))])
        if np.abs(new - c).max() <= 1e-6:
            return new
        c = new
    return c


def inertia(x, c):
    return ((x[:, None] - c[None]) ** 2).sum(2).min(1).sum()


def test_fits_of_many_sizes(spark, frame, data):
    ids, x = data
    first = [x[[0, 70]], x[[0, 1, 2]], x[[0, 60, 120, 180]]]
    centres, cost = LL.fit(LL.points(frame), first)
    for f, c, i in zip(first, centres, cost):
        want = plain_fit(x, f)
        assert np.allclose(c, want, atol=1e-8) and np.isclose(i, inertia(x, want))


def test_best_start_and_labels(frame, data):
    ids, x = data
    best = LL.best_starts(LL.points(frame), [2, 4], tries=5)
    assert best[4][1] < best[2][1] and np.isclose(best[4][1], inertia(x, best[4][0]))
    got = {r["customer_id"]: r["cluster"] for r in LL.labels(LL.points(frame), best[4][0]).collect()}
    assert [len({got[int(i)] for i in part}) for part in np.split(ids, 4)] == [1] * 4 and len(set(got.values())) == 4


def test_silhouettes_equal_spark_s(frame, data):
    _, x = data
    fits = [plain_fit(x, x[[0, 70]]), plain_fit(x, x[[0, 60, 120, 180]]), x[[0, 1, 2]]]
    got = LL.silhouettes(LL.points(frame), fits)
    for c, s in zip(fits, got):
        lab = LL.labels(LL.points(frame), c)
        assert np.isclose(s, KC.silhouette(frame.join(lab, "customer_id")), atol=1e-9)


def test_bootstrap_draws():
    w = LL.bootstrap_weights(np.arange(200_000), 2, 1)
    assert abs(w.mean() - 1) < 0.01 and abs(w.var() - 1) < 0.02 and w.max() >= 7
    assert abs(np.corrcoef(w[:, 0], w[:, 1])[0, 1]) < 0.01
    assert (w == LL.bootstrap_weights(np.arange(200_000), 2, 1)).all()


def test_stability(spark, frame, data):
    """Refits and their indices, round by round, from the same weights in numpy."""
    ids, x = data
    base = plain_fit(x, x[[0, 30, 130]])
    got = {r["round"]: r["ari"] for r in LL.stability(LL.points(frame), base, rounds=6, seed=5).collect()}
    w = LL.bootstrap_weights(ids, 6, 5)
    old = ((x[:, None] - base[None]) ** 2).sum(2).argmin(1)
    for r in range(6):
        c = plain_fit(x, base, w[:, r].astype(float))
        new = ((x[:, None] - c[None]) ** 2).sum(2).argmin(1)
        t = spark.createDataFrame([(int(a), int(b), int(n)) for a, b, n in zip(old, new, w[:, r])], "a int, b int, n long")
        assert np.isclose(got[r + 1], adjusted_rand(t, weight="n").first()["ari"])
    assert len(got) == 6


def test_empty_cluster_keeps_its_centre(frame, data):
    _, x = data
    far = np.array([[0.0, 0, 0], [100.0, 100, 100]])
    centres, _ = LL.fit(LL.points(frame), [far])
    assert np.allclose(centres[0][1], far[1]) and np.allclose(centres[0][0], x.mean(0))
    assert LL.silhouettes(LL.points(frame), [far]) == [0.0]
    assert frame.where(F.lit(False)).count() == 0
