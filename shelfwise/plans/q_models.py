"""Queries that fit models (KM*, ML*, TS*); the driver checks their rows."""

from pyspark.sql import functions as F

from .. import schemas as S
from ..operators import asof as AT
from ..operators import clustering as KC
from ..operators import features as FT
from ..operators import forecast as FC
from ..operators import lloyd as LL
from ..operators import models as M
from ..operators import scoring as SC
from ..functions.quantiles import qcut
from ..session import materialize, shared_dir
from ..sources import sinks
from ..sources.canonical import CUT_DATE
from .q_features import PROF, QUINT, churn_frame, cluster_frame, lines
from .q_basics import cluster_labels
from .q_forecast import COLS, held, round_err
from .registry import query

CF = S.CLUSTER_FEATURES


def scaled(t):
    """log1p and min-max scaled cluster features as vectors."""
    d = FT.minmax_scale(materialize(cluster_frame(t)), CF, log=True)
    return materialize(KC.vectors(d.select("customer_id", *[f"u_{c}" for c in CF]), [f"u_{c}" for c in CF]))


def rows(t, data, ddl):
    return t.spark.createDataFrame(data, ddl)


_RB = ("m_quintile", "purchase_velocity", "recency_days")


@query("km4_robust_scale", "sales", "SELECT customer_id, " + ", ".join(
    f"round(({c} - (SELECT quantile_cont({c}::DOUBLE, 0.5) FROM km)) / coalesce(nullif((SELECT quantile_cont({c}::DOUBLE, 0.75) - quantile_cont({c}::DOUBLE, 0.25) FROM km), 0), 1), 6) AS r_{c}" for c in _RB) + " FROM km", PROF + ", " + QUINT)
def _(t):
    return KC.robust_scale(materialize(cluster_frame(t)), list(_RB)).select("customer_id", *[F.round(f"r_{c}", 6).alias(f"r_{c}") for c in _RB])


@query("km4_yeo_johnson")
def _(t):
    return KC.yeo_johnson(materialize(cluster_frame(t)), CF).select("customer_id", *[f"y_{c}" for c in CF])


@query("km5_outliers")
def _(t):
    return KC.isolate_outliers(scaled(t)).groupBy("is_outlier").agg(F.count("*").alias("n"))


@query("km6_k_search")
def _(t):
    return rows(t, KC.search_k(scaled(t)), "k int, silhouette double")


@query("km7_final_kmeans")
def _(t):
    d = scaled(t)
    return KC.fit_kmeans(d, 4).transform(d).select("customer_id", "cluster")


@query("km6_best_of_ten")
def _(t):
    p = materialize(LL.points(scaled(t)))
    best = LL.best_starts(p, range(3, 8))
    sil = LL.silhouettes(p, [c for c, _ in best.values()])
    return rows(t, [(k, i, s) for (k, (_, i)), s in zip(best.items(), sil)], "k int, inertia double, silhouette double")


@query("km7_best_of_ten")
def _(t):
    p = materialize(LL.points(scaled(t)))
    return LL.labels(p, LL.best_starts(p, [4])[4][0])


@query("km12_thirty_samples")
def _(t):
    p = materialize(LL.points(scaled(t)))
    return LL.stability(p, LL.best_starts(p, [4])[4][0]).agg(F.count("*").alias("rounds"), F.avg("ari").alias("ari_mean"), F.stddev_pop("ari").alias("ari_std"))


@query("km8_bisecting")
def _(t):
    lab, ok = KC.bisecting(scaled(t), 4)
    return lab.groupBy("cluster").agg(F.count("*").alias("n")).withColumn("balanced", ok.scalar())


@query("km9_mixture")
def _(t):
    d = FT.standard_scale(materialize(cluster_frame(t)), ["recency_days", "total_orders", "total_spent"])
    lab, ic = KC.mixture(materialize(KC.vectors(d, ["z_recency_days", "z_total_orders", "z_total_spent"])), 3, 3)
    return lab.groupBy("cluster").agg(F.count("*").alias("n")).withColumns({k: F.lit(v) for k, v in ic.items()})


@query("km10_silhouette")
def _(t):
    d = scaled(t)
    return rows(t, [(k, KC.silhouette(KC.fit_kmeans(d, k).transform(d))) for k in (4,)], "k int, silhouette double")


@query("km12_stability")
def _(t):
    d = scaled(t)
    lab = materialize(KC.fit_kmeans(d, 4).transform(d).select("customer_id", "cluster"))
    return rows(t, [(a,) for a in KC.stability(d, lab, 4, rounds=5)], "ari double").agg(F.avg("ari").alias("ari_mean"), F.stddev_pop("ari").alias("ari_std"))


@query("km13_hopkins")
def _(t):
    return rows(t, [(KC.hopkins(scaled(t), len(CF)),)], "hopkins double")


@query("km14_pca")
def _(t):
    return KC.project_2d(scaled(t)).select("customer_id", "x", "y")


# ---------------------------------------------------------------- churn, lifetime value, next purchase

COLS_C = FT.churn_feature_columns()


def table(t):
    """Churn features at the cut, written once and shared by the jobs of a query."""
    f = materialize(churn_frame(t))
    return qcut(f, {"tenure_bin": "tenure_days"}, 5)


def parts(t, cols=COLS_C, label="is_churn"):
    f = SC.stratified_split(table(t), ["tenure_bin", "is_churn"], bin_col="tenure_bin")
    d = materialize(M.assemble(f, cols, label, keep=["is_train"]))
    return M.with_class_weight(d.where("is_train")), d.where("NOT is_train")




@query("ml1_stratified_split", "rfm", """SELECT stratum, count(*) AS n, CAST(ceil(count(*) * 0.7::DOUBLE) AS BIGINT) AS n_train FROM fs GROUP BY 1""", "fs AS (SELECT user_id AS customer_id, f_score AS stratum FROM rfm)")
def _(t):
    d = t.rfm.select(F.col("user_id").alias("customer_id"), F.col("f_score").alias("stratum"))
    s = SC.stratified_split(d, ["stratum"], bin_col="stratum", min_size=0)
    return s.groupBy("stratum").agg(F.count("*").alias("n"), F.count(F.when(F.col("is_train"), 1)).alias("n_train"))


@query("ml2_cross_validation")
def _(t):
    tr, _te = parts(t)
    return M.cross_validate(tr.drop("weight"), lambda: M.gbt(6, 4), "GBT", k=3)


@query("ml3_boosted_churn")
def _(t):
    tr, te = parts(t)
    return M.evaluate(materialize(M.score(M.gbt(10).fit(tr), te)))


@query("ml4_soft_voting")
def _(t):
    tr, te = parts(t)
    return M.evaluate(materialize(M.soft_vote(tr, te, [M.gbt(8), M.forest(30)])))


@query("ml5_stacking")
def _(t):
    tr, te = parts(t)
    return M.evaluate(materialize(M.stack(tr, te, [M.gbt(5, 4), M.forest(15)], k=3)))


@query("ml6_calibration")
def _(t):
    tr, te = parts(t)
    out = [M.evaluate(materialize(d)).withColumn("method", F.lit(k)) for k, d in M.calibrate(tr, te, M.gbt(8)).items()]
    return KC.union_rows(out)


@query("ml7_rebalance")
def _(t):
    tr, _te = parts(t)
    return M.rebalance(tr).groupBy("label").agg(F.count("*").alias("n"))


def _scored(t):
    f = table(t)
    d = materialize(M.assemble(f, COLS_C, "is_churn"))
    model = M.gbt(10).fit(M.with_class_weight(d))
    return model, M.score(model, d)


@query("ml10_risk_counts")
def _(t):
    return M.risk_counts(_scored(t)[1])


@query("ml11_out_of_time")
def _(t):
    li = lines(t)
    model = M.gbt(8).fit(M.with_class_weight(materialize(M.assemble(FT.churn_features(li, "2000-07-31", "2001-01-31"), COLS_C, "is_churn"))))
    return M.out_of_time(li, model, COLS_C, ["2000-10-31", "2000-11-30", "2000-12-31"], "2001-06-30")


CLV_COLS = FT.churn_feature_columns(FT.CLV_EXCLUDE)


@query("ml12_clv")
def _(t):
    tr, te = parts(t, CLV_COLS, "total_spent")
    return M.clv_metrics(materialize(M.fit_clv(tr, 15).transform(te).select("customer_id", "label", "prediction")))


@query("ml13_clv_tiers")
def _(t):
    tr, te = parts(t, CLV_COLS, "total_spent")
    return M.clv_tiers(M.fit_clv(tr, 15).transform(te)).groupBy("clv_tier").agg(F.count("*").alias("n"), F.avg("predicted_clv").alias("mean_clv"))


@query("ml14_next_purchase")
def _(t):
    extra = ["days_to_label_start", "last_purchase_month", "recency_from_train_end"]
    skip = FT.CHURN_EXCLUDE[:4] + ["recency_score", "days_overdue", "overdue_score", "low_engagement_score"]
    f = FT.next_purchase(materialize(churn_frame(t)), CUT_DATE)
    f = SC.stratified_split(f, ["purchase_window"], share=0.75)
    d = materialize(M.assemble(f, FT.churn_feature_columns(skip, extra), "purchase_window", keep=["is_train", "days_to_next"]))
    got = M.next_purchase_models(d.where("is_train"), d.where("NOT is_train"), 20, 8)
    return KC.union_rows([SC.weighted_f1(v).withColumn("model", F.lit(k)) for k, v in got.items()])


@query("ml16_importances")
def _(t):
    return M.importances(t.spark, _scored(t)[0], COLS_C)


def _windows(t):
    """Feature frames at an earlier cut for training and a later one for validation, from one reading of the lines."""
    cuts = ["2000-07-31", CUT_DATE]
    both = materialize(AT.churn_features_at(lines(t), cuts, ["2000-12-31", "2001-06-30"]))
    return [both.where(F.col("cut") == F.lit(c).cast("date")) for c in cuts]


@query("ml17_feature_selection")
def _(t):
    early, late = _windows(t)
    return M.select_features(t.spark, lambda c: materialize(M.with_class_weight(M.assemble(early, c, "is_churn"))), COLS_C, M.gbt(6, 4), [20, 40],
                             lambda c: materialize(M.assemble(late, c, "is_churn")))


@query("ml18_grid_search")
def _(t):
    early, late = _windows(t)
    return M.grid_search(materialize(M.with_class_weight(M.assemble(early, COLS_C, "is_churn"))), materialize(M.assemble(late, COLS_C, "is_churn")),
                         lambda max_iter, depth: M.gbt(max_iter, depth), {"max_iter": [5, 8], "depth": [3, 5]})


@query("ml19_persist_scores")
def _(t):
    model, s = _scored(t)
    top = [r["feature"] for r in M.importances(t.spark, model, COLS_C).limit(3).collect()]
    path = shared_dir(t.spark, "churn")
    sinks.full_refresh(M.churn_rows(s, top, "GBT"), path)
    return t.spark.read.schema(S.CHURN).parquet(path)


# ---------------------------------------------------------------- forecasts with fitted models

FEATS = ["lag_1", "lag_2", "lag_4", "lag_8", "lag_12", "roll_mean_4", "roll_std_4", "roll_max_4", "roll_min_4", "month", "quarter", "week_of_year", "time_idx"]


@query("ts4_boosted_forecast")
def _(t):
    return round_err(FC.errors(M.boosted_forecast(held(t), FEATS, max_iter=15)))


@query("ts7_harmonic_blend")
def _(t):
    h = held(t)
    a, b = materialize(M.harmonic_forecast(h)), materialize(M.boosted_forecast(h, FEATS, max_iter=10))
    return KC.union_rows([FC.errors(d).withColumn("model", F.lit(n)) for n, d in (("harmonic", a), ("blend", M.blend(b, a)))])


@query("ts8_log_target")
def _(t):
    return round_err(FC.errors(M.boosted_forecast(held(t), FEATS, log=True, max_iter=15)))


@query("ts12_segment_boosted")
def _(t):
    s = materialize(FC.series(t.sales(*COLS).join(cluster_labels(t), "customer_id"), "weekly", ["cluster"]))
    out = []
    for r in s.groupBy("cluster").count().where("count >= 20").orderBy("cluster").toLocalIterator():
        h = materialize(FC.holdout(FC.build_features(s.where(F.col("cluster") == r["cluster"]), "weekly")))
        out.append(FC.errors(M.boosted_forecast(h, FEATS, max_iter=8)).withColumn("cluster", F.lit(r["cluster"])))
    return KC.union_rows(out)
