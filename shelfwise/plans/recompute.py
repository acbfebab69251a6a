"""The full recompute: each stage reads frames, writes its result tables and hands on what it wrote.

Order: profile -> segments -> churn, forecast, rules. Result tables are parquet
folders under ``folder``; a stage whose table exists is skipped unless ``force``.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions.quantiles import qcut
from ..operators import baskets as B
from ..operators import cleaning as CL
from ..operators import clustering as KC
from ..operators import features as FT
from ..operators import forecast as FC
from ..operators import models as M
from ..operators import rfm as R
from ..operators import scoring as SC
from ..operators import segments as SG
from ..session import materialize
from ..sources import folders, readers, sinks


def _stage(spark, path, build, force):
    """Write ``build()`` to ``path`` unless a finished table is there already; always read it back. What a failed run left
    there is written anew."""
    if force or not folders.finished(spark, path):
        sinks.full_refresh(build(), path)
    return spark.read.parquet(path)


def metric_rows(spark, model, values: dict) -> DataFrame:
    """Metric rows of one model; a handful of scalars."""
    rows = [(model, k, float(v), f"{v:.4f}") for k, v in values.items()]
    return spark.createDataFrame(rows, "model_name string, metric_name string, metric_value double, detail string").withColumn(
        "created_at", F.current_timestamp())


def recompute(lines: DataFrame, folder, cut_date, item="brand", horizon=12, force=False, min_cluster=50) -> dict:
    """Run all stages over cleaned invoice lines and return the result tables by name.

    ``lines`` needs customer_id, invoice_no, stock_code, quantity, unit_price,
    line_cents, invoice_date and the ``item`` column. ``min_cluster``: customers that
    a first-fit cluster needs so as not to count as outliers.
    """
    spark = lines.sparkSession

    def stage(name, build):
        return _stage(spark, f"{folder}/{name}", build, force)

    lines = materialize(lines)  # every stage reads the joined lines, so the join runs once
    profile = stage("features_profile", lambda: FT.churn_prob_group(materialize(FT.profile_features(lines))))
    rfm = stage("rfm_profile", lambda: R.rfm_from_profile(profile))

    scaled = FT.minmax_scale(materialize(FT.cluster_features(profile)), S.CLUSTER_FEATURES, log=True)
    cols = [f"u_{c}" for c in S.CLUSTER_FEATURES]
    labels = stage("cluster_labels", lambda: KC.segment_customers(scaled.select("customer_id", *cols), cols, min_size=min_cluster)[0])
    tagged = materialize(profile.join(labels, "customer_id"))
    profiles = stage("cluster_profiles", lambda: SG.label_profiles(SG.cluster_profiles(tagged), tagged))
    segments = stage("rfm_analysis", lambda: SG.write_segments(rfm.drop("segment"), labels, profiles))

    fenced = materialize(CL.iqr_fences(lines))
    churn_table = stage("features_churn", lambda: FT.next_purchase(FT.churn_features(fenced, cut_date), cut_date))
    use = FT.churn_feature_columns()
    split = SC.stratified_split(qcut(churn_table, {"tenure_bin": "tenure_days"}, 5), ["tenure_bin", "is_churn"], bin_col="tenure_bin")
    data = materialize(M.assemble(split, use, "is_churn", keep=["is_train"]))
    model = M.gbt().fit(M.with_class_weight(data.where("is_train")))
    test = materialize(M.score(model, data.where("NOT is_train")).select("label", "score"))
    quality = M.evaluate(test).first().asDict()
    best = {r["rule"]: r["threshold"] for r in SC.best_thresholds(materialize(SC.threshold_table(test))).toLocalIterator()}
    threshold = best.get("business") or best.get("f1") or 0.5
    top = [r["feature"] for r in M.importances(spark, model, use).limit(3).toLocalIterator()]
    churn = stage("churn_predictions", lambda: M.churn_rows(M.score(model, data), top, "GBT", threshold))

    weekly = stage("series_weekly", lambda: FC.series(fenced, "weekly"))
    forecast = stage("sales_predictions", lambda: FC.linear_projection(FC.series(lines, "weekly"), horizon))
    held = materialize(FC.holdout(FC.build_features(weekly, "weekly")))
    naive = FC.errors(FC.seasonal_naive(held, "weekly")).first()

    rules = stage("rules_global", lambda: B.mine_rules(lines, item, ladder=True))
    codes = stage("rules_code", lambda: B.mine_rules(lines, "stock_code", ladder=True))
    empty = spark.createDataFrame([], S.RULES).withColumns({"cluster": F.lit(0), "min_support": F.lit(0.0)})
    by_cluster = stage("rules_cluster", lambda: B.cluster_rules(lines, labels, item) or empty)
    stored = stage("association_rules", lambda: B.union_rules(rules, codes, by_cluster))

    shown = {k: quality[k] for k in ("auc", "pr_auc", "f1", "precision", "recall", "brier_skill") if quality[k] is not None}
    new = metric_rows(spark, "Churn", {**{f"test_{k}": v for k, v in shown.items()}, "optimal_threshold": threshold})
    new = new.unionByName(metric_rows(spark, "SalesForecast", {"best_smape": naive["smape"], "best_mae": naive["mae"]}))
    new = new.unionByName(metric_rows(spark, "Association", {"global_rules_count": rules.count(), "stockcode_rules_count": codes.count()}))
    new = new.unionByName(metric_rows(spark, "Clustering", {"K": profiles.where("cluster <> 999").count()}))
    # the upsert reads the table it replaces, so the merged rows are written elsewhere first
    old = readers.read_artifact(spark, f"{folder}/model_metrics", S.METRICS)
    merged = materialize(sinks.upsert_metrics(old, new.select(*S.METRICS.names)))
    sinks.full_refresh(merged, f"{folder}/model_metrics")
    return {"features_profile": profile, "rfm_analysis": segments, "cluster_profiles": profiles, "churn_predictions": churn,
            "sales_predictions": forecast, "association_rules": stored, "model_metrics": merged}
