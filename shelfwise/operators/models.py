"""Churn, lifetime-value and next-purchase models on Spark ML.

Frames are materialised feature tables keyed by ``customer_id``. Small results
of a fit (importances, metrics) become frames with one row per feature or model.
"""

import itertools

from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, IsotonicRegression, LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.quantiles import qcut
from ..session import materialize
from . import forecast as FC
from . import scoring as SC
from .asof import churn_features_at
from .cleaning import fill_features

ID = "customer_id"


def assemble(df: DataFrame, cols, label, keep=()) -> DataFrame:
    """Key, label, kept columns and the feature vector; nulls and infinities become 0."""
    d = fill_features(df, cols)
    d = VectorAssembler(inputCols=list(cols), outputCol="features").transform(d)
    return d.select(ID, F.col(label).cast("double").alias("label"), *keep, "features")


def with_class_weight(df: DataFrame) -> DataFrame:
    """Positives weigh as much as negatives in total."""
    r = df.agg(F.avg("label")).scalar()
    return df.withColumn("_r", r).withColumn("weight", F.when(F.col("label") == 1, F.coalesce(F.try_divide(1 - F.col("_r"), F.col("_r")), F.lit(1.0))).otherwise(1.0)).drop("_r")


def rebalance(df: DataFrame, seed=42) -> DataFrame:
    """Under-sample the larger class by hash, so that both are about equal."""
    c = df.agg(F.struct(F.sum("label").alias("p"), (F.count("*") - F.sum("label")).alias("n"))).scalar()
    u = F.pmod(F.xxhash64(ID, F.lit(seed)), F.lit(1_000_000)) / 1_000_000
    d = df.withColumn("_c", c)
    own = F.when(F.col("label") == 1, F.col("_c.p")).otherwise(F.col("_c.n"))
    return d.where(u < F.least("_c.p", "_c.n") / own).drop("_c")


def gbt(max_iter=20, depth=5, weight="weight", seed=42):
    return GBTClassifier(maxIter=max_iter, maxDepth=depth, stepSize=0.1, weightCol=weight, seed=seed)


def forest(trees=40, depth=6, weight="weight", seed=42):
    return RandomForestClassifier(numTrees=trees, maxDepth=depth, weightCol=weight, seed=seed)


def score(model, df: DataFrame, out="score") -> DataFrame:
    s = model.transform(df).withColumn(out, F.get(vector_to_array("probability"), F.lit(1)))
    return s.drop("rawPrediction", "probability", "prediction")


def evaluate(scored: DataFrame, p="score") -> DataFrame:
    """All measures of one scored frame in one row."""
    s = scored.select("label", F.col(p).alias("score"))
    m = SC.binary_metrics(s)
    return m.withColumns({"auc": SC.roc_auc(s).scalar(), "pr_auc": SC.average_precision(s).scalar()}).select(
        "auc", "pr_auc", "brier", "brier_skill", "f1", "precision", "recall", "accuracy")


def cross_validate(df: DataFrame, make, name, k=5, seed=42) -> DataFrame:
    """Mean and deviation of the measures over stratified folds."""
    d = materialize(SC.stratified_folds(with_class_weight(df), "label", ID, k, seed))
    rows = None
    for f in range(k):
        e = evaluate(materialize(score(make().fit(d.where(F.col("fold") != f)), d.where(F.col("fold") == f)).select("label", "score")))
        e = materialize(e.select("f1", "auc", "pr_auc", "brier"))
        rows = e if rows is None else rows.unionByName(e)
    return rows.agg(F.lit(name).alias("model"), *[g(c).alias(f"{c}_{t}") for c in ("f1", "auc", "pr_auc", "brier") for t, g in (("mean", F.avg), ("std", F.stddev_pop))])


def soft_vote(train: DataFrame, test: DataFrame, makers) -> DataFrame:
    """Mean of the members' probabilities."""
    d = test
    for i, m in enumerate(makers):
        d = score(m.fit(train), d, f"s{i}")
    return d.withColumn("score", sum(F.col(f"s{i}") for i in range(len(makers))) / len(makers)).drop(*[f"s{i}" for i in range(len(makers))])


def stack(train: DataFrame, test: DataFrame, makers, k=5, seed=42) -> DataFrame:
    """Out-of-fold scores of the members feed a logistic model; members refitted on all rows score the test."""
    d = materialize(SC.stratified_folds(train, "label", ID, k, seed))
    names = [f"s{i}" for i in range(len(makers))]
    oof = None
    for f in range(k):
        part = d.where(F.col("fold") == f)
        for n, m in zip(names, makers):
            part = score(m.fit(d.where(F.col("fold") != f)), part, n)
        part = part.select(ID, "label", *names)
        oof = part if oof is None else oof.unionByName(part)
    meta_in = VectorAssembler(inputCols=names, outputCol="features")
    meta = LogisticRegression(maxIter=50).fit(meta_in.transform(materialize(oof)))
    t = test
    for n, m in zip(names, makers):
        t = score(m.fit(train), t, n)
    return score(meta, meta_in.transform(t.drop("features")), "score").drop(*names)


def calibrate(train: DataFrame, test: DataFrame, maker, seed=42):
    """Raw, isotonic and Platt scores of the test rows; calibrators learn on a held-out third."""
    d = materialize(SC.stratified_folds(train, "label", ID, 3, seed))
    m = maker.fit(d.where("fold <> 0"))
    cal = materialize(score(m, d.where("fold = 0")).select("label", "score"))
    t = materialize(score(m, test).select(ID, "label", "score"))
    iso = IsotonicRegression(featuresCol="score", labelCol="label", predictionCol="p").fit(cal)
    v = VectorAssembler(inputCols=["score"], outputCol="features")
    platt = LogisticRegression(maxIter=50).fit(v.transform(cal))
    return {"raw": t, "isotonic": iso.transform(t).select(ID, "label", F.col("p").alias("score")),
            "platt": score(platt, v.transform(t), "cal").select(ID, "label", F.col("cal").alias("score"))}


def importances(spark, model, cols) -> DataFrame:
    """Feature importances, largest first; one row per feature."""
    rows = [(c, float(v)) for c, v in zip(cols, model.featureImportances.toArray())]
    return spark.createDataFrame(rows, "feature string, importance double").orderBy(F.desc("importance"), "feature")


def risk_counts(scored: DataFrame, high=0.7, medium=0.4) -> DataFrame:
    p = F.col("score")
    return scored.agg(F.count(F.when(p >= high, 1)).alias("high"), F.count(F.when((p >= medium) & (p < high), 1)).alias("medium"),
                      F.count(F.when(p < medium, 1)).alias("low"))


def out_of_time(lines: DataFrame, model, cols, cuts, label_end) -> DataFrame:
    """AUC per cut, with the full feature set as of that cut; all cuts come from one reading of the lines."""
    f = churn_features_at(lines, cuts, label_end)
    s = materialize(score(model, materialize(assemble(f, cols, "is_churn", keep=["cut"]))).select("cut", "label", "score"))
    rows = None
    for cut in cuts:
        one = s.where(F.col("cut") == F.lit(cut).cast("date"))
        r = one.agg(F.lit(cut).alias("cut_date"), F.count("*").alias("n"), F.avg("label").alias("churn_rate")).withColumn("auc", SC.roc_auc(one).scalar())
        rows = r if rows is None else rows.unionByName(r)
    return rows


def select_features(spark, train: DataFrame, cols, maker, keep_counts, evaluate_on) -> DataFrame:
    """Refit on the most important features for each count and measure on later data.

    ``train(cols)`` and ``evaluate_on(cols)`` give assembled frames for a feature list.
    """
    first = maker.fit(train(cols))
    order = [r["feature"] for r in importances(spark, first, cols).collect()]
    rows = None
    for k in keep_counts:
        use = order[:k]
        s = materialize(score(maker.fit(train(use)), evaluate_on(use)).select("label", "score"))
        r = SC.roc_auc(s).select(F.lit(k).alias("k"), "auc", F.lit(",".join(use[:3])).alias("top3"))
        rows = r if rows is None else rows.unionByName(r)
    return rows


def grid_search(train: DataFrame, later: DataFrame, make, grid: dict) -> DataFrame:
    """Fit every combination on the earlier cut and rank by AUC on the later one."""
    keys, rows = sorted(grid), None
    for combo in itertools.product(*[grid[k] for k in keys]):
        params = dict(zip(keys, combo))
        s = materialize(score(make(**params).fit(train), later).select("label", "score"))
        r = SC.roc_auc(s).select(*[F.lit(params[k]).alias(k) for k in keys], "auc")
        rows = r if rows is None else rows.unionByName(r)
    return rows


def fit_clv(train: DataFrame, max_iter=20):
    """Boosted trees on log1p spend; ``label`` holds the spend."""
    return GBTRegressor(maxIter=max_iter, maxDepth=5, stepSize=0.1, seed=42).fit(train.withColumn("label", F.log1p("label")))


def clv_metrics(scored: DataFrame) -> DataFrame:
    """R2 on the log scale; median APE, MAE and RMSE in money."""
    s = scored.select(F.col("label").alias("y"), F.expm1("prediction").alias("p"), F.log1p("label").alias("ly"), F.col("prediction").alias("lp"))
    m = s.agg((1 - F.sum(F.pow(F.col("ly") - F.col("lp"), 2)) / (F.var_pop("ly") * F.count("*"))).alias("r2"),
              F.avg(F.abs(F.col("y") - F.col("p"))).alias("mae"), F.sqrt(F.avg(F.pow(F.col("y") - F.col("p"), 2))).alias("rmse"))
    return m.withColumn("median_ape", FC.median_ape(s, "y", "p").scalar())


def clv_tiers(scored: DataFrame) -> DataFrame:
    d = materialize(scored.select(ID, F.expm1("prediction").alias("predicted_clv")))
    tiers = F.array(*[F.lit(t) for t in ("Low", "Mid", "High", "Premium")])
    return qcut(d, {"_b": "predicted_clv"}, 4).withColumn("clv_tier", F.get(tiers, F.col("_b"))).drop("_b")


def next_purchase_models(train: DataFrame, test: DataFrame, trees=30, max_iter=15):
    """Regression to days then bins, against balanced classes; returns both scored frames and their weighted F1."""
    reg = GBTRegressor(maxIter=max_iter, maxDepth=5, labelCol="days_to_next", seed=42).fit(train)
    d = F.col("prediction")
    by_days = materialize(reg.transform(test).withColumn("prediction", F.when(d <= 30, 0).when(d <= 90, 1).otherwise(2)).select(ID, "label", "prediction"))
    sizes = train.groupBy("label").agg(F.count("*").alias("_n"))
    n = train.agg(F.count("*")).scalar()
    balanced = train.join(F.broadcast(sizes), "label").withColumn("_all", n).withColumn("weight", F.col("_all") / (3 * F.col("_n")))
    cls = RandomForestClassifier(numTrees=trees, maxDepth=6, weightCol="weight", seed=42).fit(balanced)
    by_class = materialize(cls.transform(test).select(ID, "label", F.col("prediction").cast("int").alias("prediction")))
    return {"regression": by_days, "multiclass": by_class}


def churn_rows(scored: DataFrame, top_features, model_name, threshold=0.5) -> DataFrame:
    """Result rows: rounded score, flag, top features as JSON, case status."""
    return scored.select(
        F.col(ID).alias("user_id"), F.round("score", 4).alias("churn_prob"), (F.col("score") >= threshold).alias("is_churn_risk"),
        F.to_json(F.array(*[F.lit(f) for f in top_features])).alias("top_features"), F.lit(model_name).alias("model_name"), F.lit("pending").alias("status"))


# ------------------------------------------------------------------ forecasts with fitted models


def boosted_forecast(held: DataFrame, cols, y="revenue", log=False, max_iter=30) -> DataFrame:
    """Boosted trees with age-weighted training rows; forecasts are floored at 0."""
    d = FC.decay_weights(held).withColumn("_y", F.log1p(y) if log else F.col(y).cast("double"))
    d = VectorAssembler(inputCols=list(cols), outputCol="features").transform(d.na.fill(0.0, list(cols)))
    m = GBTRegressor(maxIter=max_iter, maxDepth=5, stepSize=0.1, labelCol="_y", weightCol="weight", seed=42).fit(d.where("NOT is_test"))
    p = F.expm1("prediction") if log else F.col("prediction")
    return m.transform(d.where("is_test")).withColumn("yhat", F.greatest(p, F.lit(0.0))).drop("features", "prediction", "_y", "weight")


def harmonic_forecast(held: DataFrame, y="revenue", periods=(365.25,), orders=3) -> DataFrame:
    """Trend plus yearly sine and cosine terms by linear regression."""
    x = F.datediff("date", F.lit("1995-01-01").cast("date"))
    terms = {"t": x / 365.25}
    for p in periods:
        for k in range(1, orders + 1):
            terms[f"s{k}_{int(p)}"] = F.sin(2 * F.pi() * k * x / p)
            terms[f"c{k}_{int(p)}"] = F.cos(2 * F.pi() * k * x / p)
    d = VectorAssembler(inputCols=list(terms), outputCol="features").transform(held.withColumns(terms).withColumn("_y", F.col(y).cast("double")))
    m = LinearRegression(labelCol="_y", regParam=0.0).fit(d.where("NOT is_test"))
    return m.transform(d.where("is_test")).withColumn("yhat", F.greatest("prediction", F.lit(0.0))).drop("features", "prediction", "_y", *terms)


def blend(a: DataFrame, b: DataFrame, weight=0.6) -> DataFrame:
    return a.join(b.select("date", F.col("yhat").alias("_b")), "date").withColumn("yhat", F.col("yhat") * weight + F.col("_b") * (1 - weight)).drop("_b")
