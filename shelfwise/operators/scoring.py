"""Score evaluation, thresholds, curves and campaign ranking, given scores."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions.quantiles import balanced_slices, split_running_sum


def score_counts(df: DataFrame, y="label", p="score") -> DataFrame:
    """Positives and negatives per distinct score: what every ranking measure needs."""
    return df.groupBy(F.col(p).alias("score")).agg(
        F.sum(F.when(F.col(y) == 1, 1).otherwise(0)).alias("pos"), F.sum(F.when(F.col(y) == 1, 0).otherwise(1)).alias("neg"),
        F.lit(1).alias("one"))


def ranked(df: DataFrame, y="label", p="score") -> DataFrame:
    """Cumulative positives, negatives and step number from the highest score down, over even slices of the scores."""
    c = balanced_slices(score_counts(df, y, p), "score")
    return split_running_sum(c, [], "_s", [F.desc("score")], {"pos": "tp", "neg": "fp", "one": "step"}).drop("_s", "one")


def roc_auc(df: DataFrame, y="label", p="score") -> DataFrame:
    """AUC as the share of correctly ordered pairs, ties as half; one row."""
    r = ranked(df, y, p)
    # negatives ranked below each score, plus half of those that tie
    t = r.agg(F.max("tp").alias("P"), F.max("fp").alias("N"),
              F.sum(F.col("pos") * (F.col("fp") - F.col("neg") / 2)).alias("above"))
    return t.select((1 - F.col("above") / (F.col("P") * F.col("N"))).alias("auc"))


def average_precision(df: DataFrame, y="label", p="score") -> DataFrame:
    r = ranked(df, y, p)
    return r.agg((F.sum(F.col("pos") * F.col("tp") / (F.col("tp") + F.col("fp"))) / F.sum("pos")).alias("pr_auc"))


def roc_points(df: DataFrame, y="label", p="score", points=50) -> DataFrame:
    """The ROC curve thinned to ``points`` evenly spaced score steps; starts at the origin."""
    r = ranked(df, y, p)
    tot = r.agg(F.struct(F.max("tp").alias("P"), F.max("fp").alias("N"), F.max("step").alias("steps")))
    r = r.withColumn("_t", tot.scalar())
    picks = F.transform(F.sequence(F.lit(0), F.lit(points - 1)), lambda k: F.floor(k * F.col("_t.steps") / (points - 1)))
    keep = (F.col("_t.steps") + 1 <= points) | F.array_contains(picks, F.col("step").cast("long"))
    curve = r.where(keep).select((F.col("fp") / F.col("_t.N")).alias("fpr"), (F.col("tp") / F.col("_t.P")).alias("tpr"))
    origin = df.sparkSession.range(1).select(F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"))
    return origin.unionByName(curve)


def binary_metrics(df: DataFrame, y="label", p="score", threshold=0.5) -> DataFrame:
    """Brier score and skill, confusion counts, accuracy, precision, recall and F1; one row."""
    hit, pos = F.col(p) >= threshold, F.col(y) == 1
    g = df.agg(
        F.avg((F.col(p) - F.col(y)) * (F.col(p) - F.col(y))).alias("brier"), F.avg(F.col(y).cast("double")).alias("base"),
        F.count(F.when(hit & pos, 1)).alias("tp"), F.count(F.when(hit & ~pos, 1)).alias("fp"),
        F.count(F.when(~hit & pos, 1)).alias("fn"), F.count(F.when(~hit & ~pos, 1)).alias("tn"))

    def ratio(a, b):
        return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))
    c = F.col
    return g.select(
        "brier", (1 - F.try_divide("brier", c("base") * (1 - c("base")))).alias("brier_skill"), "tp", "fp", "fn", "tn",
        ratio(c("tp") + c("tn"), c("tp") + c("tn") + c("fp") + c("fn")).alias("accuracy"), ratio(c("tp"), c("tp") + c("fp")).alias("precision"),
        ratio(c("tp"), c("tp") + c("fn")).alias("recall"), ratio(2 * c("tp"), 2 * c("tp") + c("fp") + c("fn")).alias("f1"))


def class_report(df: DataFrame, y="label", yhat="prediction") -> DataFrame:
    """Precision, recall, F1 and support per class, from the confusion counts."""
    cm = df.groupBy(F.col(y).cast("int").alias("y"), F.col(yhat).cast("int").alias("p")).agg(F.count("*").alias("n"))
    act = cm.groupBy(F.col("y").alias("class")).agg(F.sum("n").alias("support"), F.sum(F.when(F.col("y") == F.col("p"), F.col("n")).otherwise(0)).alias("tp"))
    prd = cm.groupBy(F.col("p").alias("class")).agg(F.sum("n").alias("predicted"))
    j = act.join(prd, "class", "left").withColumn("predicted", F.coalesce("predicted", F.lit(0)))
    c = F.col
    return j.select("class", "support", F.coalesce(F.try_divide(c("tp").cast("double"), c("predicted")), F.lit(0.0)).alias("precision"),
                    (c("tp") / c("support")).alias("recall"), (2 * c("tp") / (c("support") + c("predicted"))).alias("f1"))


def weighted_f1(df: DataFrame, y="label", yhat="prediction") -> DataFrame:
    return class_report(df, y, yhat).agg((F.sum(F.col("f1") * F.col("support")) / F.sum("support")).alias("f1_weighted"))


def threshold_table(df: DataFrame, y="label", p="score", lo=5, hi=94, step=1) -> DataFrame:
    """Counts, precision, recall and F1 at every threshold (in hundredths).

    Scores are first counted per threshold step they reach, so the sweep sums a
    short list instead of repeating the rows for every threshold. Thresholds that
    no score reaches have a row, too, with a precision of 0; no rows give none.
    """
    band = F.least(F.floor(F.col(p) * 100 + 1e-9), F.lit(100)).cast("int")
    c = df.groupBy(band.alias("band")).agg(F.sum(F.when(F.col(y) == 1, 1).otherwise(0)).alias("pos"), F.count("*").alias("n"))
    grid = c.agg(F.sum("pos").alias("tot")).where("tot IS NOT NULL").select("tot", F.explode(F.sequence(F.lit(lo), F.lit(hi), F.lit(step))).alias("t"))
    reach = c.withColumn("t", F.explode(F.filter(F.sequence(F.lit(lo), F.lit(hi), F.lit(step)), lambda x: x <= F.col("band"))))
    g = grid.join(reach.groupBy("t").agg(F.sum("pos").alias("tp"), F.sum(F.col("n") - F.col("pos")).alias("fp")), "t", "left").na.fill(0, ["tp", "fp"])
    g = g.withColumn("fn", F.col("tot") - F.col("tp"))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return g.select((F.col("t") / 100).alias("threshold"), "tp", "fp", "fn", F.coalesce(F.try_divide(tp.cast("double"), tp + fp), F.lit(0.0)).alias("precision"),
                    F.coalesce(F.try_divide(tp.cast("double"), tp + fn), F.lit(0.0)).alias("recall"), F.coalesce(F.try_divide(2 * tp.cast("double"), 2 * tp + fp + fn), F.lit(0.0)).alias("f1"))


def best_thresholds(table: DataFrame, min_recall=0.85, min_precision=0.35) -> DataFrame:
    """Best F1; best precision at a minimum recall; best recall at a minimum precision. Ties take the lowest threshold."""
    t = -F.col("threshold")

    def pick(value, cond, rule):
        return table.where(cond).agg(F.lit(rule).alias("rule"), F.max_by("threshold", F.struct(F.round(value, 12), t)).alias("threshold"), F.max(value).alias("value"))
    return pick("f1", F.lit(True), "f1").unionByName(pick("precision", F.col("recall") >= min_recall, "business")).unionByName(
        pick("recall", F.col("precision") >= min_precision, "recall"))


def campaign_priority(df: DataFrame, p="churn_probability", clv="predicted_clv", window="pw_label") -> DataFrame:
    """Churn chance times log value times window, scaled to 0..10."""
    d = df.withColumn("priority", F.col(p) * F.log1p(F.col(clv)) * (1 + F.col(window)))
    r = d.agg(F.struct(F.min("priority").alias("lo"), F.max("priority").alias("hi")))
    return d.withColumn("_r", r.scalar()).withColumn(
        "priority_score", 10 * (F.col("priority") - F.col("_r.lo")) / (F.col("_r.hi") - F.col("_r.lo") + 1e-9)).drop("_r")


def stratified_split(df: DataFrame, strata, key="customer_id", share=0.7, seed=42, min_size=5, bin_col=None) -> DataFrame:
    """Mark the first ``share`` of every stratum, in hash order, as train; bins below ``min_size`` go to train whole.

    The rank of a row is counted within one of 256 hash slices and offset by
    the slices before, so a large stratum is never sorted by one task.
    """
    h = F.xxhash64(F.col(key), F.lit(seed))
    d = df.withColumns({"_h": h, "_s": F.pmod(F.shiftright(h, 56), F.lit(256)).cast("int"), "_one": F.lit(1)})
    d = split_running_sum(d, list(strata), "_s", ["_h", key], {"_one": "_rk"})
    # strata are few (bins by label), so their sizes travel to the rows
    sizes = df.groupBy(*strata).agg(F.count("*").alias("_n"))
    d = d.join(F.broadcast(sizes), list(strata))
    small = F.lit(False)
    if bin_col:
        d = d.join(F.broadcast(df.groupBy(bin_col).agg(F.count("*").alias("_bn"))), bin_col)
        small = F.col("_bn") < min_size
    return d.withColumn("is_train", small | ((F.col("_rk") - 1) < F.col("_n") * share)).drop("_h", "_s", "_one", "_rk", "_n", "_bn")


def stratified_folds(df: DataFrame, label="label", key="customer_id", k=5, seed=42) -> DataFrame:
    """Fold number per row, even within each label."""
    h = F.xxhash64(F.col(key), F.lit(seed))
    d = df.withColumns({"_h": h, "_s": F.pmod(F.shiftright(h, 56), F.lit(256)).cast("int"), "_one": F.lit(1)})
    d = split_running_sum(d, [label], "_s", ["_h", key], {"_one": "_rk"})
    return d.withColumn("fold", F.pmod(F.col("_rk"), F.lit(k)).cast("int")).drop("_h", "_s", "_one", "_rk")


def overlay_status(cases: DataFrame, updates: DataFrame, key="user_id") -> DataFrame:
    """Cases with the latest valid status update applied; unknown statuses are ignored."""
    last = updates.where(F.col("new_status").isin(*S.CASE_STATUSES)).groupBy(key).agg(
        F.max_by("new_status", F.struct("ts", "seq")).alias("_new"))
    return cases.join(last, key, "left").withColumn("status", F.coalesce("_new", "status")).drop("_new")
