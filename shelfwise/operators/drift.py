"""Population-stability drift: index per feature, status, model reports."""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.quantiles import exact_quantiles

EPS = 1e-6


def status_of(psi) -> Column:
    return F.when(psi <= 0.1, "stable").when(psi <= 0.25, "warning").otherwise("drifted")


def unpivot(df: DataFrame, features) -> DataFrame:
    cols = [f for f in features if f in df.columns]
    long = df.select([F.col(c).cast("double").alias(c) for c in cols]).unpivot([], cols, "feature", "value")
    return long.where("value IS NOT NULL AND NOT isnan(value) AND abs(value) < double('infinity')")


def psi_long(base: DataFrame, current: DataFrame, bins=10, open_ends=False) -> DataFrame:
    """PSI per feature of two (feature, value) frames over the base's quantile bins.

    Bins are left-closed, the last one closed on both sides; current values
    outside the base's range are dropped unless ``open_ends``. A constant
    feature, or one missing on a side, scores 0.
    """
    q = exact_quantiles(base, "value", [i / bins for i in range(bins + 1)], keys=["feature"], edges_per_key=True)
    edges = q.select("feature", F.array_sort(F.array_distinct("q")).alias("e"))
    both = base.select("feature", "value", F.lit(1).alias("b")).unionByName(current.select("feature", "value", F.lit(0).alias("b")))
    v, e = F.col("value"), F.col("e")
    n_bins = F.size("e") - 1
    # edges up to a value, one plain comparison each: compiled code, where a lambda over the array is called once an edge and row
    reached = reduce(lambda a, b: a + b, [F.when(F.get(e, F.lit(i)) <= v, 1).otherwise(0) for i in range(bins + 1)])
    # one row per watched column: a fixed list, so the edges travel to the rows
    binned = both.join(F.broadcast(edges), "feature").withColumn(
        "bin", F.greatest(F.least(reached, n_bins), F.lit(1)))
    inside = F.lit(True) if open_ends else v.between(F.get("e", F.lit(0)), F.get("e", n_bins))
    counts = binned.groupBy("feature", "bin").agg(
        F.max(n_bins).alias("n_bins"), F.count(F.when(inside & (F.col("b") == 1), 1)).alias("pb"),
        F.count(F.when(inside & (F.col("b") == 0), 1)).alias("pc"))
    per = counts.groupBy("feature").agg(
        F.max("n_bins").alias("n_bins"), F.sum("pb").alias("tb"), F.sum("pc").alias("tc"),
        F.map_from_entries(F.collect_list(F.struct("bin", F.struct("pb", "pc")))).alias("m"))

    def share(n, total):
        return F.least(F.greatest(F.coalesce(F.try_divide(n.cast("double"), total), F.lit(0.0)), F.lit(EPS)), F.lit(1.0))

    def term(i):
        cell = F.try_element_at("m", i)
        p = share(F.coalesce(cell["pb"], F.lit(0)), F.col("tb"))
        c = share(F.coalesce(cell["pc"], F.lit(0)), F.col("tc"))
        return (p - c) * F.ln(p / c)
    total = F.aggregate(F.sequence(F.lit(1), F.col("n_bins")), F.lit(0.0), lambda s, i: s + term(i))
    live = (F.col("n_bins") >= 1) & (F.col("tb") > 0)
    sides = current.groupBy("feature").agg(F.count("*").alias("_nc"))
    return per.join(sides, "feature", "left").select(
        "feature", F.when(live & (F.coalesce("_nc", F.lit(0)) > 0), total).otherwise(0.0).alias("psi"))


def psi_equal_width(train: DataFrame, test: DataFrame, value, bins=10) -> DataFrame:
    """PSI over equal-width bins of the joint range, one row."""
    v = F.col(value)
    both = train.select(v.alias("v"), F.lit(1).alias("b")).unionByName(test.select(v.alias("v"), F.lit(0).alias("b")))
    rng = both.agg(F.struct(F.min("v").alias("lo"), F.max("v").alias("hi")))
    binned = both.withColumn("_r", rng.scalar()).withColumn(
        "bin", F.least(F.floor((F.col("v") - F.col("_r.lo")) / ((F.col("_r.hi") - F.col("_r.lo")) / bins)) + 1, F.lit(bins)))
    c = binned.agg(*[F.count(F.when((F.col("bin") == i) & (F.col("b") == s), 1)).alias(f"c{s}_{i}") for i in range(1, bins + 1) for s in (0, 1)])
    tot = {s: reduce(lambda a, b: a + b, [F.col(f"c{s}_{i}") for i in range(1, bins + 1)]) for s in (0, 1)}

    def share(s, i):
        return F.col(f"c{s}_{i}") / tot[s] + F.lit(1e-10)
    return c.select(reduce(lambda a, b: a + b, [
        (share(0, i) - share(1, i)) * F.ln(share(0, i) / share(1, i)) for i in range(1, bins + 1)]).alias("psi"))


def model_report(model, psi: DataFrame) -> DataFrame:
    """Feature rows with status, and the model's mean with its own status."""
    mean = psi.agg(F.avg("psi")).scalar()
    rows = psi.select("feature", F.round("psi", 6).alias("psi"), status_of(F.col("psi")).alias("status"))
    return rows.withColumns({"model": F.lit(model), "model_psi": F.round(F.coalesce(mean, F.lit(0.0)), 6)}).withColumn(
        "model_status", status_of(F.col("model_psi")))


def monitor_features(model, base: DataFrame, current: DataFrame, features) -> DataFrame:
    return model_report(model, psi_long(unpivot(base, features), unpivot(current, features)))


def metric_shift(base: DataFrame, current: DataFrame, ratio_metrics, delta_metrics=()) -> DataFrame:
    """Shift signal per metric: |ln ratio| for errors, min(5 x difference, 1) for audit statistics."""
    j = base.select("metric_name", F.col("metric_value").alias("b")).join(
        current.select("metric_name", F.col("metric_value").alias("c")), "metric_name")
    ratio = (F.col("c") + EPS) / (F.col("b") + EPS)
    sig = F.when(F.col("metric_name").isin(*ratio_metrics), F.abs(F.ln(ratio)))
    if delta_metrics:
        sig = sig.when(F.col("metric_name").isin(*delta_metrics), F.least(F.abs(F.col("c") - F.col("b")) * 5, F.lit(1.0)))
    out = j.withColumn("psi_signal", sig).where("psi_signal IS NOT NULL")
    return out.select(F.col("metric_name").alias("feature"), F.round("b", 4).alias("baseline"), F.round("c", 4).alias("current"),
                      F.round("psi_signal", 6).alias("psi_signal"), status_of(F.col("psi_signal")).alias("status"))


def rule_drift(base: DataFrame, current: DataFrame, min_lifts=5) -> DataFrame:
    """Drift of rule support, and of lift when both sides have at least ``min_lifts`` rules."""
    enough = min(base.count(), current.count()) >= min_lifts
    cols = ["support", "lift"] if enough else ["support"]

    def side(df):
        return unpivot(df, cols).withColumn("feature", F.concat("feature", F.lit("_distribution")))
    return model_report("association", psi_long(side(base), side(current)))


def overall(models: DataFrame) -> DataFrame:
    """One row: overall status and recommendation text from (model, model_status)."""
    m = models.select("model", F.col("model_status").alias("status")).distinct()
    g = m.agg(F.array_sort(F.collect_list(F.when(F.col("status") == "drifted", F.col("model")))).alias("d"),
              F.array_sort(F.collect_list(F.when(F.col("status") == "warning", F.col("model")))).alias("w"))

    # The sentences of the recommendation.
    def many(c, a, b):
        return F.when(F.size(c) > 1, a).otherwise(b)
    d_text = F.concat(many("d", "Models ", "Model "), F.array_join("d", ", "), many("d", " show", " shows"),
                      F.lit(" significant drift (PSI > 0.25). Consider retraining."))
    w_text = F.concat(many("w", "Models ", "Model "), F.array_join("w", ", "), many("w", " are", " is"),
                      F.lit(" in warning range (0.1 < PSI ≤ 0.25). Investigate data changes."))
    text = F.concat_ws(" ", F.when(F.size("d") > 0, d_text), F.when(F.size("w") > 0, w_text))
    return g.select(
        F.when(F.size("d") > 0, "drifted").when(F.size("w") > 0, "warning").otherwise("healthy").alias("overall_status"),
        F.when(text == "", "All models are stable. No action required.").otherwise(text).alias("recommendation"))


def drift_report(models: DataFrame, baseline, production) -> DataFrame:
    """The report as one nested row, ready for JSON."""
    feats = models.groupBy("model", "model_psi", "model_status").agg(
        F.array_sort(F.collect_list(F.struct("feature", "psi", "status"))).alias("features"))
    nested = feats.agg(F.array_sort(F.collect_list(F.struct(
        "model", F.col("model_psi").alias("psi"), F.col("model_status").alias("status"), "features"))).alias("models"))
    return overall(models).withColumns({
        "baseline": F.lit(baseline), "production": F.lit(production), "models": nested.scalar(),
        "timestamp": F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss")})
