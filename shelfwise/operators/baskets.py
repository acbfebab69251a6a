"""Market-basket mining: baskets, frequent itemsets, rules and their uses."""

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as X
from ..functions.quantiles import exact_quantiles
from ..session import materialize

def rule_order():
    return [F.desc("lift"), F.desc("confidence"), F.asc("antecedents"), F.asc("consequents")]


def basket_pairs(lines: DataFrame, item, basket="invoice_no") -> DataFrame:
    """Distinct (basket, item): the presence matrix in sparse form."""
    return lines.select(F.col(basket).alias("basket"), F.col(item).cast("string").alias("item")).distinct()


def item_frequency(pairs: DataFrame) -> DataFrame:
    """Baskets per item and their share of all baskets in percent."""
    n = pairs.agg(F.count_distinct("basket")).scalar()
    return pairs.groupBy("item").agg(F.count("*").alias("baskets")).withColumn("support_pct", F.col("baskets") * 100.0 / n)


def top_items(pairs: DataFrame, n) -> DataFrame:
    return pairs.groupBy("item").agg(F.count("*").alias("_f")).orderBy(F.desc("_f"), "item").limit(n).select("item")


def baskets(pairs: DataFrame, top_n=200) -> DataFrame:
    """One row per basket with its items among the ``top_n`` most frequent.

    A basket that loses all its items stays as an empty array, so it counts in
    the support denominator. An array holds at most ``top_n`` items.
    """
    keep = F.broadcast(top_items(pairs, top_n).withColumn("_k", F.lit(True)))
    kept = pairs.join(keep, "item", "left").withColumn("_i", F.when(F.col("_k"), F.col("item")))
    return kept.groupBy("basket").agg(F.array_sort(F.collect_set("_i")).alias("items"))


def itemset_index(bk: DataFrame) -> DataFrame:
    """The baskets turned round: per block of baskets its items and, for each, the bitmap of the block's baskets that hold it.

    A bitmap has 32,768 places, and a row at most one per item of the list that ``baskets`` was given. A written table.
    """
    numbered = bk.select(F.monotonically_increasing_id().alias("no"), "items")  # before the items are taken apart
    lines = numbered.select("no", F.explode("items").alias("item"))
    bits = lines.groupBy(F.bitmap_bucket_number("no").alias("block"), "item").agg(F.bitmap_construct_agg(F.bitmap_bit_position("no")).alias("bits"))
    return materialize(bits.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("item", "bits"))).alias("held")))


def _candidates(sets, k):
    """Sorted tuples of k items whose parts of k - 1 items are all among the sorted tuples ``sets``."""
    have, by_prefix = set(sets), {}
    for s in sorted(have):
        by_prefix.setdefault(s[:-1], []).append(s[-1])
    out = []
    for prefix, ends in by_prefix.items():
        for i, a in enumerate(ends):
            rest = [b for b in ends[i + 1:] if all((*prefix[:d], *prefix[d + 1:], a, b) in have for d in range(k - 2))]
            if rest:
                out.append(((*prefix, a), rest))
    return out


def _counted(index: DataFrame, candidates) -> DataFrame:
    """Baskets that hold each candidate: (items, freq). Bitmaps are joined by AND block by block; a task sends its sums once."""
    schema = "items array<string>, freq long"

    def run(batches):
        sums = [np.zeros(len(ends), np.int64) for _, ends in candidates]
        for b in batches:
            for held in b.column("held"):
                bits = {h["item"]: np.frombuffer(h["bits"], np.uint64) for h in held.as_py()}
                for (prefix, ends), total in zip(candidates, sums):
                    if all(i in bits for i in prefix):
                        here = [j for j, e in enumerate(ends) if e in bits]
                        if here:
                            common = np.bitwise_and.reduce([bits[i] for i in prefix])
                            total[here] += np.bitwise_count(np.stack([bits[ends[j]] for j in here]) & common).sum(axis=1, dtype=np.int64)
        found = [([*p, e], int(n)) for (p, ends), total in zip(candidates, sums) for e, n in zip(ends, total) if n]
        if found:
            yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.list_(pa.string())), pa.array([f[1] for f in found], pa.int64())], ["items", "freq"])
    return index.mapInArrow(run, schema).groupBy("items").agg(F.sum("freq").alias("freq"))


def frequent_itemsets(bk: DataFrame, min_support=None, max_len=3, min_count=None, index=None) -> DataFrame:
    """Itemsets up to ``max_len`` with their count and the number of baskets, by a share of the baskets or by a count of them.

    Level by level over the item bitmaps: a candidate's parts are all frequent, and nothing longer than ``max_len`` is looked
    at. The sets of all levels but the last make the next candidates and pass through the driver; with the item list of
    ``baskets`` they are at most (top_n choose max_len - 1). ``index`` is an ``itemset_index`` to use again.
    """
    spark, n = bk.sparkSession, bk.count()
    least = max(1, min_count if min_count is not None else math.ceil(min_support * n))
    index = itemset_index(bk) if index is None else index
    one = index.select(F.explode("held").alias("h")).groupBy(F.col("h.item").alias("item")).agg(F.sum(F.bitmap_count("h.bits")).alias("freq"))
    level = [((r["item"],), r["freq"]) for r in one.where(F.col("freq") >= least).toLocalIterator()] if max_len > 0 else []
    found, last = list(level), None
    for k in range(2, max_len + 1):
        candidates = _candidates([s for s, _ in level], k)
        if not candidates:
            break
        counted = _counted(index, candidates).where(F.col("freq") >= least)
        if k == max_len:
            last = counted
        else:
            level = [(tuple(r["items"]), r["freq"]) for r in counted.toLocalIterator()]
            found += level
    sets = spark.createDataFrame([(list(s), f) for s, f in found], "items array<string>, freq long")
    return (sets if last is None else sets.unionByName(last)).withColumn("n", F.lit(n).cast("long"))


def itemsets_with_ladder(bk: DataFrame, min_support, max_len=3, floor=0.005, enough=10):
    """Lower the support until there are ``enough`` itemsets; returns them and the support used."""
    index = itemset_index(bk)
    for ms in (min_support, min_support / 2, min_support / 4, floor):
        sets = materialize(frequent_itemsets(bk, ms, max_len, index=index))
        if sets.count() >= enough:
            break
    return sets, ms


def rules_from(sets: DataFrame, metric="confidence", threshold=0.1) -> DataFrame:
    """Every split of every itemset into two non-empty parts, filtered by a metric."""
    items = F.col("items")
    splits = sets.where(F.size("items") > 1).select(
        "items", "freq", "n", F.explode(F.expr("sequence(1, CAST(pow(2, size(items)) - 2 AS INT))")).alias("mask"))
    side = "filter(items, (x, i) -> (shiftright(mask, i) & 1) = {})"
    splits = splits.withColumn("antecedents", F.expr(side.format(1))).withColumn("consequents", F.expr(side.format(0)))
    a = sets.select(items.alias("antecedents"), F.col("freq").alias("fa"))
    c = sets.select(items.alias("consequents"), F.col("freq").alias("fc"))
    conf = F.col("freq") / F.col("fa")
    r = splits.join(a, "antecedents").join(c, "consequents").select(
        "antecedents", "consequents", (F.col("freq") / F.col("n")).alias("support"), conf.alias("confidence"),
        (conf / (F.col("fc") / F.col("n"))).alias("lift"))
    return r.where(F.col(metric) >= threshold)


def mine_rules(lines: DataFrame, item, top_n=200, min_support=0.015, max_len=3, metric="confidence", threshold=0.1,
               ladder=False, min_count=None) -> DataFrame:
    """Baskets, itemsets and rules in one call."""
    bk = materialize(baskets(basket_pairs(lines, item), top_n))
    sets = itemsets_with_ladder(bk, min_support, max_len)[0] if ladder else materialize(frequent_itemsets(bk, min_support, max_len, min_count))
    return rules_from(sets, metric, threshold)


def format_rules(rules: DataFrame, k=20) -> DataFrame:
    """The k strongest rules, rounded for output."""
    return rules.orderBy(*rule_order()).limit(k).select(
        "antecedents", "consequents", F.round("support", 4).alias("support"), F.round("confidence", 4).alias("confidence"),
        F.round("lift", 2).alias("lift"))


def label_codes(rules: DataFrame, lines: DataFrame, code="stock_code", name="description") -> DataFrame:
    """Single-item code rules with the description of each side."""
    d = lines.groupBy(F.col(code).cast("string").alias("_c")).agg(F.min(name).alias("_n"))
    r = rules.where("size(antecedents) = 1 AND size(consequents) = 1").withColumns(
        {"code": F.get("antecedents", F.lit(0)), "other": F.get("consequents", F.lit(0))})
    a = d.select(F.col("_c").alias("code"), F.col("_n").alias("description"))
    b = d.select(F.col("_c").alias("other"), F.col("_n").alias("other_description"))
    return r.join(a, "code", "left").join(b, "other", "left")


def seasonal_rules(lines: DataFrame, item, months=(10, 11, 12), top_n=150, high=0.02, rest=0.015, **kw) -> DataFrame:
    """Rules of the peak months and of the rest of the year."""
    peak = F.month("invoice_date").isin(*months)
    a = mine_rules(lines.where(peak), item, top_n, high, **kw).withColumn("season", F.lit("peak"))
    b = mine_rules(lines.where(~peak), item, top_n, rest, **kw).withColumn("season", F.lit("normal"))
    return a.unionByName(b)


def with_fallback(item_rules: DataFrame, category_rules: DataFrame, minimum=5) -> DataFrame:
    """Item rules, or category rules when there are too few of the former."""
    few = item_rules.limit(minimum).count() < minimum
    use_category = few and category_rules.limit(1).count() > 0
    return (category_rules if use_category else item_rules).withColumn("level", F.lit("category" if use_category else "item"))


def cluster_rules(lines: DataFrame, labels: DataFrame, item, category=None, top_n=100, max_len=3, min_lines=1000, skip=(999,), by_basket=False) -> DataFrame:
    """Rules per cluster with a support that adapts to its size; the loop is over clusters, whose number is small.

    The support follows the cluster's lines, or, with ``by_basket``, the mean size of its baskets over their number (0.01 at least).
    """
    joined = materialize(lines.join(labels, "customer_id"))
    sizes = joined.groupBy("cluster").count().where(~F.col("cluster").isin(*skip)).where(F.col("count") >= min_lines)
    out = None
    for row in sizes.orderBy("cluster").toLocalIterator():
        part = joined.where(F.col("cluster") == row["cluster"])
        bk = materialize(baskets(basket_pairs(part, item), top_n))
        ms = max(0.01, adaptive_support(bk).first()["min_support"]) if by_basket else max(0.015, min(0.03, 300 / row["count"]))
        r = rules_from(materialize(frequent_itemsets(bk, ms, max_len)))
        if category:
            r = with_fallback(r, mine_rules(part, category, 1000, 0.03, max_len))
        r = r.withColumn("cluster", F.lit(row["cluster"])).withColumn("min_support", F.lit(ms))
        out = r if out is None else out.unionByName(r)
    return out


def cross_sell(rules: DataFrame, k=5) -> DataFrame:
    """Per antecedent item the k strongest rules and the first item each recommends."""
    r = rules.select(F.explode("antecedents").alias("item"), "antecedents", "consequents", "confidence", "lift")
    w = Window.partitionBy("item").orderBy(*rule_order())
    return r.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select(
        "item", "rank", F.get("consequents", F.lit(0)).alias("recommended"), F.round("confidence", 3).alias("confidence"),
        F.round("lift", 2).alias("lift"))


def maximal_itemsets(sets: DataFrame) -> DataFrame:
    """Itemsets without a frequent superset: drop what occurs as a set less one item."""
    smaller = sets.where(F.size("items") > 1).select(F.explode(F.expr(
        "transform(sequence(0, size(items) - 1), d -> filter(items, (x, i) -> i <> d))")).alias("items")).distinct()
    return sets.join(smaller, "items", "left_anti")


def adaptive_support(bk: DataFrame) -> DataFrame:
    """Average basket size over the number of baskets."""
    return bk.agg((F.avg(F.size("items")) / F.count("*")).alias("min_support"))


def rule_set_summary(rules: DataFrame, keys=()) -> DataFrame:
    """Count, mean, median and maximum lift, strong rules, mean confidence and support, and the search score."""
    g = rules.groupBy(*keys).agg(
        F.count("*").alias("n_rules"), F.avg("lift").alias("mean_lift"), F.max("lift").alias("max_lift"),
        F.count(F.when(F.col("lift") > 10, 1)).alias("high_lift"), F.avg("confidence").alias("avg_confidence"),
        F.avg("support").alias("avg_support"))
    med = exact_quantiles(rules, "lift", [0.5], keys=list(keys)).select(*keys, F.get("q", F.lit(0)).alias("median_lift"))
    g = g.join(med, list(keys)) if keys else g.withColumn("median_lift", med.scalar())
    return g.withColumn("score", F.col("high_lift") + 0.5 * F.col("mean_lift") + 0.1 * F.log1p(F.col("n_rules")))


def cluster_rule_summary(lines: DataFrame, labels: DataFrame, rules: DataFrame) -> DataFrame:
    j = lines.select("customer_id", "invoice_no").join(labels, "customer_id")
    cust = j.select("cluster", "customer_id").distinct().groupBy("cluster").agg(F.count("*").alias("n_customers"))
    inv = j.select("cluster", "invoice_no").distinct().groupBy("cluster").agg(F.count("*").alias("n_transactions"))
    r = rules.groupBy("cluster").agg(F.count("*").alias("n_rules"), F.avg("lift").alias("mean_lift"))
    return cust.join(inv, "cluster").join(r, "cluster", "left").na.fill({"n_rules": 0, "mean_lift": 0.0})


def union_rules(global_rules: DataFrame, code_rules: DataFrame, clustered: DataFrame) -> DataFrame:
    """All rules as stored text; of equal (antecedent, consequent) texts the first source wins."""
    parts = [
        global_rules.select(F.lit(0).alias("src"), X.rule_text("antecedents").alias("antecedent"), X.rule_text("consequents").alias("consequent"),
                            "support", "confidence", "lift"),
        code_rules.select(F.lit(1).alias("src"), X.rule_text("antecedents", F.lit("StockCode")).alias("antecedent"),
                          X.rule_text("consequents").alias("consequent"), "support", "confidence", "lift"),
        clustered.select(F.lit(2).alias("src"), X.rule_text("antecedents", F.concat(F.lit("Cluster_"), F.col("cluster"))).alias("antecedent"),
                         X.rule_text("consequents").alias("consequent"), "support", "confidence", "lift"),
    ]
    both = parts[0].unionByName(parts[1]).unionByName(parts[2])
    first = both.groupBy("antecedent", "consequent").agg(
        F.min_by(F.struct("src", "support", "confidence", "lift"), F.struct("src", -F.col("lift"))).alias("r"))
    return first.select("antecedent", "consequent", "r.*")


def product_rules(rules: DataFrame) -> DataFrame:
    """Single-item code rules with numeric product ids on both sides."""
    return rules.where("size(antecedents) = 1 AND size(consequents) = 1").select(
        F.get("antecedents", F.lit(0)).cast("long").alias("product_id"),
        F.get("consequents", F.lit(0)).cast("long").alias("consequent_id"), "support", "confidence", "lift")


def recommendations(rules: DataFrame, products: DataFrame, k=6) -> DataFrame:
    """Per product the k strongest rules, one hit per consequent, inactive products dropped afterwards."""
    w = Window.partitionBy("product_id").orderBy(F.desc("lift"), F.asc("consequent_id"))
    top = rules.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    first = top.groupBy("product_id", "consequent_id").agg(
        F.min_by(F.struct("rank", "support", "confidence", "lift"), "rank").alias("r"))
    return first.select("product_id", "consequent_id", "r.*").join(
        products.where("is_active").select(F.col("product_id").alias("consequent_id"), "name"), "consequent_id")


def rule_scatter(rules: DataFrame, n=500, seed=42) -> DataFrame:
    """Percent-formatted sample of rules for a scatter chart."""
    key = F.concat_ws("|", "antecedents", F.lit(">"), "consequents")
    return rules.orderBy(F.xxhash64(key, F.lit(seed)), key).limit(n).select(
        F.round(F.col("support") * 100, 3).alias("support"), F.round(F.col("confidence") * 100, 2).alias("confidence"),
        F.round("lift", 2).alias("lift"), F.substring(F.array_join("antecedents", ", "), 1, 30).alias("label"))
