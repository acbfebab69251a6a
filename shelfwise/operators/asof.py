"""Churn features at many cuts from one reading of the lines.

The lines are summed up once per customer, order and time, and those visits are written. Sums, moments and first days are taken per
customer and span between two cuts, and only these few rows are repeated at the cuts that follow, so a cut costs no reading of the
lines. Prices and products are read from the lines, once each. The list of cuts is the caller's and short; what has one row a cut is
broadcast.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.quantiles import MOST, exact_quantiles, sorted_quantiles
from ..session import materialize
from . import features as FT

KEYS = ["cut", "customer_id"]


def summed_lines(lines: DataFrame) -> DataFrame:
    """A shorter table to read all cuts from where lines repeat: lines of one customer, order, time, product and price as one row. Written."""
    return materialize(lines.groupBy("customer_id", "invoice_no", "invoice_date", "stock_code", "unit_price").agg(
        F.count(F.lit(1)).alias("n"), F.sum("quantity").alias("quantity"), F.sum("line_cents").alias("line_cents")))


def _dates(cuts):
    return F.array(*[F.lit(c).cast("date") for c in cuts])


def at_cuts(df: DataFrame, cuts, ts="invoice_date") -> DataFrame:
    """Each row once per cut that it is not after, with the ``cut``."""
    return df.withColumn("cut", F.explode(F.filter(_dates(cuts), lambda c: F.col(ts) <= c.cast("timestamp"))))


def _moments(n, s, q):
    """Mean and sample deviation from a count, a sum and a sum of squares; no deviation (0) for one value."""
    mean = F.col(s) / F.col(n)
    var = F.greatest(F.col(q) - F.col(s) * mean, F.lit(0.0)) / F.nullif(F.col(n) - 1, F.lit(0))
    return mean, F.coalesce(F.sqrt(var), F.lit(0.0))


def _span(cuts, ts="invoice_date"):
    """The place (from 1) of the first cut a row counts at, in ascending order of the cuts; null after the last."""
    out = None
    for i, c in enumerate(cuts, 1):
        seen = F.col(ts) <= F.lit(c).cast("date").cast("timestamp")
        out = F.when(seen, i) if out is None else out.when(seen, i)
    return out


def from_span(df: DataFrame, cuts) -> DataFrame:
    """Each row, of one ``_span``, at every cut from that on: what is summed up by span first is few rows a customer."""
    return df.where("_span IS NOT NULL").withColumn("cut", F.explode(F.slice(_dates(cuts), F.col("_span"), F.lit(len(cuts))))).drop("_span")


def visits_of(rows: DataFrame, cuts) -> DataFrame:
    """One row per customer, order and time with its sums, not after the last cut. Written."""
    n, p = F.col("n"), F.col("unit_price")
    v = rows.where(_span(cuts).isNotNull()).groupBy("customer_id", "invoice_no", "invoice_date").agg(
        F.sum("n").alias("n"), F.sum("quantity").alias("quantity"), F.sum("line_cents").alias("line_cents"), F.sum(n * p).alias("p1"), F.sum(n * p * p).alias("p2"))
    return materialize(v.withColumn("_span", _span(cuts)))


def churn_base_at(rows: DataFrame, cuts, visits=None) -> DataFrame:
    """The base features of ``churn_base``, one row per cut and customer.

    Sums are taken per customer and span between two cuts, and only those few rows go to every cut they count at; of the visits,
    only the ones in the windows before a cut are repeated by cut.
    """
    cuts = sorted(cuts)
    visits = visits_of(rows, cuts) if visits is None else visits
    ts, n = F.col("invoice_date"), F.col("n")
    hour = F.hour(ts)

    def times(cond):
        return F.sum(F.when(cond, n).otherwise(0))
    sums = {"total_items": F.sum("quantity"), "_cents": F.sum("line_cents"), "_n": F.sum("n"), "_p1": F.sum("p1"), "_p2": F.sum("p2"), "_h1": F.sum(n * hour),
            "_h2": F.sum(n * hour * hour), "_weekend": times(F.weekday(ts) >= 5), "_night": times((hour >= 22) | (hour <= 5)), "_day": times(hour.between(9, 17))}
    spans = visits.groupBy("customer_id", "_span").agg(
        *[v.alias(k) for k, v in sums.items()], F.min(ts).alias("first_purchase"), F.max(ts).alias("last_purchase"), F.bit_or(F.expr("shiftleft(1, month(invoice_date))")).alias("_months"))
    last = from_span(visits.groupBy("_span").agg(F.max(ts).alias("_last")), cuts).groupBy("cut").agg(F.max("_last").alias("_last"))
    starts = {f"{side}_{w}d": F.col("_last") - F.make_dt_interval(F.lit(w * k)) for w in (30, 60) for side, k in (("early", 2), ("late", 1))}
    recent = at_cuts(visits, cuts).join(F.broadcast(last), "cut").where(ts >= starts["early_60d"]).withColumns({f"_{name}": ts >= s for name, s in starts.items()})
    windows = recent.groupBy(*KEYS, "invoice_no").agg(
        *[F.max(f"_{name}").alias(f"_{name}") for name in starts], *[F.sum(F.when(F.col(f"_{name}"), F.col("line_cents"))).alias(f"_spend_{name}") for name in starts]).groupBy(*KEYS).agg(
        *[F.count(F.when(F.col(f"_{name}"), 1)).alias(f"orders_{name}") for name in starts], *[F.sum(f"_spend_{name}").alias(f"_spend_{name}") for name in starts])
    names = [*[f"orders_{name}" for name in starts], *[f"_spend_{name}" for name in starts]]
    agg = from_span(spans, cuts).unionByName(windows, allowMissingColumns=True).groupBy(*KEYS).agg(
        *[F.sum(k).alias(k) for k in sums], F.min("first_purchase").alias("first_purchase"), F.max("last_purchase").alias("last_purchase"),
        F.bit_count(F.bit_or("_months")).alias("active_months"), *[F.coalesce(F.sum(k), F.lit(0)).alias(k) for k in names])
    (price, price_std), (at, at_std) = _moments("_n", "_p1", "_p2"), _moments("_n", "_h1", "_h2")
    agg = agg.withColumns({
        "total_spent": F.col("_cents") / 100, "avg_item_price": price, "price_std": price_std, "avg_purchase_hour": at, "hour_std": at_std,
        **{c: F.col(k) / F.col("_n") for c, k in {"weekend_ratio": "_weekend", "is_night": "_night", "is_weekday": "_day"}.items()}}).drop(*[k for k in sums if k[0] == "_"])

    def counted(first, out):
        """How many of the rows, each with its first span, a customer has at every cut."""
        return from_span(first.groupBy("customer_id", "_span").agg(F.count("*").alias(out)), cuts).groupBy(*KEYS).agg(F.sum(out).alias(out))
    orders = counted(visits.groupBy("customer_id", "invoice_no").agg(F.min("_span").alias("_span")), "total_orders")
    products = counted(rows.groupBy("customer_id", "stock_code").agg(F.min(_span(cuts)).alias("_span")).where("_span IS NOT NULL"), "unique_products")
    df = FT._attach(agg, KEYS, orders, products, prices_at(rows, cuts, visits))
    df = df.withColumns({f"orders_{name}": F.when(F.col("total_orders").isNotNull(), F.col(f"orders_{name}")) for name in starts})  # no customer, no counts
    return FT.base_ratios(df, F.date_add("cut", 1).cast("timestamp"), starts)


def prices_at(rows: DataFrame, cuts, visits, probs=(0.25,), most=MOST) -> DataFrame:
    """The lower price quartile of a customer at every cut. Customers of up to ``most`` lines are one sorted array each, cut off at
    every cut; those of more are ranked by ``exact_quantiles``, which never gathers them."""
    v = F.col("unit_price").cast("double")
    few = rows.select("customer_id", v.alias("_v"), F.col("n").cast("long").alias("_n"), _span(cuts).alias("_span")).where(
        "customer_id IS NOT NULL AND _span IS NOT NULL AND _v IS NOT NULL AND NOT isnan(_v) AND abs(_v) < double('infinity')")
    many = materialize(visits.groupBy("customer_id").agg(F.sum("n").alias("_n")).where(F.col("_n") > most).select("customer_id"))
    hot = None if many.isEmpty() else many
    if hot is not None:
        few = few.join(F.broadcast(hot), "customer_id", "left_anti")
    lists = few.groupBy("customer_id").agg(F.sort_array(F.collect_list(F.struct("_v", "_n", "_span"))).alias("_l"))
    lists = lists.withColumn("_a", F.flatten(F.transform("_l", lambda x: F.array_repeat(F.struct(x["_v"].alias("_v"), x["_span"].alias("_span")), x["_n"].cast("int")))))

    def until(i):
        return F.transform(F.filter("_a", lambda x: x["_span"] <= i), lambda x: x["_v"])
    each = F.explode(F.array(*[F.struct(F.lit(c).cast("date").alias("cut"), until(i).alias("v")) for i, c in enumerate(cuts, 1)]))
    q = lists.select("customer_id", each.alias("_c")).where(F.size("_c.v") > 0).select(
        F.col("_c.cut").alias("cut"), "customer_id", sorted_quantiles(F.col("_c.v"), probs)[0].alias("price_p25"))
    if hot is None:
        return q
    own = rows.join(F.broadcast(hot), "customer_id", "left_semi")
    prices = at_cuts(own.groupBy("customer_id", "unit_price", "invoice_date").agg(F.sum("n").alias("n")), cuts)
    return q.unionByName(exact_quantiles(prices, "unit_price", list(probs), keys=KEYS, weight="n").select(*KEYS, F.get("q", F.lit(0)).alias("price_p25")))


def first_after(summed: DataFrame, cuts, label_end=None) -> DataFrame:
    """The first day a customer buys after each cut, up to ``label_end``: one day for all cuts, or one for each."""
    ends = label_end if isinstance(label_end, (list, tuple)) else [label_end] * len(cuts)
    spans = F.array(*[F.struct(F.lit(c).cast("date").alias("cut"), F.lit(e or "9999-12-31").cast("date").alias("end")) for c, e in zip(cuts, ends, strict=True)])
    ts = F.col("invoice_date")
    inside = F.filter(spans, lambda s: (ts >= F.date_add(s["cut"], 1).cast("timestamp")) & (ts <= s["end"].cast("timestamp")))
    return summed.withColumn("cut", F.explode(F.transform(inside, lambda s: s["cut"]))).groupBy(*KEYS).agg(F.to_date(F.min("invoice_date")).alias("first_label_purchase"))


def churn_features_at(lines: DataFrame, cuts, label_end=None, summed=None) -> DataFrame:
    """All churn features with labels at several cuts: what ``churn_features`` gives for each, with the ``cut``."""
    rows = lines.withColumn("n", F.lit(1)) if summed is None else summed
    visits = visits_of(rows, sorted(cuts))
    seen = materialize(at_cuts(visits.drop("_span"), cuts))
    df = FT._attach(churn_base_at(rows, cuts, visits), KEYS, FT.purchase_gaps(seen, KEYS), FT.half_trends(seen, KEYS), FT.peak_month(seen, KEYS))
    df = df.withColumns({k: F.coalesce(F.col(k), F.lit(0.0)) for k in ("relative_freq_trend", "relative_spend_trend")})
    df = FT.derive_churn(materialize(df), F.col("cut"), ["cut"])
    return FT.labelled(df.join(materialize(first_after(rows, cuts, label_end)), KEYS, "left"))
