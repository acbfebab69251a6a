"""Order life cycle: status audits, stock, balances, funnels."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions.quantiles import split_neighbor, split_running_sum
from ..session import materialize


def _by_month(log: DataFrame) -> DataFrame:
    """The slices that a long log is cut into."""
    return log.withColumn("_m", F.trunc("created_at", "month"))


def audit_transitions(log: DataFrame) -> DataFrame:
    """Log rows that make an illegal move or do not continue the previous state."""
    legal = F.lit(False)
    for a, b in S.TRANSITIONS:
        legal = legal | ((F.col("from_status") == a) & (F.col("to_status") == b))
    steps = split_neighbor(_by_month(log), ["order_id"], "_m", ["created_at", "seq"], "to_status", "_prev")
    return steps.withColumns({
        "illegal": F.col("from_status").isNotNull() & ~F.coalesce(legal, F.lit(False)),
        "broken": ~F.col("from_status").eqNullSafe(F.col("_prev"))}).where("illegal OR broken").drop("_prev", "_m")


def current_status(log: DataFrame) -> DataFrame:
    """Latest status per order, as a mergeable aggregate."""
    return log.groupBy("order_id").agg(F.max_by("to_status", F.struct("created_at", "seq")).alias("status"),
                                       F.max("created_at").alias("since"))


def time_in_status(log: DataFrame) -> DataFrame:
    """Days an order spent in each status; null for the one it is in."""
    steps = split_neighbor(_by_month(log), ["order_id"], "_m", ["created_at", "seq"], "created_at", "_next", ahead=True)
    return steps.select("order_id", F.col("to_status").alias("status"), F.datediff("_next", "created_at").alias("days"))


def price_carts(carts: DataFrame, products: DataFrame) -> DataFrame:
    """Order amount per cart at current prices; a cart with a missing or inactive product is rejected."""
    j = carts.join(products.select("product_id", "price", "is_active"), "product_id", "left")
    return j.groupBy("user_id").agg(
        F.bool_and(F.coalesce("is_active", F.lit(False))).alias("accepted"),
        F.sum(F.coalesce("price", F.lit(0)) * F.col("quantity")).alias("total_cents"))


def oversell_check(demand: DataFrame, products: DataFrame) -> DataFrame:
    """Demand lines in arrival order with the running demand per product against its stock.

    The running sum is cut by day, so a best-seller is spread over its days. The demand is written, since it is summed twice.
    """
    run = split_running_sum(materialize(demand), ["product_id"], "created_at", ["order_id", "quantity"], {"quantity": "running"})
    return run.join(products.select("product_id", "stock"), "product_id").withColumn("fits", F.col("running") <= F.col("stock"))


def stock_position(products: DataFrame, moves: DataFrame) -> DataFrame:
    """Initial stock less sales plus restocked returns."""
    g = moves.groupBy("product_id").agg(F.sum(F.when(F.col("restock"), F.col("quantity")).otherwise(-F.col("quantity"))).alias("_d"))
    return products.join(g, "product_id", "left").select("product_id", (F.col("stock") + F.coalesce("_d", F.lit(0))).alias("position"))


def balance_ledger(opening: DataFrame, entries: DataFrame, cap=None) -> DataFrame:
    """Running balance per user over signed entries in time order, with overdraft and cap flags."""
    e = opening.unionByName(entries)
    run = split_running_sum(e, ["user_id"], "created_at", ["kind", "ref"], {"amount": "balance"})
    over = (F.abs("amount") > cap) if cap is not None else F.lit(False)
    return run.withColumns({"overdrawn": F.col("balance") < 0, "above_cap": over})


def funnel(behaviors: DataFrame, key="user_id") -> DataFrame:
    """Views, cart adds and purchases per key."""
    return behaviors.groupBy(key).pivot("action", ["view", "add_to_cart", "purchase"]).count().na.fill(0)
