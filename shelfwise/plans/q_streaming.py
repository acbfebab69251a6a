"""Streaming queries (ST*), each checked against the batch answer."""

from pyspark.sql import functions as F

from ..session import shared_dir
from ..streaming import jobs as J
from .registry import query


def order_columns(o):
    return o.select(F.col("o_orderkey").alias("order_id"), F.col("o_custkey").alias("user_id"), F.to_date("o_orderdate").alias("created_at"),
                    F.col("o_orderdate").cast("timestamp").alias("ts"), F.bround(F.col("o_totalprice") * 100, 0).cast("long").alias("total_cents"),
                    F.expr("CASE o_orderstatus WHEN 'F' THEN 'delivered' WHEN 'P' THEN 'paid' ELSE 'pending' END").alias("status"))


def event_columns(e):
    e = e.where("event_type IN ('view', 'click', 'purchase')")
    return e.select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"), "value",
                    F.expr("CASE event_type WHEN 'view' THEN 'view' WHEN 'click' THEN 'add_to_cart' ELSE 'purchase' END").alias("action"))


def order_stream(t):
    return order_columns(J.stream_table(t.spark, t.path, "orders"))


def event_stream(t):
    return event_columns(J.stream_table(t.spark, t.path, "events"))


def in_turns(t, rows, turn, job, turns=3):
    """The job's result after the rows came in turns; it is started anew after each, with the same output and checkpoint."""
    source, out, checkpoint = (shared_dir(t.spark, "turns") for _ in range(3))
    for k in range(turns):
        rows.where(F.expr(turn) == k).write.parquet(f"{source}/{k}")
        table = job(J.stream_files(t.spark, f"{source}/*", rows.schema), out=out, checkpoint=checkpoint)
    return table


BY_YEAR = "CASE WHEN year(ts) < 1997 THEN 0 WHEN year(ts) < 1999 THEN 1 ELSE 2 END"
BY_DAY = "CASE WHEN day(ts) < 11 THEN 0 WHEN day(ts) < 21 THEN 1 ELSE 2 END"


RFM_SQL = "SELECT user_id, recency, frequency, monetary, rfm_score, segment FROM rfm"
RFM = ("user_id", "recency", "frequency", "monetary", "rfm_score", "segment")


@query("st1_incremental_rfm", "rfm", RFM_SQL)
def _(t):
    return J.incremental_rfm(order_stream(t), t.as_of).select(*RFM)


@query("st1_rfm_resumed", "rfm", RFM_SQL)
def _(t):
    rows = order_columns(t.raw("orders"))
    return in_turns(t, rows, "pmod(order_id, 3)", lambda s, **at: J.incremental_rfm(s, t.as_of, **at)).select(*RFM)


SALES_SQL = "SELECT created_at AS date, CAST(sum(total_cents) AS BIGINT) AS amount, count(*) AS count FROM paid GROUP BY 1"


@query("st2_live_sales", "paid", SALES_SQL)
def _(t):
    return J.live_sales(order_stream(t))


@query("st2_sales_resumed", "paid", SALES_SQL)
def _(t):
    return in_turns(t, order_columns(t.raw("orders")), BY_YEAR, J.live_sales)


@query("st2_sales_late", "paid", """SELECT created_at AS date, CAST(sum(total_cents) AS BIGINT) AS amount, count(*) AS count FROM paid
    WHERE created_at + 1 > coalesce((SELECT max(created_at) - 400 FROM paid p WHERE p.order_id % 3 < paid.order_id % 3), DATE '0001-01-01') GROUP BY 1""")
def _(t):
    rows = order_columns(t.raw("orders"))  # each turn reaches back to the first day; what the turns before have closed is late
    return in_turns(t, rows, "pmod(order_id, 3)", lambda s, **at: J.live_sales(s, "400 days", **at))


FUNNEL_SQL = """SELECT epoch_us(b - INTERVAL 6 HOUR * k) AS start_us, action, count(*) AS n FROM (SELECT *, time_bucket(INTERVAL 6 HOUR, ts) AS b FROM beh), range(4) r(k) GROUP BY 1, 2"""


@query("st3_live_funnel", "beh", FUNNEL_SQL)
def _(t):
    return J.live_funnel(event_stream(t)).select(F.unix_micros("start").alias("start_us"), "action", "n")


@query("st3_funnel_resumed", "beh", FUNNEL_SQL)
def _(t):
    f = in_turns(t, event_columns(t.raw("events")), BY_DAY, J.live_funnel)
    return f.select(F.unix_micros("start").alias("start_us"), "action", "n")


SESSIONS_SQL = """WITH g AS (SELECT *, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM beh),
    s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS sid FROM g)
    SELECT user_id, epoch_us(min(ts)) AS start_us, epoch_us(max(ts) + INTERVAL 30 MINUTE) AS end_us, count(*) AS n, round(sum(value), 4) AS value FROM s GROUP BY user_id, sid
    HAVING max(ts) + INTERVAL 30 MINUTE <= (SELECT max(ts) - INTERVAL 1 HOUR FROM beh)"""


def sessions_out(s):
    return s.select("user_id", F.unix_micros("start").alias("start_us"), F.unix_micros("end").alias("end_us"), "n", F.round("value", 4).alias("value"))


@query("st4_sessions", "beh", SESSIONS_SQL)
def _(t):
    return sessions_out(J.shopping_sessions(event_stream(t)))


@query("st4_sessions_resumed", "beh", SESSIONS_SQL)
def _(t):
    return sessions_out(in_turns(t, event_columns(t.raw("events")), BY_DAY, J.shopping_sessions))


UNIQUE_SQL = "SELECT action, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS id_sum FROM beh GROUP BY 1"


@query("st5_unique_events", "beh", UNIQUE_SQL)
def _(t):
    twice = event_stream(t).unionByName(event_stream(t))
    return J.unique_events(twice).groupBy("action").agg(F.count("*").alias("n"), F.sum("event_id").alias("id_sum"))


@query("st5_unique_resumed", "beh", UNIQUE_SQL)
def _(t):
    once = event_columns(t.raw("events"))  # every event comes in the first turn and again in the second
    rows = once.withColumn("turn", F.lit(0)).unionByName(once.withColumn("turn", F.lit(1)))
    u = in_turns(t, rows, "turn", lambda s, **at: J.unique_events(s, delay="60 days", **at), turns=2)
    return u.groupBy("action").agg(F.count("*").alias("n"), F.sum("event_id").alias("id_sum"))


ENRICHED_SQL = "SELECT segment, action, count(*) AS n FROM beh LEFT JOIN rfm USING (user_id) GROUP BY 1, 2"


@query("st6_enriched_events", "beh rfm", ENRICHED_SQL)
def _(t):
    return J.enriched_events(event_stream(t), t.rfm).groupBy("segment", "action").agg(F.count("*").alias("n"))


@query("st6_enriched_resumed", "beh rfm", ENRICHED_SQL)
def _(t):
    e = in_turns(t, event_columns(t.raw("events")), BY_DAY, lambda s, **at: J.enriched_events(s, t.rfm, **at))
    return e.groupBy("segment", "action").agg(F.count("*").alias("n"))
