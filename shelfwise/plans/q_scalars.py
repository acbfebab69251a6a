"""Scalar-function queries (SF*)."""

from pyspark.sql import functions as F

from .. import schemas as S
from ..functions import scalars as X
from .registry import query

CAT_SQL = "CASE " + " ".join(
    f"WHEN regexp_matches(lower({{c}}), '{'|'.join(w)}') THEN '{k}'" for k, w in S.CATEGORY_KEYWORDS.items()
) + f" ELSE '{S.CATEGORY_DEFAULT}' END"
CAT_NAME_SQL = "CASE category " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in S.CATEGORY_NAMES.items()) + \
    f" ELSE '{S.CATEGORY_NAME_DEFAULT}' END"


@query("sf1_categorize", "", f"SELECT doc_id, {CAT_SQL.format(c='text')} AS category FROM documents")
def _(t):
    return t.raw("documents").select("doc_id", X.categorize(F.col("text")).alias("category"))


@query("sf2_category_name", "", f"""WITH c AS (SELECT doc_id, {CAT_SQL.format(c='text')} AS category FROM documents)
    SELECT {CAT_NAME_SQL} AS name, count(*) AS n FROM c GROUP BY 1""")
def _(t):
    c = t.raw("documents").select(X.category_name(X.categorize(F.col("text"))).alias("name"))
    return c.groupBy("name").agg(F.count("*").alias("n"))


def _dict_sql(expr, d):
    for k, v in sorted(d.items(), key=lambda kv: -len(kv[0])):
        expr = f"regexp_replace({expr}, '{k}', '{v}', 'gi')"
    return expr


_NAME = "p_name"
for _w, _d in sorted(X.NUMBER_WORDS.items(), key=lambda kv: -len(kv[0])):
    _NAME = f"regexp_replace({_NAME}, '\\b{_w}\\b', '{_d}', 'gi')"
_NAME = _dict_sql(_dict_sql(_NAME, X.MATERIALS), X.COLORS)
_STOP = "|".join(X.STOP_WORDS)


@query("sf3_normalize_names", "", f"""WITH n AS (SELECT p_partkey AS product_id, p_name, {_NAME} AS s FROM part),
    c AS (SELECT product_id, p_name, regexp_replace(regexp_replace(regexp_replace(s, '\\b({_STOP})\\b', '', 'gi'),
    '\\s+', '', 'g'), '[A-Za-z]', '', 'g') AS s FROM n)
    SELECT product_id, CASE WHEN s = '' THEN p_name ELSE s END AS name_out FROM c""")
def _(t):
    p = t.raw("part").select(F.col("p_partkey").alias("product_id"), "p_name")
    return X.normalize_names(p, "p_name", "name_out").select("product_id", "name_out")


@query("sf4_short_name", "", """SELECT doc_id, CASE WHEN length(text) <= 50 THEN text
    ELSE substring(text, 1, 47) || '...' END AS short FROM documents""")
def _(t):
    return t.raw("documents").select("doc_id", X.short_name(F.col("text")).alias("short"))


@query("sf5_email_codec", "", """WITH e AS (SELECT CASE WHEN c_nationkey = 0 THEN c_name || '@other.example'
    ELSE 'customer_' || c_custkey || '@customers.example' END AS email FROM customer)
    SELECT email, coalesce(TRY_CAST(nullif(regexp_extract(email, '^customer_(-?\\d+)@customers\\.example$', 1), '') AS BIGINT), -1) AS customer_id FROM e""")
def _(t):
    u = t.users.select(F.when(F.col("nation_key") == 0, F.concat(F.col("name"), F.lit("@other.example"))).otherwise(F.col("email")).alias("email"))
    return u.select("email", F.coalesce(X.customer_of(F.col("email")), F.lit(-1)).alias("customer_id"))


_HEX = "list_transform(range(1, 33), lambda i: instr('0123456789abcdef', substr(md5(CAST(c_custkey AS VARCHAR)), i, 1)) - 1)"
_R = f"CAST(list_reduce(list_prepend(0::BIGINT, {_HEX}), lambda a, d: (a * 16 + d) % 100) AS BIGINT)"


def _pick(names, expr):
    return f"list_extract([{', '.join(repr(n) for n in names)}], {expr} + 1)"


@query("sf6_pseudonym", "", f"""WITH h AS (SELECT c_custkey AS customer_id, {_R} AS r FROM customer)
    SELECT customer_id, {_pick(S.FIRST_NAMES, 'r % 10')} AS first_name, {_pick(S.LAST_NAMES, 'r // 10')} AS last_name FROM h""")
def _(t):
    first, last = X.pseudonym(F.col("c_custkey"))
    return t.raw("customer").select(F.col("c_custkey").alias("customer_id"), first.alias("first_name"), last.alias("last_name"))


@query("sf7_to_cents", "", """SELECT l_orderkey, count(*) AS n, CAST(sum(CAST(round_even(l_extendedprice * 100, 0) AS BIGINT)) AS BIGINT) AS cents
    FROM lineitem GROUP BY 1""")
def _(t):
    return t.raw("lineitem").groupBy("l_orderkey").agg(
        F.count("*").alias("n"), F.sum(X.to_cents(F.col("l_extendedprice"))).alias("cents"))


@query("sf8_date_parts", "", """SELECT event_id, CAST(ts AS DATE) AS d, CAST(hour(ts) AS INTEGER) AS hh, CAST(month(ts) AS INTEGER) AS mm,
    CAST(quarter(ts) AS INTEGER) AS qq, CAST(week(ts) AS INTEGER) AS ww, CAST(isodow(ts) - 1 AS INTEGER) AS dow,
    CAST(dayofweek(ts) AS INTEGER) AS sunday0, CAST(dayofyear(ts) AS INTEGER) AS doy, CAST(year(ts) AS INTEGER) AS yy FROM events""")
def _(t):
    ts = F.col("ts")
    return t.raw("events").select(
        "event_id", F.to_date(ts).alias("d"), F.hour(ts).alias("hh"), F.month(ts).alias("mm"), F.quarter(ts).alias("qq"),
        F.weekofyear(ts).alias("ww"), F.weekday(ts).alias("dow"), (F.dayofweek(ts) - 1).alias("sunday0"),
        F.dayofyear(ts).alias("doy"), F.year(ts).alias("yy"))


@query("sf9_month_key", "", "SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS n FROM orders GROUP BY 1")
def _(t):
    return t.raw("orders").groupBy(X.month_key(F.col("o_orderdate")).alias("month")).agg(F.count("*").alias("n"))


@query("sf10_week_bucket", "", """SELECT CAST(date_trunc('week', o_orderdate - INTERVAL 1 DAY) + INTERVAL 1 DAY AS DATE) AS week,
    CAST(min(date_trunc('week', o_orderdate)) AS DATE) AS iso_week, count(*) AS n FROM orders GROUP BY 1""")
def _(t):
    return t.raw("orders").groupBy(X.week_bucket(F.col("o_orderdate")).alias("week")).agg(
        F.min(X.week_bucket(F.col("o_orderdate"), iso=True)).alias("iso_week"), F.count("*").alias("n"))


@query("sf11_whole_days", "", """SELECT event_id, CAST(floor((epoch_us(TIMESTAMP '2024-02-01') - epoch_us(ts)) / 86400000000.0) AS INTEGER)
    AS days FROM events""")
def _(t):
    return t.raw("events").select("event_id", X.whole_days(F.lit("2024-02-01").cast("timestamp"), F.col("ts").cast("timestamp")).alias("days"))


@query("sf12_ladders", "rfm1", "SELECT user_id, r_score, f_score, m_score FROM rfm1")
def _(t):
    return t.rfm.select("user_id", "r_score", "f_score", "m_score")


@query("sf13_risk_level", "churn metrics", """SELECT user_id, CASE WHEN churn_prob >= 0.85 THEN 'high' WHEN churn_prob >=
    (SELECT least(metric_value / 500.0, 0.8) FROM metrics WHERE model_name = 'Churn' AND metric_name = 'optimal_threshold')
    THEN 'medium' ELSE 'low' END AS risk_level FROM churn""")
def _(t):
    thr = t.metrics.where("model_name = 'Churn' AND metric_name = 'optimal_threshold'").select(
        F.least(F.col("metric_value") / 500.0, F.lit(0.8)))
    return t.churn.select("user_id", X.risk_level(F.col("churn_prob"), thr.scalar()).alias("risk_level"))


@query("sf14_math", "", """SELECT event_id, round(ln(1 + value), 6) AS log1p_v, round(exp(value / 100.0) - 1, 6) AS expm1_v,
    least(greatest(value, 10.0::DOUBLE), 100.0::DOUBLE) AS clipped, round(sqrt(value), 6) AS root,
    round(sin(2 * pi() * month(ts) / 12), 6) AS s, round(cos(2 * pi() * month(ts) / 12), 6) AS c FROM events""")
def _(t):
    v, angle = F.col("value"), 2 * F.pi() * F.month("ts") / 12
    return t.raw("events").select(
        "event_id", F.round(F.log1p(v), 6).alias("log1p_v"), F.round(F.expm1(v / 100.0), 6).alias("expm1_v"),
        F.least(F.greatest(v, F.lit(10.0)), F.lit(100.0)).alias("clipped"), F.round(F.sqrt(v), 6).alias("root"),
        F.round(F.sin(angle), 6).alias("s"), F.round(F.cos(angle), 6).alias("c"))


_JTXT = """CASE event_id % 4 WHEN 0 THEN '["' || event_type || '","' || user_id || '"]' WHEN 1 THEN event_type WHEN 2 THEN '[]' ELSE '' END"""


@query("sf15_json_list", "", f"""WITH j AS (SELECT event_id, event_type, user_id, {_JTXT} AS txt FROM events)
    SELECT event_id, CASE event_id % 4 WHEN 0 THEN event_type || ',' || user_id WHEN 1 THEN event_type ELSE '' END AS items,
    CAST(CASE event_id % 4 WHEN 0 THEN 2 WHEN 1 THEN 1 ELSE 0 END AS INTEGER) AS n FROM j""")
def _(t):
    e = t.raw("events").select("event_id", F.expr(_JTXT).alias("txt"))
    items = X.json_list(F.col("txt"))
    return e.select("event_id", F.array_join(items, ",").alias("items"), F.size(items).alias("n"))


@query("sf16_rule_text", "", "SELECT p_partkey AS product_id, substring(p_name || ', ' || p_brand || ', ' || p_type, 1, 20) AS txt FROM part")
def _(t):
    return t.raw("part").select(F.col("p_partkey").alias("product_id"), X.rule_text(F.array("p_name", "p_brand", "p_type"), width=20).alias("txt"))


@query("sf17_tagged_text", "", "SELECT p_partkey AS product_id, '[' || p_brand || '] ' || p_name AS txt FROM part")
def _(t):
    return t.raw("part").select(F.col("p_partkey").alias("product_id"),
                                X.rule_text(F.array("p_name"), F.col("p_brand")).alias("txt"))


_ADVICE = "CASE segment " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in S.SEGMENT_ADVICE.items()) + " ELSE '' END"


@query("sf18_segment_advice", "usr rfm", f"""SELECT user_id, coalesce(recency, 0) AS recency, coalesce(frequency, 0) AS frequency,
    coalesce(monetary, 0) AS monetary, coalesce(rfm_score, 0) AS rfm_score, coalesce(segment, '一般客户') AS my_segment,
    {_ADVICE} AS advice FROM usr LEFT JOIN rfm USING (user_id)""")
def _(t):
    from ..operators.kpis import user_rfm_cards
    return user_rfm_cards(t.users, t.rfm)


@query("sf19_percent_of_total", "prod", """SELECT category_name, count(*) AS n, round(100.0::DOUBLE * count(*) / sum(count(*)) OVER (), 1) AS pct
    FROM prod GROUP BY 1""")
def _(t):
    g = t.products.groupBy("category_name").agg(F.count("*").alias("n"))
    total = t.products.agg(F.count("*"))
    return g.withColumn("pct", X.percent_of(F.col("n"), total.scalar()))


@query("sf20_output_rounding", "churn", "SELECT user_id, round(churn_prob, 4) AS p4, round(churn_prob * 100, 1) AS pct1, round(churn_prob, 6) AS p6 FROM churn")
def _(t):
    p = F.col("churn_prob")
    return t.churn.select("user_id", F.round(p, 4).alias("p4"), F.round(p * 100, 1).alias("pct1"), F.round(p, 6).alias("p6"))
