"""Market-basket queries (AR*, and the rule aggregates)."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalars as X
from ..operators import baskets as B
from ..operators import catalogue as C
from ..operators import dims as D
from ..session import materialize
from .q_basics import CLUSTER_SQL, cluster_labels
from .registry import query


def itemset_sql(item, where, min_support, max_len, p="", top_n=None, src="sales", min_count=None):
    """Itemsets by self-joins up to three items; ``p`` prefixes the fragment names."""
    top = f"AND item IN (SELECT item FROM {p}a GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT {top_n})" if top_n else ""
    k3 = f"""UNION ALL SELECT [a.item, b.item, c.item], count(*) FROM {p}b a JOIN {p}b b ON a.k = b.k AND a.item < b.item
        JOIN {p}b c ON a.k = c.k AND b.item < c.item GROUP BY a.item, b.item, c.item""" if max_len > 2 else ""
    return f"""{p}a AS (SELECT DISTINCT invoice_no AS k, CAST({item} AS VARCHAR) AS item FROM {src} WHERE {where}),
    {p}b AS MATERIALIZED (SELECT * FROM {p}a WHERE TRUE {top}),
    {p}n AS (SELECT count(DISTINCT k) AS n, {min_count or f"ceil(count(DISTINCT k) * {min_support})"} AS mc FROM {p}a),
    {p}cand AS (SELECT [item] AS s, count(*) AS f FROM {p}b GROUP BY item UNION ALL
    SELECT [a.item, b.item], count(*) FROM {p}b a JOIN {p}b b ON a.k = b.k AND a.item < b.item GROUP BY a.item, b.item {k3}),
    {p}its AS MATERIALIZED (SELECT s, f, n FROM {p}cand, {p}n WHERE f >= mc)"""


def rule_sql(p="", cond="confidence >= 0.1"):
    """Every split of an itemset of up to three items, joined to its parts on equal lists."""
    halves = lambda *xs: ", ".join("{'a': [%s], 'c': [%s]}" % (", ".join(f"s[{i}]" for i in a), ", ".join(f"s[{i}]" for i in c)) for a, c in xs)
    two = halves(((1,), (2,)), ((2,), (1,)))
    three = halves(*((x, tuple(i for i in (1, 2, 3) if i not in x)) for x in ((1,), (2,), (3,), (1, 2), (1, 3), (2, 3))))
    return f"""{p}splits AS (SELECT f, n, unnest(CASE len(s) WHEN 2 THEN [{two}] ELSE [{three}] END) AS h FROM {p}its WHERE len(s) > 1),
    {p}rules AS (SELECT * FROM (SELECT a.s AS ant, c.s AS con, x.f / x.n::DOUBLE AS support, x.f / a.f::DOUBLE AS confidence,
    (x.f / a.f::DOUBLE) / (c.f / x.n::DOUBLE) AS lift FROM {p}splits x JOIN {p}its a ON a.s = x.h.a JOIN {p}its c ON c.s = x.h.c) WHERE {cond})"""


OUT = "array_to_string(ant, ',') AS antecedents, array_to_string(con, ',') AS consequents, round(support, 6) AS support, " \
      "round(confidence, 6) AS confidence, round(lift, 6) AS lift"


def flat(rules, *extra):
    return rules.select(*extra, F.array_join("antecedents", ",").alias("antecedents"), F.array_join("consequents", ",").alias("consequents"),
                        *[F.round(c, 6).alias(c) for c in ("support", "confidence", "lift")])


def brand_lines(t, *more):
    return t.sales("invoice_no", "brand", *more)


BR = itemset_sql("brand", "TRUE", 0.0015, 3)
BRR = BR + ", " + rule_sql()


def brand_baskets(t):
    return materialize(B.baskets(B.basket_pairs(brand_lines(t), "brand")))


def brand_sets(t, ms=0.0015, k=3):
    return materialize(B.frequent_itemsets(brand_baskets(t), ms, k))


def brand_rules(t):
    return B.rules_from(brand_sets(t))


@query("ag25_baskets", "sales", "SELECT invoice_no AS basket, array_to_string(list_sort(list(DISTINCT brand)), ',') AS items FROM sales GROUP BY 1")
def _(t):
    return B.baskets(B.basket_pairs(brand_lines(t), "brand")).select("basket", F.array_join("items", ",").alias("items"))


@query("ag26_item_frequency", "sales", """SELECT CAST(stock_code AS VARCHAR) AS item, count(DISTINCT invoice_no) AS baskets,
    round(count(DISTINCT invoice_no) * 100.0::DOUBLE / (SELECT count(DISTINCT invoice_no) FROM sales), 6) AS support_pct FROM sales GROUP BY 1""")
def _(t):
    f = B.item_frequency(B.basket_pairs(t.sales("invoice_no", "stock_code"), "stock_code"))
    return f.withColumn("support_pct", F.round("support_pct", 6))


@query("ar1_top_item_baskets", "sales", """WITH p AS (SELECT DISTINCT invoice_no, CAST(stock_code AS VARCHAR) AS item FROM sales),
    top AS (SELECT item FROM p GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 200)
    SELECT invoice_no AS basket, coalesce(array_to_string(list_sort(list(item) FILTER (WHERE item IN (SELECT item FROM top))), ','), '') AS items FROM p GROUP BY 1""")
def _(t):
    b = B.baskets(B.basket_pairs(t.sales("invoice_no", "stock_code"), "stock_code"), 200)
    return b.select("basket", F.array_join("items", ",").alias("items"))


@query("ar2_itemsets", "sales", "SELECT array_to_string(s, ',') AS items, f AS freq FROM its", BR)
def _(t):
    return brand_sets(t).select(F.array_join("items", ",").alias("items"), "freq")


@query("ar3_support_ladder", "sales", "SELECT array_to_string(s, ',') AS items, f AS freq, 0.005::DOUBLE AS min_support FROM its",
       itemset_sql("brand", "TRUE", 0.005, 3))
def _(t):
    sets, ms = B.itemsets_with_ladder(brand_baskets(t), 0.5)
    return sets.select(F.array_join("items", ",").alias("items"), "freq", F.lit(ms).alias("min_support"))


@query("ar4_rules", "sales", f"SELECT {OUT} FROM rules", BRR)
def _(t):
    return flat(brand_rules(t))


@query("ar4_rules_by_lift", "sales", f"SELECT {OUT} FROM rules", BR + ", " + rule_sql(cond="lift >= 1.2"))
def _(t):
    return flat(B.rules_from(brand_sets(t), "lift", 1.2))


_CODE = itemset_sql("stock_code", "TRUE", None, 2, top_n=200, min_count=2) + ", " + rule_sql(cond="confidence >= 0.05")


def code_rules(t):
    bk = materialize(B.baskets(B.basket_pairs(t.sales("invoice_no", "stock_code"), "stock_code"), 200))
    return B.rules_from(materialize(B.frequent_itemsets(bk, max_len=2, min_count=2)), threshold=0.05)


@query("ar5_code_rules", "sales", """SELECT ant[1] AS code, con[1] AS other, p.p_name AS description, q.p_name AS other_description, round(lift, 6) AS lift
    FROM rules JOIN part p ON p.p_partkey = CAST(ant[1] AS BIGINT) JOIN part q ON q.p_partkey = CAST(con[1] AS BIGINT)""", _CODE)
def _(t):
    r = B.label_codes(code_rules(t), t.raw("part").select(F.col("p_partkey").alias("stock_code"), F.col("p_name").alias("description")))
    return r.select("code", "other", "description", "other_description", F.round("lift", 6).alias("lift"))


_SEAS = itemset_sql("brand", "month(invoice_date) >= 10", 0.015, 2, "x", 150) + ", " + rule_sql("x") + ", " + \
    itemset_sql("brand", "month(invoice_date) < 10", 0.0145, 2, "y", 150) + ", " + rule_sql("y")


@query("ar6_seasonal_rules", "sales", f"SELECT 'peak' AS season, {OUT} FROM xrules UNION ALL SELECT 'normal', {OUT} FROM yrules", _SEAS)
def _(t):
    r = B.seasonal_rules(brand_lines(t, "invoice_date"), "brand", high=0.015, rest=0.0145, max_len=2)
    return flat(r, "season")


_LINES_MS = "greatest(0.015, least(0.03, 300.0 / count(*)))"
_BASKET_MS = "greatest(0.01, count(DISTINCT (invoice_no, brand)) / count(DISTINCT invoice_no)::DOUBLE / count(DISTINCT invoice_no))"


def _cluster_sql(support=_LINES_MS):
    parts = [CLUSTER_SQL, "sc AS (SELECT s.*, cluster FROM sales s JOIN cl USING (customer_id))",
             f"cz AS (SELECT cluster, {support}::DOUBLE AS ms FROM sc GROUP BY 1 HAVING count(*) >= 1000)"]
    for c in (0, 1, 2):
        parts += [itemset_sql("brand", f"cluster = {c}", f"(SELECT ms FROM cz WHERE cluster = {c})", 2, f"c{c}", 100, "sc"), rule_sql(f"c{c}")]
    return ", ".join(parts)


_CLR = _cluster_sql()
_CLU = " UNION ALL ".join(f"SELECT {c} AS cluster, {OUT} FROM c{c}rules" for c in (0, 1, 2))


def clustered(t, category=None, **kw):
    return B.cluster_rules(brand_lines(t, "customer_id", *([category] if category else [])), cluster_labels(t), "brand", category, max_len=2, **kw)


@query("ar7_cluster_rules", "sales rfm", _CLU, _CLR)
def _(t):
    return flat(clustered(t), "cluster")


@query("ar7_basket_support", "sales rfm", _CLU, _cluster_sql(_BASKET_MS))
def _(t):
    return flat(clustered(t, by_basket=True), "cluster")


@query("ar2_itemsets_of_four", "sales", """SELECT array_to_string(s, ',') AS items, f AS freq FROM its UNION ALL
    SELECT array_to_string([a.item, b.item, c.item, d.item], ','), count(*) FROM b a JOIN b b ON a.k = b.k AND a.item < b.item
    JOIN b c ON a.k = c.k AND b.item < c.item JOIN b d ON a.k = d.k AND c.item < d.item
    GROUP BY a.item, b.item, c.item, d.item HAVING count(*) >= (SELECT mc FROM n)""", itemset_sql("brand", "TRUE", None, 3, min_count=4))
def _(t):
    return B.frequent_itemsets(brand_baskets(t), max_len=4, min_count=4).select(F.array_join("items", ",").alias("items"), "freq")


@query("ar8_category_fallback", "sales", f"SELECT 'category' AS level, {OUT} FROM rules", itemset_sql("category", "TRUE", 0.03, 2) + ", " + rule_sql())
def _(t):
    s = t.sales("invoice_no", "brand", "category")
    r = B.with_fallback(B.mine_rules(s, "brand", 100, 0.4, 2), B.mine_rules(s, "category", 1000, 0.03, 2))
    return flat(r, "level")


@query("ar9_cross_sell", "sales", """SELECT item, CAST(rank AS INTEGER) AS rank, con[1] AS recommended, round(confidence, 3) AS confidence, round(lift, 2) AS lift
    FROM (SELECT *, row_number() OVER (PARTITION BY item ORDER BY lift DESC, confidence DESC, ant, con) AS rank FROM (SELECT unnest(ant) AS item, * FROM rules)) WHERE rank <= 5""", BRR)
def _(t):
    return B.cross_sell(brand_rules(t))


@query("ar10_maximal_itemsets", "sales", """SELECT array_to_string(s, ',') AS items, f AS freq FROM its x WHERE NOT EXISTS
    (SELECT 1 FROM its y WHERE len(y.s) = len(x.s) + 1 AND list_has_all(y.s, x.s))""", itemset_sql("brand", "TRUE", 0.003, 3))
def _(t):
    return B.maximal_itemsets(brand_sets(t, 0.003)).select(F.array_join("items", ",").alias("items"), "freq")


@query("ar11_adaptive_support", "sales", "SELECT round(avg(c) / count(*), 10) AS min_support FROM (SELECT count(DISTINCT brand) AS c FROM sales GROUP BY invoice_no)")
def _(t):
    return B.adaptive_support(B.baskets(B.basket_pairs(brand_lines(t), "brand"))).select(F.round("min_support", 10).alias("min_support"))


@query("ar12_rule_score", "sales", """SELECT round(count(*) FILTER (WHERE lift > 10) + 0.5 * avg(lift) + 0.1 * ln(1 + count(*)), 6) AS score FROM rules""", BRR)
def _(t):
    return B.rule_set_summary(materialize(brand_rules(t))).select(F.round("score", 6).alias("score"))


@query("ar13_cluster_summary", "sales rfm", f"""SELECT c.cluster, n_customers, n_transactions, coalesce(n_rules, 0) AS n_rules, round(coalesce(mean_lift, 0), 6) AS mean_lift FROM
    (SELECT cluster, count(DISTINCT customer_id) AS n_customers, count(DISTINCT invoice_no) AS n_transactions FROM sc GROUP BY 1) c LEFT JOIN
    (SELECT cluster, count(*) AS n_rules, avg(lift) AS mean_lift FROM ({_CLU.replace('round(lift, 6) AS lift', 'lift')}) GROUP BY 1) r USING (cluster)""", _CLR)
def _(t):
    s = B.cluster_rule_summary(t.sales("customer_id", "invoice_no"), cluster_labels(t), clustered(t))
    return s.withColumn("mean_lift", F.round("mean_lift", 6))


@query("ar14_rule_scatter", "sales", """SELECT round(support * 100, 3) AS support, round(confidence * 100, 2) AS confidence, round(lift, 2) AS lift,
    substring(array_to_string(ant, ', '), 1, 30) AS label FROM rules""", itemset_sql("brand", "TRUE", 0.0151, 2) + ", " + rule_sql())
def _(t):
    return B.rule_scatter(B.rules_from(brand_sets(t, 0.0151, 2)), 500)


@query("ag33_rule_summary", "sales", """SELECT count(*) AS n_rules, round(avg(lift), 6) AS mean_lift, round(quantile_cont(lift, 0.5), 6) AS median_lift, round(max(lift), 6) AS max_lift,
    count(*) FILTER (WHERE lift > 10) AS high_lift, round(avg(confidence), 6) AS avg_confidence, round(avg(support), 6) AS avg_support FROM rules""", BRR)
def _(t):
    s = B.rule_set_summary(materialize(brand_rules(t)))
    return s.select("n_rules", "high_lift", *[F.round(c, 6).alias(c) for c in ("mean_lift", "median_lift", "max_lift", "avg_confidence", "avg_support")])


@query("lm3_rules_page", "sales", f"""SELECT {OUT} FROM (SELECT * FROM rules ORDER BY round(lift, 9) DESC, ant, con LIMIT 50 OFFSET 50)""", BRR)
def _(t):
    r = brand_rules(t).withColumn("_o", F.round("lift", 9))
    return flat(C.page_of(r, [F.desc("_o"), F.asc("antecedents"), F.asc("consequents")], 2, 50))


@query("lm5_top_rules", "sales", """SELECT array_to_string(ant, ',') AS antecedents, array_to_string(con, ',') AS consequents, round(support, 4) AS support,
    round(confidence, 4) AS confidence, round(lift, 2) AS lift FROM (SELECT * FROM rules ORDER BY lift DESC, confidence DESC, ant, con LIMIT 20)""", BRR)
def _(t):
    r = B.format_rules(brand_rules(t), 20)
    return r.select(F.array_join("antecedents", ",").alias("antecedents"), F.array_join("consequents", ",").alias("consequents"), "support", "confidence", "lift")


_SO1 = itemset_sql("brand", "TRUE", 0.0151, 2, "g") + ", " + rule_sql("g") + ", " + _CODE + ", " + _CLR
_TXT = "substring('{t}' || array_to_string(ant, ', '), 1, 200) AS antecedent, substring(array_to_string(con, ', '), 1, 200) AS consequent, support, confidence, lift"


@query("so1_union_rules", "sales rfm", "SELECT antecedent, consequent, CAST(src AS INTEGER) AS src, round(lift, 6) AS lift FROM (SELECT *, row_number() OVER (PARTITION BY antecedent, consequent ORDER BY src, lift DESC) AS r FROM (" +
       f"SELECT 0 AS src, {_TXT.format(t='')} FROM grules UNION ALL SELECT 1, {_TXT.format(t='[StockCode] ')} FROM rules UNION ALL " +
       " UNION ALL ".join(f"SELECT 2, {_TXT.format(t=f'[Cluster_{c}] ')} FROM c{c}rules" for c in (0, 1, 2)) + ")) WHERE r = 1", _SO1)
def _(t):
    u = B.union_rules(B.rules_from(brand_sets(t, 0.0151, 2)), code_rules(t), clustered(t))
    return u.select("antecedent", "consequent", "src", F.round("lift", 6).alias("lift"))


_PR = "SELECT CAST(ant[1] AS BIGINT) AS product_id, CAST(con[1] AS BIGINT) AS consequent_id, lift FROM rules"


@query("jn4_recommendations", "sales prod", f"""SELECT r.product_id, consequent_id, CAST(rank AS INTEGER) AS rank, name, round(lift, 6) AS lift FROM (SELECT *, row_number() OVER
    (PARTITION BY product_id ORDER BY lift DESC, consequent_id) AS rank FROM ({_PR})) r JOIN prod p ON p.product_id = consequent_id AND is_active WHERE rank <= 6""", _CODE)
def _(t):
    r = B.recommendations(B.product_rules(code_rules(t)), t.products)
    return r.select("product_id", "consequent_id", "rank", "name", F.round("lift", 6).alias("lift"))


@query("wn14_rank_by_lift", "sales", f"SELECT product_id, consequent_id, CAST(row_number() OVER (PARTITION BY product_id ORDER BY lift DESC, consequent_id) AS INTEGER) AS rank FROM ({_PR})", _CODE)
def _(t):
    # a product is in at most as many rules as there are top items, so its ranking stays small
    w = Window.partitionBy("product_id").orderBy(F.desc("lift"), "consequent_id")
    return B.product_rules(code_rules(t)).select("product_id", "consequent_id", F.row_number().over(w).alias("rank"))


_NAMED = itemset_sql("description", "TRUE", None, 2, top_n=200, min_count=2) + ", " + rule_sql(cond="confidence >= 0.05") + """,
    r AS (SELECT array_to_string(ant, ',') || '>' || array_to_string(con, ',') AS rule_id, substring(array_to_string(con, ', '), 1, 200) AS consequent FROM rules)"""


def name_rules(t):
    """Rules mined on product names, as stored text."""
    r = B.mine_rules(t.sales("invoice_no", "description"), "description", 200, max_len=2, threshold=0.05, min_count=2)
    return r.select(F.concat(F.array_join("antecedents", ","), F.lit(">"), F.array_join("consequents", ",")).alias("rule_id"),
                    X.rule_text("consequents").alias("consequent"))


@query("jn13_match_rule_products", "sales", "SELECT DISTINCT rule_id, p_partkey AS product_id FROM (SELECT rule_id, unnest(string_split(consequent, ', ')) AS item FROM r) JOIN part ON p_name = item", _NAMED)
def _(t):
    return D.match_rule_products(name_rules(t), t.products)


@query("jn13_match_contained", "sales", "SELECT rule_id, p_partkey AS product_id FROM r JOIN part ON contains(consequent, p_name)", _NAMED)
def _(t):
    return D.match_contained(materialize(name_rules(t)), t.products)
