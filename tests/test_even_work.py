"""Work that is dealt evenly or done once: what the queries' tasks hold, and that the short ways give the rows of the long ones."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from shelfwise.functions import scalars as X
from shelfwise.functions.quantiles import exact_quantiles
from shelfwise.operators import asof as AT
from shelfwise.operators import drift as DR
from shelfwise.operators import lifecycle as O
from shelfwise.plans.q_lifecycle import demand
from shelfwise.session import even_parts
from shelfwise.sources.canonical import Tables


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    """Orders that repeat, have no customer or no line; lines without a product or an order."""
    at = str(tmp_path_factory.mktemp("small"))
    day = dt.datetime(1999, 5, 3)
    made = {
        "orders": ([(1, 10, day), (1, 10, day), (2, 11, day), (3, None, day), (4, 12, day)], "o_orderkey long, o_custkey long, o_orderdate timestamp"),
        "lineitem": ([(1, 5, 2.0), (1, 5, 3.0), (2, 6, 1.0), (3, 5, 1.0), (None, 6, 4.0), (9, 7, 1.0), (2, None, 1.0)], "l_orderkey long, l_partkey long, l_quantity double"),
        "part": ([(5, "a", "m", "n"), (5, "b", "m", "n"), (6, None, "m", "n"), (8, "c", "m", "n")], "p_partkey long, p_name string, p_brand string, p_type string"),
        "customer": ([(10, 1), (11, None), (12, 1)], "c_custkey long, c_nationkey long"), "nation": ([(1, "X")], "n_nationkey long, n_name string")}
    for name, (rows, ddl) in made.items():
        df = spark.createDataFrame(rows, ddl)
        if name == "lineitem":
            df = df.withColumns({"l_extendedprice": F.col("l_quantity") * 7, "l_returnflag": F.lit("N")})
        df.write.parquet(f"{at}/{name}.parquet")
    return Tables(spark, at)


def test_parts_follow_the_rows(spark, tmp_path):
    spark.range(1_000_001).write.parquet(f"{tmp_path}/t")
    assert even_parts(spark.read.parquet(f"{tmp_path}/t")) == 3


def test_demand_is_dealt_by_rows_and_written_once(small):
    d = demand(small)
    assert plan(d).count("REPARTITION_BY_NUM") == 2
    assert {(r.order_id, r.product_id): r.quantity for r in d.collect()} == {(1, 5): 10, (2, 6): 1, (2, None): 1, (3, 5): 1}
    stock = d.sparkSession.createDataFrame([(5, 10), (6, 3)], "product_id long, stock long")
    run = O.oversell_check(d, stock)
    assert not any("lineitem" in f for f in run.inputFiles())
    assert sorted((r.product_id, r.order_id, r.running, r.fits) for r in run.collect()) == [(5, 1, 10, True), (5, 3, 11, False), (6, 2, 1, True)]


def test_distinct_pairs_before_the_joins(small):
    for short, cols in ((small.line_products(), ("stock_code", "description")), (small.line_customers(), ("customer_id", "country"))):
        assert sorted(map(str, short.collect())) == sorted(map(str, small.lines(*cols).distinct().collect()))
    assert "LeftSemi" in plan(small.line_customers())


def test_short_and_ranked_quantiles_agree(spark):
    rows = [(k, float((i * 37) % 101) / 7) for k, n in (("a", 300), (None, 250), ("b", 9), ("c", 1)) for i in range(n)] + [("d", None), ("d", float("nan"))]
    df = spark.createDataFrame(rows, "k string, v double")
    got = [{r.k: r.q for r in exact_quantiles(df, "v", [0.0, 0.25, 0.9], keys=["k"], most=m).collect()} for m in (0, 100, 1000)]
    assert got[0] == got[1] == got[2] and set(got[0]) == {"a", "b", "c", None}


def test_prices_of_large_customers(spark):
    day = dt.datetime(1999, 1, 1)
    rows = [(c, i, day + dt.timedelta(days=i * 9), float((i * 13) % 17), 1 + i % 3) for c, n in ((1, 40), (2, 3), (3, 1)) for i in range(n)]
    df = spark.createDataFrame(rows, "customer_id long, invoice_no long, invoice_date timestamp, unit_price double, n long").withColumns({"quantity": F.lit(1), "line_cents": F.lit(5)})
    cuts = ["1999-01-15", "1999-06-30", "1999-12-31"]
    visits = AT.visits_of(df, cuts)
    got = [sorted(map(tuple, AT.prices_at(df, cuts, visits, most=m).select("cut", "customer_id", "price_p25").collect())) for m in (0, 10, 1000)]
    assert got[0] == got[1] == got[2] and len(got[0]) == 9


def test_visits_go_to_the_cuts_summed_up(spark):
    """A customer's sums are taken before they are repeated by cut."""
    day = dt.datetime(1999, 1, 1)
    df = spark.createDataFrame([(1, 1, day, 2.0, 1)], "customer_id long, invoice_no long, invoice_date timestamp, unit_price double, n long")
    spans = AT.from_span(AT.visits_of(df.withColumns({"quantity": F.lit(1), "line_cents": F.lit(5)}), ["1999-01-15", "1999-06-30"]), ["1999-01-15", "1999-06-30"])
    assert [str(r.cut) for r in spans.orderBy("cut").collect()] == ["1999-01-15", "1999-06-30"]


def test_text_is_lower_cased_once(spark):
    df = spark.createDataFrame([("A TeaLight",), ("pencil BAG",), (None,), ("",), ("Lunch box",)], "t string").select(X.categorize(F.col("t")).alias("c"))
    assert df._jdf.queryExecution().optimizedPlan().toString().count("lower(") <= 1
    assert [r.c for r in df.collect()] == ["CANDLE & HOLDER", "BAG", "HOME DECOR & OTHER", "HOME DECOR & OTHER", "STORAGE"]


def test_bins_without_a_call_per_edge(spark):
    df = spark.createDataFrame([("x", float(i % 13)) for i in range(200)], "feature string, value double")
    assert "lambdafunction" not in DR.psi_long(df, df, 10)._jdf.queryExecution().optimizedPlan().toString().split("Join")[1]
