"""Decision tables, thresholds, golden cases and empty inputs on hand-made frames."""

import itertools

import pytest
from pyspark.sql import functions as F

from shelfwise import schemas as S
from shelfwise.functions import scalars as X
from shelfwise.operators import catalogue as C
from shelfwise.operators import cleaning as CL
from shelfwise.operators import kpis as K
from shelfwise.operators import lifecycle as O
from shelfwise.operators import quality as Q
from shelfwise.operators import rfm as R
from shelfwise.operators import segments as SG
from shelfwise.sources import readers, sinks


def col(spark, values, ddl):
    return spark.createDataFrame([(v,) for v in values], f"v {ddl}")


def expected_segment(r, f, m):
    """The decision table, row by row, as sets of score triples."""
    high = set(itertools.product((4, 5), (4, 5), (4, 5)))
    potential = set(itertools.product((3, 4, 5), repeat=3)) - high
    low = set(itertools.product((1, 2), repeat=3))
    at_risk = set(itertools.product((1, 2), (3, 4, 5), range(1, 6)))
    for name, group in ((S.SEG_HIGH, high), (S.SEG_POTENTIAL, potential), (S.SEG_LOW, low), (S.SEG_AT_RISK, at_risk)):
        if (r, f, m) in group:
            return name
    return S.SEG_GENERAL


def test_segment_table(spark):
    df = spark.createDataFrame(list(itertools.product(range(1, 6), repeat=3)), "r int, f int, m int")
    got = df.withColumn("s", R.segment_of(F.col("r"), F.col("f"), F.col("m"))).collect()
    assert len(got) == 125
    assert all(x["s"] == expected_segment(x["r"], x["f"], x["m"]) for x in got)


def test_score_edges(spark):
    def scores(f, values):
        return [x[0] for x in col(spark, values, "long").select(f(F.col("v"))).collect()]
    assert scores(X.r_score, [30, 31, 90, 91, 180, 181, 365, 366]) == [5, 4, 4, 3, 3, 2, 2, 1]
    assert scores(X.f_score, [1, 2, 4, 5, 9, 10, 19, 20]) == [1, 2, 2, 3, 3, 4, 4, 5]
    assert scores(X.m_score, [9999, 10000, 49999, 50000, 199999, 200000, 499999, 500000]) == [1, 2, 2, 3, 3, 4, 4, 5]
    assert scores(lambda c: X.m_score(c, "pounds"), [99, 100, 500, 2000, 5000]) == [1, 2, 3, 4, 5]


def test_risk_and_histogram_edges(spark):
    ps = [0.0, 0.2, 0.4, 0.5, 0.6, 0.8, 0.85, 1.0]
    df = col(spark, ps, "double").select(F.col("v").alias("churn_prob"), (F.col("v") >= 0.5).alias("is_churn_risk"), F.lit("pending").alias("status"))
    got = [r[0] for r in df.select(X.risk_level(F.col("churn_prob"))).collect()]
    assert got == ["low", "low", "low", "medium", "medium", "medium", "high", "high"]
    assert {r["bucket"]: r["count"] for r in K.churn_histogram(df).collect()} == {
        "0-20%": 1, "20-40%": 1, "40-60%": 2, "60-80%": 1, "80-100%": 3}
    empty = K.churn_histogram(df.limit(0)).collect()
    assert len(empty) == 5 and all(r["count"] == 0 and r["rate"] == 0 for r in empty)


def test_cents_round_half_even(spark):
    assert [r[0] for r in col(spark, [0.025, 0.035, 1.25], "double").select(X.to_cents(F.col("v"))).collect()] == [2, 4, 125]


def test_week_starts_on_tuesday(spark):
    days = ["2024-01-01", "2024-01-02", "2024-01-08", "2024-01-09"]  # Monday, Tuesday, Monday, Tuesday
    got = [str(r[0]) for r in col(spark, days, "string").select(X.week_bucket(F.to_date("v"))).collect()]
    assert got == ["2023-12-26", "2024-01-02", "2024-01-02", "2024-01-09"]


def test_categories(spark):
    names = ["RED TOTE", "OPEN BOOK", "LUNCH BOX", "XMAS CAKE", "nothing here", "SIGNAL"]
    got = [r[0] for r in col(spark, names, "string").select(X.categorize(F.col("v"))).collect()]
    assert got == ["BAG", "STATIONERY", "STORAGE", "BAKING", S.CATEGORY_DEFAULT, "METAL SIGN"]
    whole = [r[0] for r in col(spark, names, "string").select(X.categorize(F.col("v"), word_boundary=True)).collect()]
    assert whole[1] == S.CATEGORY_DEFAULT and whole[5] == S.CATEGORY_DEFAULT


def test_product_names(spark):
    words = {"CUP": "杯子", "BOX": "盒子", "MUG": "马克杯"}
    cases = {"RED GLASS CUP": "红色玻璃杯子", "Red Glass Cup": "红色玻璃杯子", "BLUE METAL BOX": "蓝色金属盒子",
             "PURPLE CERAMIC MUG": "紫色陶瓷马克杯", "SET OF FOUR RED MUG": "4红色马克杯件套", "BOX & CUP": "盒子·杯子",
             "": "", "  ": "  ", "A": "A", "WITH THE": "WITH THE", "RED MUG 6 PACK": "红色马克杯6件装"}
    df = spark.createDataFrame([(k,) for k in cases] + [(None,)], "n string")
    d = df.withColumn("o", X.normalize_product_name(F.col("n"), dictionaries=(words, X.MATERIALS, X.COLORS)))
    got = {r["n"]: r["o"] for r in d.collect()}
    assert got.pop(None) is None
    assert got == cases


def test_email_codec(spark):
    df = col(spark, ["customer_12@customers.example", "customer_x@customers.example", "bob@customers.example", "customer_7@else"], "string")
    assert [r[0] for r in df.select(X.customer_of(F.col("v"))).collect()] == [12, None, None, None]


def test_pseudonym_matches_md5(spark):
    import hashlib
    got = spark.range(50).select("id", *X.pseudonym(F.col("id"))).collect()
    for i, first, last in got:
        h = int(hashlib.md5(str(i).encode()).hexdigest(), 16)
        assert (first, last) == (S.FIRST_NAMES[h % 10], S.LAST_NAMES[h // 10 % 10])


def test_invoice_csv(spark, tmp_path):
    p = tmp_path / "in.csv"
    p.write_bytes("\n".join([
        "InvoiceNo,StockCode,Description,Quantity,InvoiceDate,UnitPrice,CustomerID,Country",
        "1,A,caf\xe9 mug ,2,12/1/2010 8:26,2.5,17850,UK", "C2,A,mug,1,12/1/2010 8:26,2.5,17850,UK",
        "3,B,,1,12/1/2010 9:00,1.0,17850,UK", "4,B,pen,0,12/1/2010 9:00,1.0,17850,UK", "5,B,pen,-1,12/1/2010 9:00,1.0,17850,UK",
        "6,B,pen,1,12/1/2010 9:00,0,17850,UK", "7,B,pen,1,12/1/2010 9:00,1.0,,UK", "8,B,pen,3,2010-12-02 10:00:00,1.0,17851.0,UK",
    ]).encode("latin-1"))
    df = CL.positive_lines(CL.drop_cancelled(CL.drop_missing_keys(readers.read_invoices(spark, str(p)))))
    rows = CL.normalize_description(CL.with_line_total(df)).orderBy("invoice_no").collect()
    assert [(r["invoice_no"], r["description"], r["line_total"], r["customer_id"]) for r in rows] == [
        ("1", "CAFÉ MUG", 5.0, 17850), ("8", "PEN", 3.0, 17851)]
    assert all(r["invoice_date"] is not None for r in rows)


def test_catalogue_arguments(spark):
    p = spark.createDataFrame([(1, "a", True, "c", 10), (2, "b", True, "c", 20)], "product_id int, name string, is_active boolean, category_name string, price int")
    for bad in (dict(min_price=-1), dict(max_price=-5), dict(min_price=10, max_price=5)):
        with pytest.raises(ValueError):
            C.filter_products(p, **bad)
    with pytest.raises(ValueError):
        C.sort_products(p, by="weight")
    with pytest.raises(ValueError):
        C.page_of(p, ["product_id"], 0)
    assert C.page_of(p, ["product_id"], 9, 10).count() == 0
    assert [r["product_id"] for r in C.keyset_page(p, "price", "product_id", (20, 2), 5).collect()] == [1]


def test_ratings_without_reviews(spark):
    p = spark.createDataFrame([(1,), (2,)], "product_id int")
    r = spark.createDataFrame([(1, 5), (1, 4)], "product_id int, rating int")
    assert {x["product_id"]: (x["average"], x["count"]) for x in K.ratings(p, r).collect()} == {1: (4.5, 2), 2: (0.0, 0)}


def test_dashboard_on_empty_tables(spark):
    e = spark.createDataFrame
    row = K.dashboard(e([], "user_id int"), e([], "product_id int, is_active boolean"), e([], "total_cents long, status string"),
                      e([], S.CHURN), e([], S.METRICS)).first()
    assert all(v == 0 for v in row)


def test_oversell_in_arrival_order(spark):
    d = spark.createDataFrame([(1, 7, 3, "2024-01-01"), (2, 7, 3, "2024-01-01"), (3, 7, 3, "2024-01-02"), (4, 8, 1, "2024-01-02")],
                              "order_id int, product_id int, quantity long, created_at string").withColumn("created_at", F.to_date("created_at"))
    p = spark.createDataFrame([(7, 6), (8, 1)], "product_id int, stock int")
    got = {r["order_id"]: (r["running"], r["fits"]) for r in O.oversell_check(d, p).collect()}
    assert got == {1: (3, True), 2: (6, True), 3: (9, False), 4: (1, True)}


def test_transition_audit(spark):
    log = spark.createDataFrame([
        (1, None, "pending", "2024-01-01", 0), (1, "pending", "paid", "2024-01-02", 1), (1, "paid", "shipped", "2024-02-03", 2),
        (2, None, "pending", "2024-01-01", 0), (2, "pending", "delivered", "2024-03-02", 1), (2, "paid", "shipped", "2024-03-03", 2)],
        "order_id int, from_status string, to_status string, created_at string, seq int").withColumn("created_at", F.to_date("created_at"))
    got = {(r["order_id"], r["seq"]): (r["illegal"], r["broken"]) for r in O.audit_transitions(log).collect()}
    assert got == {(2, 1): (True, False), (2, 2): (False, True)}
    days = {(r["order_id"], r["status"]): r["days"] for r in O.time_in_status(log).collect()}
    assert days[(1, "pending")] == 1 and days[(1, "paid")] == 32 and days[(1, "shipped")] is None


def test_cart_merge_and_rejected_cart(spark):
    a = spark.createDataFrame([(1, 5, 2), (1, 5, 3), (2, 6, 1)], "user_id int, product_id int, quantity long")
    c = Q.merge_carts(a)
    assert {(r["user_id"], r["quantity"]) for r in c.collect()} == {(1, 5), (2, 1)}
    p = spark.createDataFrame([(5, 100, True), (6, 10, False)], "product_id int, price long, is_active boolean")
    assert {r["user_id"]: (r["accepted"], r["total_cents"]) for r in O.price_carts(c, p).collect()} == {1: (True, 500), 2: (False, 10)}


def test_metric_upsert_and_missing_artifact(spark, tmp_path):
    e = "model_name string, metric_name string, metric_value double, detail string, created_at timestamp"
    t0, t1 = "2024-01-01 00:00:00", "2024-01-02 00:00:00"
    def mk(rows):
        return spark.createDataFrame(rows, e.replace("timestamp", "string")).withColumn("created_at", F.to_timestamp("created_at"))
    got = sinks.upsert_metrics(mk([("a", "x", 1.0, "", t0), ("a", "y", 2.0, "", t0)]), mk([("a", "x", 3.0, "", t1)]))
    assert {(r["metric_name"], r["metric_value"]) for r in got.collect()} == {("x", 3.0), ("y", 2.0)}
    assert readers.read_artifact(spark, str(tmp_path / "none"), S.RFM).count() == 0
    assert readers.read_chart(spark, str(tmp_path), "Churn") is None


def test_business_labels(spark):
    n = S.CLUSTER_LABELS
    rows = [(999, 1.0, 1.0, 1.0, "outlier"), (0, 30.0, 8.0, 1.0, "loyal"), (1, 45.0, 4.0, 100.0, "high_loyal"), (2, 60.0, 3.0, 1.0, "active"),
            (3, 181.0, 1.0, 29.0, "deep_lost"), (4, 181.0, 1.0, 30.0, "lost"), (5, 121.0, 1.0, 1.0, "warning"), (6, 100.0, 1.0, 150.0, "big_rare"),
            (7, 90.0, 2.0, 1.0, "new"), (8, 100.0, 2.0, 1.0, "plain")]
    df = spark.createDataFrame(rows, "c int, r double, o double, s double, want string")
    got = df.select("want", SG.business_label(F.col("c"), F.col("r"), F.col("o"), F.col("s"), F.lit(100.0)).alias("got")).collect()
    assert all(r["got"] == n[r["want"]] for r in got)
