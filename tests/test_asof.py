"""Features at many cuts from one table, against one build per cut."""

import pytest
from pyspark.sql import functions as F

from shelfwise.operators import asof as AT
from shelfwise.operators import features as FT
from shelfwise.session import materialize
from shelfwise.sources.canonical import Tables

CUTS, END = ["1998-06-30", "2000-12-31", "2001-03-31"], "2001-06-30"


@pytest.fixture(scope="module")
def lines(spark, sf):
    t = Tables(spark, sf).sales("customer_id", "invoice_no", "stock_code", "quantity", "unit_price", "line_cents", "invoice_date")
    day = F.col("invoice_date").cast("timestamp")  # times of day, so that hours, windows and gaps are not all whole days
    return materialize(t.withColumn("invoice_date", day + F.make_dt_interval(F.lit(0), (F.col("invoice_no") % 23).cast("int"))))


def same(a, b):
    if isinstance(a, float) and isinstance(b, float):
        return a == b or abs(a - b) <= 1e-7 * max(1.0, abs(a), abs(b))
    return a == b


def test_three_cuts_equal_three_builds(spark, lines):
    got = AT.churn_features_at(lines, CUTS, END)
    rows = {(str(r["cut"]), r["customer_id"]): r.asDict() for r in got.collect()}
    n = 0
    for cut in CUTS:
        want = FT.churn_features(lines, cut, END)
        assert set(want.columns) | {"cut"} == set(got.columns)
        for r in want.collect():
            n += 1
            mine = rows[cut, r["customer_id"]]
            off = {c: (mine[c], v) for c, v in r.asDict().items() if not same(mine[c], v)}
            assert not off, (cut, r["customer_id"], off)
    assert n == len(rows) > 100


def test_one_reading(spark, lines, tmp_path):
    """Once the lines are summed up, no plan of the features reads them."""
    lines.write.parquet(f"{tmp_path}/lines")
    f = AT.churn_features_at(spark.read.parquet(f"{tmp_path}/lines"), CUTS, END)
    assert not any(str(tmp_path) in x for x in f.inputFiles())


def test_label_ends_by_cut(spark, lines):
    summed = AT.summed_lines(lines)
    got = {(str(r["cut"]), r["customer_id"]): r["first_label_purchase"] for r in AT.first_after(summed, CUTS[:2], ["1998-08-31", None]).collect()}
    for cut, end in zip(CUTS, ("1998-08-31", "9999-12-31")):
        after = lines.where((F.col("invoice_date") >= F.date_add(F.lit(cut).cast("date"), 1)) & (F.col("invoice_date") <= F.lit(end).cast("timestamp")))
        want = {(cut, r["customer_id"]): r["d"] for r in after.groupBy("customer_id").agg(F.to_date(F.min("invoice_date")).alias("d")).collect()}
        assert {k: v for k, v in got.items() if k[0] == cut} == want


def test_some_columns(lines):
    """A few columns are the same as in the whole build, and what they do not need is not built."""
    whole = {r["customer_id"]: r for r in FT.churn_features(lines, CUTS[1], END).collect()}
    for cols in (["relative_freq_trend", "last_interval_ratio"], ["last_purchase", "first_label_purchase", "is_churn"], ["price_range", "spend_peak_month"],
                 ["is_bulk_buyer"], ["churn_risk_score", "prediction_tier"], ["total_orders"]):
        part = FT.churn_features(lines, CUTS[1], END, columns=cols)
        rows = part.select("customer_id", *cols).collect()
        assert len(rows) == len(whole)
        assert all(same(r[c], whole[r["customer_id"]][c]) for r in rows for c in cols)
        assert len(part.columns) < len(whole[rows[0]["customer_id"]])
