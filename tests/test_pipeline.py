"""The recompute driver end to end."""

from shelfwise.plans.recompute import recompute
from shelfwise.sources.canonical import CUT_DATE, Tables


def test_recompute(spark, sf, tmp_path):
    t = Tables(spark, sf)
    lines = t.sales("customer_id", "invoice_no", "stock_code", "quantity", "unit_price", "line_cents", "invoice_date", "brand")
    out = recompute(lines, str(tmp_path), CUT_DATE, min_cluster=5)
    assert all(df.count() > 0 for df in out.values())
    assert out["sales_predictions"].count() == 12
    names = {(r["model_name"], r["metric_name"]) for r in out["model_metrics"].collect()}
    assert ("Churn", "optimal_threshold") in names and ("Association", "global_rules_count") in names
    again = recompute(lines, str(tmp_path), CUT_DATE, min_cluster=5)
    assert again["model_metrics"].count() == out["model_metrics"].count()


def test_model_queries_give_rows(spark, sf):
    from __spark_entry__ import oracle_sql, queries
    fits = ["km6_k_search", "km13_hopkins", "ml6_calibration", "ml14_next_purchase", "ml19_persist_scores", "ts7_harmonic_blend", "ts14_bootstrap"]
    qs = queries()
    assert not set(fits) & set(oracle_sql())
    for k in fits:
        assert qs[k](spark, sf).count() > 0
