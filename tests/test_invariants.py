
import math
from collections import defaultdict

from tillroll.plans.registry import QUERIES


def _rows(spark, sf, key):
    return [r.asDict() for r in QUERIES[key](spark, sf).collect()]


def test_contributions_sum_to_100(spark, sf_small):
    assert math.isclose(sum(r["perc_contribution"] for r in _rows(spark, sf_small, "region_sales_contribution")),
                        100.0, rel_tol=1e-12)
    rows = _rows(spark, sf_small, "month_region_contribution")
    assert math.isclose(sum(r["perc_t_sales"] for r in rows), 100.0, rel_tol=1e-12)
    per_cat = defaultdict(float)
    for r in _rows(spark, sf_small, "subcat_share_in_category"):
        per_cat[r["product_category"]] += r["percentage"]
    assert all(math.isclose(v, 100.0, rel_tol=1e-12) for v in per_cat.values())


def test_rollup_totals_are_sums_of_parts(spark, sf_small):
    rows = _rows(spark, sf_small, "sales_month_subcat_rollup")
    grand = [r["t_sales"] for r in rows if r["months"] is None]
    cells = [r for r in rows if r["months"] is not None and r["product_sub_category"] is not None]
    total = _rows(spark, sf_small, "total_sales")[0]["total_sales"]
    assert grand == [total]
    assert math.isclose(sum(r["t_sales"] for r in cells), total, rel_tol=1e-12)
    by_month = defaultdict(float)
    for r in cells:
        by_month[r["months"]] += r["t_sales"]
    for r in rows:
        if r["months"] is not None and r["product_sub_category"] is None:
            assert math.isclose(by_month[r["months"]], r["t_sales"], rel_tol=1e-12)


def test_retention_plus_churn_is_total(spark, sf_small):
    ret = {r["monthly"]: r for r in _rows(spark, sf_small, "retention_monthly")}
    for c in _rows(spark, sf_small, "churn_monthly"):
        r = ret[c["months"]]
        assert r["retention_count"] + c["customer_churn"] == r["total_count"] == c["total_customers"]


def test_true_churn_bounds(spark, sf_small):
    for r in _rows(spark, sf_small, "true_churn"):
        assert 0 <= r["lost"] <= r["prior_customers"]


def test_best_cell_not_below_worst(spark, sf_small):
    rows = _rows(spark, sf_small, "best_and_worst_cells")
    for cat in {r["product_category"] for r in rows}:
        vals = [r["t_sales"] for r in rows if r["product_category"] == cat]
        assert max(vals) >= min(vals) and len(vals) >= 2


def test_q52_is_q53_and_order_lines_add_up(spark, sf_small):
    a = sorted((r["region"], r["product_sub_category"], r["max_occurance"])
               for r in _rows(spark, sf_small, "top_subcat_per_region"))
    b = sorted((r["region"], r["product_sub_category"], r["occurance"])
               for r in _rows(spark, sf_small, "top_subcat_per_region_rank"))
    assert a == b
    lines = _rows(spark, sf_small, "order_line_vs_order_count")[0]
    assert lines["lines"] == _rows(spark, sf_small, "row_count")[0]["cnt"] >= lines["orders"]
