"""The reference's named queries, bound to the driver tables.

Each entry is ``key -> (spark, sf_dir) -> DataFrame``. The order-line table is
built with only the columns the query reads, so unreferenced dimension joins
are never planned. Literals of the reference that do not exist in the driver
data (a city, a customer, a product, thresholds) are parameters; the values
stay the reference's.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tillroll.functions.columns import decimals_to_double, month_of_year
from tillroll.operators import aggregate as agg
from tillroll.operators import customer as cust
from tillroll.operators import join as jn
from tillroll.operators import rank as rk
from tillroll.operators import text as tx
from tillroll.operators import time as tm
from tillroll.sources.binding import o_return, sales_line, users
from tillroll.sources.tables import describe

# Driver bindings of the reference's literals (fixed values).
DRIVER_PARAMS = {
    "city": "CITY_7",
    "customer_name": "Customer#000000011",
    "customer_month": 6,
    "product_prefix": "red",
    "product_name": "red bolt 7",
    "state": "NATION_7",
    "row_id": "5059-4-273-97-17644.27",
    "return_order_id": 7,
    "special_manager": "Chris",
    "bonus_low": 8_000_000,
    "bonus_high": 8_200_000,
    "coupon_today": "2001-09-01",
    "coupon_days": 118,
    "n_categories": 6,
    "n_regions": 5,
    "subcat_min_len": 7,
    "nth_position": 863,
    "max_value": 3000,
}
P = DRIVER_PARAMS


def q(fn, *cols, **kw):
    """Bind an operator over the order-line columns it needs."""
    def run(spark, sf_dir):
        return fn(sales_line(spark, sf_dir, cols), **kw)
    run.__name__ = fn.__name__
    return run


def qo(fn, *cols, **kw):
    """Bind an operator that groups by order-level attributes and only sums
    additive measures (or needs no measure) to the order-grain binding."""
    def run(spark, sf_dir):
        return fn(sales_line(spark, sf_dir, cols, grain="order"), **kw)
    run.__name__ = fn.__name__
    return run


def qp(fn, *cols, **kw):
    """Bind an operator that groups by part attributes and only sums additive
    measures (or needs no measure) to the part-grain binding."""
    def run(spark, sf_dir):
        return fn(sales_line(spark, sf_dir, cols, grain="part"), **kw)
    run.__name__ = fn.__name__
    return run


def q_users(fn, *cols, **kw):
    def run(spark, sf_dir):
        return fn(sales_line(spark, sf_dir, cols), users(spark, sf_dir), **kw)
    run.__name__ = fn.__name__
    return run


def _all(fn, **kw):
    def run(spark, sf_dir):
        return fn(sales_line(spark, sf_dir), **kw)
    run.__name__ = fn.__name__
    return run


def _every(fn, **kw):
    """Bind an operator that returns every order line whole: part meets the lines first."""
    def run(spark, sf_dir):
        return fn(sales_line(spark, sf_dir, first="part"), **kw)
    run.__name__ = fn.__name__
    return run


def _scan_returns(spark, sf_dir):
    return o_return(spark, sf_dir)


_RETURN_COLS = {"return_order_id": "order_id", "order_status": "order_status"}


def _returned_orders_by_region(period):
    def run(spark, sf_dir):
        sl = sales_line(spark, sf_dir, ["order_id", "region", "order_date"],
                        order_join=(o_return(spark, sf_dir), "inner", {"return_order_id": "order_id"}))
        when = F.col("order_date") if period == "date" else month_of_year("order_date").alias("monthly")
        out = sl.select("order_id", "return_order_id", "region", when)
        return out.orderBy("region", out.columns[-1], "order_id")
    return run


def _returned_order_details(spark, sf_dir):
    """Q13 with the returns semi join applied to lineitem, before the dimensions."""
    return decimals_to_double(sales_line(spark, sf_dir, order_join=(o_return(spark, sf_dir), "left_semi", {})))


def _orders_with_returns(spark, sf_dir):
    """Q69 with the returns left join applied on the order key's partitions, beside the orders join."""
    return decimals_to_double(sales_line(spark, sf_dir, order_join=(o_return(spark, sf_dir), "left", _RETURN_COLS), first="part"))


def _lookup_return(spark, sf_dir):
    return jn.lookup_return(o_return(spark, sf_dir), P["return_order_id"])


def _sales_extremes(spark, sf_dir):
    sl = sales_line(spark, sf_dir, ["order_date", "state_province", "region", "product_name", "product_sub_category", "sales"])
    return agg.sales_extremes(sl, {"month": month_of_year("order_date"), "state": F.col("state_province"), "region": F.col("region"),
                                   "product": F.col("product_name"), "sub_category": F.col("product_sub_category")})


def _peak_return_period(spark, sf_dir):
    returned = sales_line(spark, sf_dir, ["order_id", "region", "order_date"],
                          order_join=(o_return(spark, sf_dir), "left_semi", {}))
    return agg.peak_return_period(returned)


NAMED = {
    "top_ship_mode_by_state": q(rk.top_ship_mode_by_state, "state_province", "ship_mode"),
    "ship_mode_winner_tally": q(rk.ship_mode_winner_tally, "state_province", "ship_mode"),
    "segment_order_count": qo(agg.segment_order_count, "customer_segment", "lines"),
    "product_subcat_region_count": q(agg.product_subcat_region_count, "product_category",
                                     "product_sub_category", "region"),
    "products_by_units_sold": q(agg.products_by_units_sold, "product_category", "product_sub_category", "region"),
    "sales_by_month": qo(agg.sales_by_month, "order_date", "sales"),
    "sales_by_month_state": qo(agg.sales_by_month_state, "order_date", "state_province", "sales"),
    "sales_month_subcat_rollup": q(agg.sales_month_subcat_rollup, "order_date", "product_sub_category", "sales"),
    "customer_totals": q(agg.customer_totals, "customer_id", "customer_name", "quantity_ordered_new",
                         "sales", "profit"),
    "returned_orders_by_region": _returned_orders_by_region("date"),
    "returned_orders_by_region_month": _returned_orders_by_region("month"),
    "refined_order_priority": _every(tx.refined_order_priority, old="NOT SPECIFIED"),
    "region_sales_contribution": qo(agg.region_sales_contribution, "region", "sales"),
    "month_region_contribution": q(agg.month_region_contribution, "order_date", "region", "sales", "profit"),
    "returned_order_details": _returned_order_details,
    "lookup_row": _all(jn.lookup_row, row_id=P["row_id"]),
    "lookup_return": _lookup_return,
    "long_subcategory_names": qp(tx.long_subcategory_names, "product_sub_category", min_len=P["subcat_min_len"]),
    "relabel_subcategory": _every(tx.relabel_subcategory),
    "monthname_region_sales_profit": q(agg.monthname_region_sales_profit, "order_date", "region", "sales",
                                       "profit"),
    "scan_orders": _every(decimals_to_double),
    "scan_returns": _scan_returns,
    "region_priority_container_index": q(rk.region_priority_container_index, "region", "order_priority",
                                         "product_container", "sales", "profit"),
    "region_sales_and_lines": qo(agg.region_sales_and_lines, "region", "state_province", "sales", "lines"),
    "manager_monthly_bonus": q_users(agg.manager_monthly_bonus, "region", "order_date", "sales", "profit",
                                     low=P["bonus_low"], high=P["bonus_high"], special_manager=P["special_manager"]),
    "bonus_rollup": q_users(agg.bonus_rollup, "region", "order_date", "sales", "profit",
                            low=P["bonus_low"], high=P["bonus_high"], special_manager=P["special_manager"]),
    "cities_per_region": qo(agg.cities_per_region, "state_province", "city", "region"),
    "states_per_city": qo(agg.states_per_city, "state_province", "city", "region"),
    "customers_in_city": qo(agg.customers_in_city, "city", "customer_name", city=P["city"]),
    "city_repeated_in_region": qo(agg.city_repeated_in_region, "state_province", "city", "region"),
    "city_drilldown": q(agg.city_drilldown, "state_province", "city", "region", "sales", "profit",
                        city=P["city"]),
    "city_repeated_states": qo(agg.city_repeated_states, "state_province", "city", "region"),
    "yearmonth_subcat_sales": q(agg.yearmonth_subcat_sales, "order_date", "product_category",
                                "product_sub_category", "sales"),
    "yearmonth_category_sales": q(agg.yearmonth_category_sales, "order_date", "product_category", "sales"),
    "covered_city_count": qo(agg.covered_city_count, "state_province", "city"),
    "ship_mode_cities_by_state": q(agg.ship_mode_cities_by_state, "state_province", "city", "ship_mode"),
    "widest_ship_mode_by_state": q(agg.widest_ship_mode_by_state, "state_province", "city", "ship_mode"),
    "customers_3plus_lines_month": qo(agg.customers_nplus_lines_month, "customer_id", "customer_name",
                                      "order_date", "lines"),
    "customer_month_lines": _all(tx.customer_month_lines, customer_name=P["customer_name"],
                                 month=P["customer_month"]),
    "customers_3plus_days_month": qo(cust.customers_nplus_days_month, "customer_id", "customer_name",
                                    "order_date"),
    "top2_products_per_category": qp(rk.top_products_per_category, "product_category", "product_name", "sales"),
    "product_sales": qp(agg.product_sales, "product_name", "sales"),
    "product_avg_sales": qp(agg.product_avg_sales, "product_name", "sales", "lines"),
    "product_avg_prefix": qp(agg.product_avg_prefix, "product_name", "sales", "lines", prefix=P["product_prefix"]),
    "lines_below_product_avg": q(jn.lines_below_product_avg, "product_name", "sales", *jn.LINE_KEY),
    "customer_day_below_product_avg": q(jn.customer_day_below_product_avg, "order_date", "customer_name",
                                        "product_name", "sales"),
    "region_active_customers": qo(agg.region_active_customers, "region", "customer_id", "sales"),
    "month_region_engagement": qo(agg.month_region_engagement, "order_date", "region", "customer_id", "sales"),
    "customers_in_n_categories": q(rk.customers_in_n_categories, "customer_id", "product_category",
                                   n=P["n_categories"]),
    "customers_by_value_bracket": qo(agg.customers_by_value_bracket, "customer_id", "sales"),
    "products_in_n_regions": q(rk.products_in_n_regions, "product_name", "region", n=P["n_regions"]),
    "product_region_drill": q(rk.product_region_drill, "product_name", "region", product=P["product_name"]),
    "subcategory_count": qp(agg.subcategory_count, "product_sub_category"),
    "subcategories_per_region": q(agg.subcategories_per_region, "region", "product_sub_category"),
    "subcat_cumulative_pct": qp(agg.subcat_cumulative_pct, "product_sub_category", "sales"),
    "top_subcat_per_region": q(rk.top_subcat_per_region, "product_sub_category", "region"),
    "top_subcat_per_region_rank": q(rk.top_subcat_per_region_rank, "product_sub_category", "region"),
    "customer_first_order": qo(cust.customer_first_order, "customer_id", "customer_name", "order_date"),
    "customer_lifespan": qo(cust.customer_lifespan, "customer_id", "customer_name", "order_date"),
    "lifespan_bins": qo(cust.lifespan_bins, "customer_id", "customer_name", "order_date"),
    "customer_lines": _all(tx.customer_lines, customer_name=P["customer_name"]),
    "coupon_eligibility": qo(cust.coupon_eligibility, "customer_id", "customer_name", "order_date",
                            today=P["coupon_today"], days=P["coupon_days"]),
    "top_product_per_state": q(rk.top_product_per_state, "state_province", "product_name"),
    "lines_above_month_avg": q(jn.lines_above_month_avg, "customer_id", "order_date", "product_name", "sales",
                               "profit"),
    "lines_above_month_region_subcat_avg": q(jn.lines_above_month_region_subcat_avg, "customer_id", "order_date",
                                             "region", "product_sub_category", "product_name", "sales", "profit",
                                             *jn.LINE_KEY),
    "best_and_worst_cells": q(rk.best_and_worst_cells, "region", "state_province", "product_category",
                              "product_sub_category", "sales"),
    "priority_by_region_state": qo(agg.priority_by_region_state, "region", "state_province", "order_priority", "lines"),
    "priority_counts": qo(agg.priority_counts, "order_priority", "lines"),
    "retention_monthly": qo(cust.retention_monthly, "customer_id", "order_date"),
    "retention_crosscheck": qo(cust.retention_crosscheck, "customer_id", "order_date"),
    "churn_monthly": qo(cust.churn_monthly, "customer_id", "order_date"),
    "product_name_regex": q(tx.product_name_regex, "product_name"),
    "orders_with_returns": _orders_with_returns,
    "state_share_of_totals": qo(agg.state_share_of_totals, "region", "state_province", "sales", state=P["state"]),
    "nth_sales_value": q(rk.nth_sales_value, "sales", n=P["nth_position"]),
    "sales_value_index": q(rk.sales_value_index, "sales", max_value=P["max_value"]),
    "mom_sales_diff": qo(tm.mom_sales_diff, "order_date", "sales"),
    "avg_mom_pct_change": qo(tm.avg_mom_pct_change, "order_date", "sales"),
    "avg_line_vs_avg_month": q(agg.avg_line_vs_avg_month, "order_date", "sales"),
    "month_region_sales": qo(agg.month_region_sales, "order_date", "region", "sales"),
    "customer_months": qo(cust.customer_month_of_year, "customer_id", "order_date"),
    "customer_month_retained_flag": qo(cust.customer_month_retained_list, "customer_id", "order_date"),
    "retained_flag_by_geo": qo(cust.retained_flag_by_geo, "customer_id", "order_date", "state_province", "region"),
    "describe_orders": _every(describe),
    "customer_extremes": q(agg.customer_extremes, "customer_id", "customer_name", "quantity_ordered_new", "sales", "profit"),
    "sales_extremes": _sales_extremes,
    "peak_return_period": _peak_return_period,
    "ship_mode_counts": q(agg.ship_mode_counts, "ship_mode", "order_id"),
    "order_line_vs_order_count": q(agg.order_line_vs_order_count, "order_id"),
    "best_ship_mode_by_state": q(rk.best_ship_mode_by_state, "state_province", "ship_mode", "profit"),
    "subcat_share_in_category": qp(agg.subcat_share_in_category, "product_category", "product_sub_category", "lines"),
    "median_profit": q(rk.median_profit, "profit"),
    "top_state_per_month": q(rk.top_state_per_month, "order_date", "state_province", "profit"),
    "month_share_of_sales_profit": q(agg.month_share_of_sales_profit, "order_date", "sales", "profit"),
    "total_sales": q(agg.total_sales, "sales"),
    "pct_growth_per_month": qo(tm.pct_growth_per_month, "order_date", "sales"),
    "row_count": q(agg.row_count, "row_id"),
}
