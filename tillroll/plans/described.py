"""The analyses the reference describes in prose, bound to the driver tables.

Each key reads the driver tables (directly or through the bindings in
sources/binding.py) and returns a DataFrame whose DECIMAL columns are cast
to DOUBLE last.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tillroll.functions.columns import decimals_to_double, pct
from tillroll.operators import calendar, cost, fuzzy, hr, lifetime, measures, quality
from tillroll.operators import customer as cust
from tillroll.operators import join as jn
from tillroll.operators import time as tm
from tillroll.sources import binding as b
from tillroll.sources import sketches
from tillroll.sources.binding import o_return, sales_line, users
from tillroll.sources.tables import read_table

# Driver bindings of the described analyses' parameters (fixed values).
SEGMENT_BANDS = [(1_000_000, "Low"), (3_000_000, "Medium"), (None, "High")]
RLS_MANAGER = "Chris"
BIDIRECTIONAL_CATEGORY = "PROMO"
CORR_COLUMNS = ["sales", "profit", "quantity_ordered_new", "unit_price"]
BIN_WIDTH = 10000
SHARED_CAPACITY = 100_000
ATTRITION_FACTORS = ("overtime", "business_travel", "department", "job_role", "gender", "ethnicity", "age_bracket")
RETURN_FACTORS = ("ship_mode", "product_category", "product_container", "order_priority", "customer_segment")


def _out(df):
    return decimals_to_double(df)


def _sl(spark, sf_dir, *cols):
    return sales_line(spark, sf_dir, cols or None)


def _slo(spark, sf_dir, *cols):
    """Order-grain binding: for order-level groupings of additive measures."""
    return sales_line(spark, sf_dir, cols, grain="order")


def _data_end(spark, sf_dir):
    return read_table(spark, sf_dir, "orders").agg(F.max(F.to_date("o_orderdate"))).scalar()


# --- measures ---------------------------------------------------------------

def total_ytd(spark, sf_dir):
    return measures.total_ytd(_slo(spark, sf_dir, "order_date", "region", "sales"), "order_date", "sales", ["region"])


def same_period_last_year(spark, sf_dir):
    return measures.same_period_last_year(_slo(spark, sf_dir, "order_date", "sales"), "order_date", "sales")


def _summary(spark, sf_dir):
    sl = _sl(spark, sf_dir, "region", "customer_segment", "sales", "profit")
    return measures.summarize(sl, ["region", "customer_segment"],
                              {"sales": F.sum("sales"), "profit": F.sum("profit"), "lines": F.count(F.lit(1))})


def summarize(spark, sf_dir):
    return _out(_summary(spark, sf_dir))


def add_columns(spark, sf_dir):
    return _out(measures.add_columns(_summary(spark, sf_dir), {"margin_pct": pct("profit", "sales")}))


def categorize(spark, sf_dir):
    per = (_slo(spark, sf_dir, "customer_id", "sales").groupBy("customer_id")
           .agg(F.sum("sales").alias("t_sales")))
    return _out(measures.categorize(per, "t_sales", SEGMENT_BANDS, name="band"))


def value_if_single(spark, sf_dir):
    return measures.value_if_single(_slo(spark, sf_dir, "city", "state_province"), ["city"], "state_province",
                                    name="state_province")


def lookup_related(spark, sf_dir):
    fact = _sl(spark, sf_dir, "row_id", "region", "sales")
    return _out(measures.lookup_related(fact, users(spark, sf_dir), "region", ["manager"]))


def row_level_security(spark, sf_dir):
    return _out(measures.row_level_security(_sl(spark, sf_dir), users(spark, sf_dir), RLS_MANAGER))


def bidirectional_filter(spark, sf_dir):
    dim = read_table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("customer_id"), "c_name",
                                                         "c_mktsegment")
    fact = _sl(spark, sf_dir, "customer_id", "product_category")
    return measures.bidirectional_filter(dim, fact, "customer_id", "customer_id",
                                         F.col("product_category") == BIDIRECTIONAL_CATEGORY)


def kpi_summary(spark, sf_dir):
    return measures.kpi_summary(sales_line(spark, sf_dir, ["sales", "profit"], grain="part"),
                                orders=_slo(spark, sf_dir, "order_id", "customer_id"))


def geo_performance(spark, sf_dir):
    return measures.geo_performance(_sl(spark, sf_dir, "region", "state_province", "sales", "profit"))


def segment_performance(spark, sf_dir):
    return measures.segment_performance(_sl(spark, sf_dir, "customer_segment", "sales", "profit"))


def orders_by_category(spark, sf_dir):
    return measures.orders_by_category(_sl(spark, sf_dir, "product_category", "order_id"))


def sales_by_weekday(spark, sf_dir):
    return measures.sales_by_weekday(_slo(spark, sf_dir, "order_date", "sales"))


def shipping_effectiveness(spark, sf_dir):
    return measures.shipping_effectiveness(b.delivery_lines(spark, sf_dir))


def shipping_effectiveness_by_state(spark, sf_dir):
    return measures.shipping_effectiveness(b.delivery_lines(spark, sf_dir, by_state=True), ["state_province"])


def region_sales_net_of_returns(spark, sf_dir):
    sl = sales_line(spark, sf_dir, ["region", "sales"],
                    order_join=(o_return(spark, sf_dir), "left", {"_rid": "order_id"}))
    return measures.region_sales_net_of_returns_joined(sl)


def state_revenue(spark, sf_dir):
    return measures.state_revenue(_slo(spark, sf_dir, "state_province", "sales"))


def priority_by_customer(spark, sf_dir):
    return measures.priority_by_customer(_slo(spark, sf_dir, "customer_id", "order_priority", "lines"))


# --- time -------------------------------------------------------------------

def mom_change(spark, sf_dir):
    return measures.mom_change(_sl(spark, sf_dir, "order_date", "sales", "profit"))


def weekly_trend(spark, sf_dir):
    return tm.period_trend(_slo(spark, sf_dir, "order_date", "sales"), "week")


def monthly_trend(spark, sf_dir):
    return tm.period_trend(_slo(spark, sf_dir, "order_date", "sales"), "month")


def seasonality_index(spark, sf_dir):
    return tm.seasonality_index(_slo(spark, sf_dir, "order_date", "sales"))


def sales_anomalies(spark, sf_dir):
    return tm.sales_anomalies(_slo(spark, sf_dir, "order_date", "sales"))


CALENDAR = ["state_province", "product_sub_category"]


def _cal(spark, sf_dir):
    return _sl(spark, sf_dir, "order_date", "sales", *CALENDAR)


def total_ytd_calendar(spark, sf_dir):
    return calendar.total_ytd_calendar(_cal(spark, sf_dir), CALENDAR)


def same_period_calendar(spark, sf_dir):
    return calendar.same_period_calendar(_cal(spark, sf_dir), CALENDAR)


def moving_average_calendar(spark, sf_dir):
    return calendar.moving_average_calendar(_cal(spark, sf_dir), CALENDAR)


def mom_change_calendar(spark, sf_dir):
    return calendar.mom_change_calendar(_cal(spark, sf_dir), CALENDAR)


def rolling_customers(spark, sf_dir):
    """Customers of the twelve months that end with each month, per region, from monthly sketches."""
    return sketches.rolling_customers(_slo(spark, sf_dir, "order_date", "region", "customer_id"), ["region"])


# --- customers ----------------------------------------------------------------

def true_churn(spark, sf_dir):
    return cust.true_churn(_slo(spark, sf_dir, "customer_id", "order_date"))


def churn_retention_corr(spark, sf_dir):
    return cust.churn_retention_corr(_slo(spark, sf_dir, "customer_id", "order_date"))


def customer_lifetime_value(spark, sf_dir):
    sl = _sl(spark, sf_dir, "customer_id", "order_id", "sales", "profit", "order_date")
    return _out(cust.customer_lifetime_value(sl))


def clv_drivers(spark, sf_dir):
    return cust.clv_drivers(_sl(spark, sf_dir, "customer_id", "order_id", "sales", "profit", "order_date"))


def customer_lifetime_forecast(spark, sf_dir):
    """Expected months with orders, and their value, of every customer's next year."""
    return lifetime.customer_lifetime_forecast(_slo(spark, sf_dir, "customer_id", "order_date", "sales"))


# --- EDA / quality ----------------------------------------------------------------

def null_profile(spark, sf_dir):
    keep = {"return_order_id": "order_id", "order_status": "order_status"}
    return quality.null_profile(sales_line(spark, sf_dir, order_join=(o_return(spark, sf_dir), "left", keep),
                                           first="part"))


def _delivery(spark, sf_dir):
    """Delivery days per line; a ship date before the order date is invalid and
    becomes NULL (missing), which the imputation then fills."""
    sl = _sl(spark, sf_dir, "row_id", "ship_mode", "ship_date", "order_date")
    days = F.datediff("ship_date", "order_date")
    return sl.select("row_id", "ship_mode", F.when(days >= 0, days).alias("delivery_days"))


def impute_median(spark, sf_dir):
    return quality.impute_median(_delivery(spark, sf_dir), ["delivery_days"], ["ship_mode"], bounded_domain=True,
                                 row_key=["row_id"])


def iqr_outliers(spark, sf_dir):
    sl = _sl(spark, sf_dir, "row_id", "product_category", "sales")
    return _out(quality.iqr_outliers(sl, "sales", ["product_category"], row_key=["row_id"]))


def winsorize(spark, sf_dir):
    sl = _sl(spark, sf_dir, "row_id", "profit")
    return _out(quality.winsorize(sl, "profit", 0.05, 0.95, name="profit_w"))


def box_stats(spark, sf_dir):
    return _out(quality.box_stats(_sl(spark, sf_dir, "product_category", "sales"), "sales", ["product_category"]))


def category_frequency(spark, sf_dir):
    return quality.category_frequency(_slo(spark, sf_dir, "customer_segment", "lines"), "customer_segment")


def correlation_matrix(spark, sf_dir):
    return quality.correlation_matrix(_sl(spark, sf_dir, *CORR_COLUMNS), CORR_COLUMNS)


def binned_pairs(spark, sf_dir):
    return quality.binned_pairs(_sl(spark, sf_dir, "sales", "profit"), "sales", "profit", BIN_WIDTH, BIN_WIDTH)


def deduplicate(spark, sf_dir):
    sl = _sl(spark, sf_dir, "order_id", "row_id", "customer_id", "sales")
    return _out(quality.deduplicate(sl, ["order_id"], ["row_id"]))


def duplicate_summary(spark, sf_dir):
    return quality.duplicate_summary(read_table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


def inconsistent_names(spark, sf_dir):
    """Product names that are nearly equal: at most two edits apart."""
    return fuzzy.inconsistent_values(read_table(spark, sf_dir, "part"), "p_name", k=2)


def validate(spark, sf_dir):
    """Every rule runs on the base tables, before any join could drop the rows it looks for."""
    t = lambda n: read_table(spark, sf_dir, n)
    li, orders = t("lineitem"), t("orders")
    checks = {
        "line_rules": quality.row_rules(li, {
            "order_id_not_null": F.col("l_orderkey").isNull(),
            "negative_sales": F.col("l_extendedprice") < 0,
            "discount_out_of_range": (F.col("l_discount") < 0) | (F.col("l_discount") > 1),
        }),
        "order_rules": quality.row_rules(orders, {"customer_id_not_null": F.col("o_custkey").isNull()}),
        "ship_before_order": li.select("l_orderkey", "l_shipdate")
        .join(orders.select(F.col("o_orderkey").alias("l_orderkey"), "o_orderdate"), "l_orderkey")
        .agg(F.count_if(F.to_date("l_shipdate") < F.to_date("o_orderdate")).alias("violations")),
        "line_unique": quality.unique_rule(li, ["l_orderkey", "l_linenumber"]),
        "order_unique": quality.unique_rule(orders, ["o_orderkey"]),
        "region_unique": quality.unique_rule(t("region"), ["r_name"]),
        "lineitem_order_fk": quality.foreign_key_rule(li, orders, "l_orderkey", "o_orderkey"),
        "lineitem_part_fk": quality.foreign_key_rule(li, t("part"), "l_partkey", "p_partkey"),
        "order_customer_fk": quality.foreign_key_rule(orders, t("customer"), "o_custkey", "c_custkey"),
    }
    return quality.validate(checks)


def normalize(spark, sf_dir):
    sl = _sl(spark, sf_dir, "row_id", "customer_segment", "sales", "profit")
    return _out(quality.normalize(sl, ["sales", "profit"], ["customer_segment"]))


# --- workforce ----------------------------------------------------------------------

def _emp(spark, sf_dir):
    return b.employees(spark, sf_dir)


def attrition_by_year_top(spark, sf_dir):
    return hr.attrition_by_year_top(_emp(spark, sf_dir))


def top_roles_per_department(spark, sf_dir):
    return hr.top_roles_per_department(_emp(spark, sf_dir))


def top_groups(spark, sf_dir):
    return hr.top_groups(_emp(spark, sf_dir))


def age_brackets(spark, sf_dir):
    return hr.age_brackets(_emp(spark, sf_dir))


def avg_by_group(spark, sf_dir):
    return hr.avg_by_group(_emp(spark, sf_dir))


def gender_by_bracket(spark, sf_dir):
    return hr.gender_by_bracket(_emp(spark, sf_dir))


def gender_by_bracket_group(spark, sf_dir):
    return hr.gender_by_bracket(_emp(spark, sf_dir), with_group=True)


def snowflake_join(spark, sf_dir):
    t = lambda n: read_table(spark, sf_dir, n)
    wide = jn.snowflake_join(t("orders"), [(t("customer"), "o_custkey", "c_custkey"),
                                           (t("nation"), "c_nationkey", "n_nationkey"),
                                           (t("region"), "n_regionkey", "r_regionkey")])
    return wide.select("o_orderkey", F.to_date("o_orderdate").alias("order_date"), "c_name", "n_name", "r_name")


def review_history(spark, sf_dir):
    return hr.review_history(_sl(spark, sf_dir, "customer_id", "order_date", "sales", "order_id"))


def hiring_trend(spark, sf_dir):
    return hr.hiring_trend(_emp(spark, sf_dir))


def rate_by_factor(spark, sf_dir):
    return hr.rate_by_factor(_emp(spark, sf_dir))


def rate_by_year(spark, sf_dir):
    return hr.rate_by_year(_emp(spark, sf_dir), _data_end(spark, sf_dir))


def rate_within_department(spark, sf_dir):
    return hr.rate_within(_emp(spark, sf_dir))


def risky_tenure(spark, sf_dir):
    return hr.risky_tenure(_emp(spark, sf_dir), _data_end(spark, sf_dir))


def rate_by_tenure(spark, sf_dir):
    return hr.rate_by_tenure(_emp(spark, sf_dir), _data_end(spark, sf_dir))


def survival_by_tenure(spark, sf_dir):
    return hr.survival_by_tenure(_emp(spark, sf_dir), _data_end(spark, sf_dir))


def median_tenure(spark, sf_dir):
    return hr.median_tenure(_emp(spark, sf_dir), _data_end(spark, sf_dir))


def attrition_factors(spark, sf_dir):
    return hr.factor_importance(_emp(spark, sf_dir).withColumn("age_bracket", hr.age_bracket()), "attrition", "Yes", ATTRITION_FACTORS)


def return_factors(spark, sf_dir):
    """Which attributes of an order line go with its return."""
    lines = sales_line(spark, sf_dir, ["ship_mode", "product_category", "product_container", "order_priority", "customer_segment"],
                       order_join=(o_return(spark, sf_dir), "left", {"returned": "order_status"}))
    return hr.factor_importance(lines.withColumn("returned", F.coalesce("returned", F.lit("Kept"))), "returned", "Returned", RETURN_FACTORS)


# --- make versus buy -----------------------------------------------------------------

def unit_cost(spark, sf_dir):
    return _out(cost.unit_cost(b.make_components(spark, sf_dir), b.supplier_quotes(spark, sf_dir)))


def _sourced(spark, sf_dir):
    return cost.sourced(b.make_components(spark, sf_dir), b.supplier_quotes(spark, sf_dir), b.MAKE_NRE)


def extended_cost(spark, sf_dir):
    return _out(cost.extended_cost(_sourced(spark, sf_dir)))


def full_cost(spark, sf_dir):
    return _out(cost.full_cost(_sourced(spark, sf_dir)))


def incremental_capacity(spark, sf_dir):
    return _out(cost.incremental_capacity(b.item_demand(spark, sf_dir), b.CAPACITY_UNITS, b.MACHINE_CAPACITY,
                                          b.MACHINE_COST))


def make_cost_breakdown(spark, sf_dir):
    return cost.make_cost_breakdown(b.make_components(spark, sf_dir))


def make_vs_buy(spark, sf_dir):
    return cost.make_vs_buy(b.make_components(spark, sf_dir), b.supplier_quotes(spark, sf_dir), b.MAKE_NRE, b.CAPACITY_UNITS, b.MACHINE_CAPACITY,
                            b.MACHINE_COST)


def shared_capacity(spark, sf_dir):
    return cost.shared_capacity(b.make_components(spark, sf_dir), b.supplier_quotes(spark, sf_dir), SHARED_CAPACITY)


DESCRIBED = {name: fn for name, fn in list(globals().items())
             if callable(fn) and not name.startswith("_") and getattr(fn, "__module__", None) == __name__}
