"""Customer lifecycle: first/last orders, retention, churn, month-over-month flags.

Scale notes
-----------
Every retention/churn operator starts from ``customer_months``: the distinct
(customer, month) pairs, a partial+final aggregate that shrinks order lines to
at most one row per customer and month. The month-to-month comparison is then
a ``lag`` over each customer's months. A customer's window holds at most one
row per calendar month, so even a customer with a third of all order lines
yields a tiny window partition; no line-level self-join (the m x n blow-up of
the reference's join on raw lines) is ever formed.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillroll.functions.columns import half_up_div, month_of_year, month_start

# Output labels that must read as the reference's.
COUPON_LABEL = "Coupon Eligible"
RETAINED_LABEL = "Total Retained Customers"
DISTINCT_LABEL = "Total Distinct Customers"
YES, NO = "Yes", "No"


def customer_months(sl: DataFrame) -> DataFrame:
    """Distinct (customer_id, month) with month = first day of the order month; as they stand where
    ``sl`` holds customer-months already (``materialize.read_customer_months``)."""
    if "order_date" not in sl.columns:
        return sl.select("customer_id", "month")
    return sl.select("customer_id", month_start("order_date").alias("month")).distinct()


def _with_previous(cm: DataFrame) -> DataFrame:
    """Add ``prev_month``: the customer's previous active month, when it is the
    calendar month just before."""
    w = Window.partitionBy("customer_id").orderBy("month")
    prev = F.lag("month").over(w)
    return cm.withColumn("prev_month", F.when(prev == F.add_months("month", -1), prev))


def retention_monthly(sl: DataFrame) -> DataFrame:
    """Per month M: customers of M also active in M-1, all customers of M, and
    their ratio rounded half-up to 2 dp (the reference's definition, in which
    'retention' is measured against the *previous* month)."""
    flagged = _with_previous(customer_months(sl))
    agg = flagged.groupBy("month").agg(
        F.count(F.col("prev_month")).alias("retention_count"),
        F.count(F.lit(1)).alias("total_count"))
    return (agg.select(F.col("month").alias("monthly"), "retention_count", "total_count",
                       half_up_div("retention_count", "total_count", 2).cast("double").alias("retention_rate"))
            .orderBy("monthly"))


def churn_monthly(sl: DataFrame) -> DataFrame:
    """Per month M: customers of M *not* active in M-1 ('customer_churn' as the
    reference names it), all customers of M and the ratio. Months where every
    customer was also active in M-1 have no row (the reference filters before
    grouping)."""
    flagged = _with_previous(customer_months(sl))
    agg = flagged.groupBy("month").agg(
        F.count(F.when(F.col("prev_month").isNull(), 1)).alias("customer_churn"),
        F.count(F.lit(1)).alias("total_customers"))
    return (agg.where(F.col("customer_churn") > 0)
            .select(F.col("month").alias("months"), "customer_churn", "total_customers",
                    half_up_div("customer_churn", "total_customers", 2).cast("double").alias("churn_rate"))
            .orderBy("months"))


def retention_crosscheck(sl: DataFrame, first_month: int = 1, second_month: int = 2) -> DataFrame:
    """Customers of month-of-year A who are also in month-of-year B, and all
    customers of B (two rows, UNION)."""
    month = month_of_year("order_date")
    per = sl.groupBy("customer_id").agg(F.bool_or(month == first_month).alias("_a"), F.bool_or(month == second_month).alias("_b"))
    row = per.agg(F.count_if(F.col("_a") & F.col("_b")).alias("_both"), F.count_if(F.col("_b")).alias("_second"))
    return row.select(F.explode(F.create_map(F.lit(RETAINED_LABEL), F.col("_both"), F.lit(DISTINCT_LABEL), F.col("_second")))
                      .alias("category", "counts"))


def customer_month_of_year(sl: DataFrame) -> DataFrame:
    """Distinct customer x month-of-year (the unfinished churn draft's base table)."""
    return sl.select("customer_id", month_of_year("order_date").alias("months")).distinct()


def customer_month_retained_flag(sl: DataFrame) -> DataFrame:
    """Each customer-month with the previous calendar month when the customer was
    active in it, and 'Yes'/'No'."""
    flagged = _with_previous(customer_months(sl))
    return flagged.select("customer_id", F.col("month").alias("current_month"),
                          F.col("prev_month").alias("previous_month"),
                          F.when(F.col("prev_month").isNotNull(), YES).otherwise(NO).alias("retained"))


def customer_month_retained_list(sl: DataFrame) -> DataFrame:
    """The retained flags in order of month and customer (a range sort)."""
    return customer_month_retained_flag(sl).orderBy("current_month", "customer_id")


def retained_flag_by_geo(sl: DataFrame) -> DataFrame:
    """The retained flag joined with every (state, region) the customer ordered in.
    A customer with several geographies fans out, as in the reference."""
    geo = sl.select("customer_id", "state_province", "region").distinct()
    return customer_month_retained_flag(sl).join(geo, "customer_id", "left")


def _with_span(sl: DataFrame) -> DataFrame:
    """Adds first_order and last_order to order lines; customer-months have them."""
    if "order_date" not in sl.columns:
        return sl
    return sl.withColumn("first_order", F.col("order_date")).withColumn("last_order", F.col("order_date"))


def customer_first_order(sl: DataFrame) -> DataFrame:
    return (_with_span(sl).groupBy("customer_id", "customer_name").agg(F.min("first_order").alias("first_order"))
            .select("first_order", "customer_id", "customer_name"))


def customer_lifespan(sl: DataFrame) -> DataFrame:
    """First and last order per customer and the days between, longest first (a range sort)."""
    return (_with_span(sl).groupBy("customer_id", "customer_name")
            .agg(F.min("first_order").alias("first_order"), F.max("last_order").alias("last_order"))
            .select("first_order", "customer_id", "customer_name", "last_order",
                    F.datediff("last_order", "first_order").alias("inactive_days"))
            .orderBy(F.desc("inactive_days"), "customer_id"))


def lifespan_bins(sl: DataFrame, digits: int = -1) -> DataFrame:
    """Customers per ROUND(lifespan_days, -1) bin (half-up: 5 -> 10, 15 -> 20)."""
    return (customer_lifespan(sl).groupBy(F.round("inactive_days", digits).alias("day_bracket"))
            .agg(F.count("customer_id").alias("no_of_customers"))
            .orderBy("day_bracket"))


def coupon_eligibility(sl: DataFrame, today: str = "2015-06-28", days: int = 118) -> DataFrame:
    """Days since each customer's last order at ``today``; 'Coupon Eligible' when
    at least ``days``, else NULL."""
    today_d = F.lit(dt.date.fromisoformat(today))
    per = _with_span(sl).groupBy("customer_id", "customer_name").agg(F.max("last_order").alias("last_date"))
    out = per.select("customer_id", "customer_name", "last_date", today_d.alias("today"),
                     F.datediff(today_d, "last_date").alias("last_order"))
    return out.withColumn("promotional", F.when(F.col("last_order") >= days, F.lit(COUPON_LABEL)))


def customers_nplus_days_month(sl: DataFrame, n: int = 3) -> DataFrame:
    """Order days of customers who ordered on >= n distinct days within one
    month-of-year; ``order_frequency`` counts those (day, customer) rows per
    customer name, as the reference's window over the grouped rows does."""
    # distinct (day, customer) first: a partial aggregate that leaves at most one
    # row per customer and calendar day, so no later shuffle carries raw lines
    days = sl.select("order_date", "customer_id", "customer_name").distinct()
    qualifying = (days.groupBy("customer_id", month_of_year("order_date").alias("_m"))
                  .agg(F.count(F.lit(1)).alias("_d"))
                  .where(F.col("_d") >= n).select("customer_id"))
    kept = days.join(qualifying, "customer_id", "left_semi")
    freq = F.count("customer_id").over(Window.partitionBy("customer_name"))
    return kept.withColumn("order_frequency", freq).orderBy("customer_id", "order_date")


def _monthly_activity(sl: DataFrame) -> DataFrame:
    """One row per month present: active customers and customers also active
    in the previous calendar month."""
    flagged = _with_previous(customer_months(sl))
    return flagged.groupBy("month").agg(F.count(F.lit(1)).alias("active"),
                                        F.count("prev_month").alias("retained"))


def true_churn(sl: DataFrame) -> DataFrame:
    """Customer churn in the usual sense: for month M, customers active in M-1
    (prior_customers), those of them not active in M (lost) and lost / prior
    (half-up 2 dp). M runs over the month after each active month, up to the
    last month of the data (later months are not observed yet)."""
    act = _monthly_activity(sl)
    last = F.max("month").over(Window.partitionBy())           # one row per month: bounded
    prior = act.select(F.add_months("month", 1).alias("month"), F.col("active").alias("prior_customers"),
                       last.alias("_last"))
    cur = act.select("month", F.col("retained").alias("_kept"))
    j = prior.where(F.col("month") <= F.col("_last")).join(cur, "month", "left")
    lost = F.col("prior_customers") - F.coalesce(F.col("_kept"), F.lit(0))
    return j.select("month", "prior_customers", lost.alias("lost"),
                    half_up_div(lost, "prior_customers", 2).cast("double").alias("churn_rate"))


def churn_retention_corr(sl: DataFrame) -> DataFrame:
    """Correlation, over months, of the reference's retention rate with the
    churn rate in the usual sense (months present in both)."""
    from tillroll.functions.stats import corr_from_moments, moments_from_limbs, pair_moments
    ret = retention_monthly(sl).select(F.col("monthly").alias("month"), F.col("retention_rate").alias("r"))
    ch = true_churn(sl).select("month", F.col("churn_rate").alias("c"))
    j = ret.join(ch, "month")
    row = j.agg(*pair_moments("r", "c", "m", 2, 2)).select(*moments_from_limbs("m"))
    return row.select(corr_from_moments("m").alias("corr"), F.col("m_n").cast("bigint").alias("n"))


def customer_lifetime_value(sl: DataFrame) -> DataFrame:
    """Per customer: orders, sales, average order value (half-up 2 dp), first
    and last order, active span in days, profit, and clv (= historic profit)."""
    a = sl.groupBy("customer_id").agg(
        F.count_distinct("order_id").alias("orders"), F.sum("sales").alias("_s"), F.sum("profit").alias("_p"),
        F.min("order_date").alias("first_order"), F.max("order_date").alias("last_order"))
    return a.select("customer_id", "orders", F.col("_s").cast("double").alias("sales"),
                    half_up_div("_s", "orders", 2).alias("aov"), "first_order", "last_order",
                    F.datediff("last_order", "first_order").alias("span_days"),
                    F.col("_p").cast("double").alias("profit"), F.col("_p").alias("clv"))


def clv_drivers(sl: DataFrame) -> DataFrame:
    """Correlation of customer lifetime value with its drivers (orders, average
    order value, active span), from exact moments in one aggregate."""
    from tillroll.functions.stats import corr_from_moments, moments_from_limbs, pair_moments
    clv = customer_lifetime_value(sl)
    drivers = {"orders": 0, "aov": 2, "span_days": 0}
    aggs = [m for name, s in drivers.items() for m in pair_moments(name, "clv", name, s, 2, wide=True)]
    row = clv.agg(*aggs).select(*[c for name in drivers for c in moments_from_limbs(name, wide=True)])
    # the one row is unpivoted in place: a union of selects would repeat the joins per driver
    found = [F.struct(F.lit(name).alias("driver"), corr_from_moments(name).alias("corr"),
                      F.col(f"{name}_n").cast("bigint").alias("n")) for name in drivers]
    return row.select(F.explode(F.array(*found)).alias("d")).select("d.driver", "d.corr", "d.n")
