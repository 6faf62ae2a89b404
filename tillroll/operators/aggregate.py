"""Grouped aggregates over the order-line table.

Each function takes the order-line DataFrame (the reference's column names) and
returns the result DataFrame. Sums stay DECIMAL until the very end and are then
cast to DOUBLE (``_d``), so the values are exact and independent of task order.

Scale notes: every ``groupBy`` here is a partial (map-side) + final hash
aggregate, so a key holding a third of all rows only costs one pre-aggregated
row per map task. "GROUP BY used as DISTINCT" shapes are written as
``distinct()`` + a second aggregate over the (much smaller) distinct rows.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillroll.functions.columns import (exact_avg, half_up_div, half_up_round, month_key, month_name_of, month_of_year,
                                        pct, year_month_label)


def _d(c) -> F.Column:
    """Final measure: exact decimal -> DOUBLE."""
    return (F.col(c) if isinstance(c, str) else c).cast("double")


def _all_rows() -> Window:
    """A window over all rows; used only on aggregated (bounded) inputs."""
    return Window.partitionBy()


def _lines(sl: DataFrame, column: str | None = None) -> F.Column:
    """Number of order lines (those with a non-NULL ``column``): a count at line grain,
    a sum of ``lines`` where the binding has summed lines per order or part."""
    if "lines" in sl.columns:
        return F.sum(F.when(F.col(column).isNotNull(), F.col("lines")).otherwise(0) if column else F.col("lines"))
    return F.count(column or F.lit(1))


def _line_average(sl: DataFrame, digits: int) -> F.Column:
    """Average sales of a line, half-up, exact, at either grain."""
    if "lines" in sl.columns:
        return half_up_div(F.sum("sales"), F.sum("lines"), digits)
    return half_up_round(exact_avg("sales"), digits)


# --- single-level group counts and sums ----------------------------------

def segment_order_count(sl: DataFrame) -> DataFrame:
    return (sl.groupBy("customer_segment")
            .agg(_lines(sl, "customer_segment").alias("counting"))
            .orderBy("counting"))


def product_subcat_region_count(sl: DataFrame) -> DataFrame:
    return (sl.groupBy(F.col("product_category").alias("product"), "region",
                       F.col("product_sub_category").alias("sub_category"))
            .agg(F.count("product_category").alias("total_sold"))
            .select("product", "total_sold", "sub_category", "region")
            .orderBy("product", F.desc("region")))


def products_by_units_sold(sl: DataFrame) -> DataFrame:
    """Product, sub-category and region counts as a list per region, most sold first."""
    return product_subcat_region_count(sl).orderBy("region", F.desc("total_sold"), "product", "sub_category")


def sales_by_month(sl: DataFrame) -> DataFrame:
    return (sl.groupBy(month_of_year("order_date").alias("monthly"))
            .agg(_d(F.sum("sales")).alias("total"))
            .orderBy("monthly"))


def sales_by_month_state(sl: DataFrame) -> DataFrame:
    return (sl.groupBy(month_of_year("order_date").alias("months"), "state_province")
            .agg(_d(F.sum("sales")).alias("t_sales"))
            .orderBy("months", F.desc("t_sales")))


def sales_month_subcat_rollup(sl: DataFrame, with_grouping_id: bool = False) -> DataFrame:
    """Sales by month-of-year x sub-category with subtotals per month and a grand total.

    ``with_grouping_id`` adds ``grouping_id`` so a subtotal row can be told
    apart from a NULL sub-category in the data.
    """
    aggs = [_d(F.sum("sales")).alias("t_sales")]
    if with_grouping_id:
        aggs.append(F.grouping_id().alias("grouping_id"))
    return (sl.select(month_of_year("order_date").alias("months"), "product_sub_category", "sales")
            .rollup("months", "product_sub_category").agg(*aggs)
            .orderBy(F.asc_nulls_first("months"), F.desc("t_sales")))


def customer_totals(sl: DataFrame) -> DataFrame:
    """Quantity, sales and profit per customer, by falling sales (a range sort)."""
    return (sl.groupBy("customer_id", "customer_name")
            .agg(F.sum("quantity_ordered_new").cast("bigint").alias("quantity"),
                 _d(F.sum("sales")).alias("t_sales"), _d(F.sum("profit")).alias("t_profit"))
            .orderBy(F.desc("t_sales"), "customer_id"))


def customer_extremes(sl: DataFrame, k: int = 10) -> DataFrame:
    """The ``k`` largest and ``k`` smallest customers by sales: end ('largest'/'smallest'),
    place, customer_id, customer_name, quantity, t_sales, t_profit.

    Ties go to the smaller customer id. Each end is a top-k (no sort of all customers).
    """
    per = (sl.groupBy("customer_id", "customer_name")
           .agg(F.sum("quantity_ordered_new").cast("bigint").alias("quantity"),
                F.sum("sales").alias("_s"), F.sum("profit").alias("_p")))
    ends = []
    for end, order in (("largest", F.desc("_s")), ("smallest", F.asc("_s"))):
        top = per.orderBy(order, "customer_id").limit(k)
        place = F.row_number().over(Window.orderBy(order, "customer_id"))
        ends.append(top.select(F.lit(end).alias("end"), place.alias("place"), "customer_id", "customer_name", "quantity",
                               _d("_s").alias("t_sales"), _d("_p").alias("t_profit")))
    return ends[0].unionAll(ends[1])


def sales_extremes(sl: DataFrame, fields: dict[str, F.Column]) -> DataFrame:
    """The values of each field with the most and the least sales: field, value, end, t_sales; ties kept.

    ``fields`` maps a label to a column. All fields are unpivoted and summed together, so
    the lines are read once; the ranking runs on one row per value.
    """
    pairs = F.explode(F.array(*[F.struct(F.lit(name).alias("field"), col.cast("string").alias("value"))
                                for name, col in fields.items()]))
    totals = (sl.select(pairs.alias("_f"), "sales").groupBy("_f.field", "_f.value").agg(F.sum("sales").alias("_s")))
    ends = totals.groupBy("field").agg(F.max("_s").alias("most"), F.min("_s").alias("least"))
    ends = ends.selectExpr("field AS _field", "stack(2, 'most', most, 'least', least) AS (end, _e)")
    return (totals.join(ends, (F.col("field") == F.col("_field")) & (F.col("_s") == F.col("_e")))
            .select("field", "value", "end", _d("_s").alias("t_sales")).orderBy("field", "end", "value"))


def peak_return_period(returned: DataFrame, period: str = "month") -> DataFrame:
    """Per region the calendar month (or 'day') in which most returned orders were placed, ties kept:
    region, period, orders. ``returned`` has order_id, region and order_date, one or more rows per order."""
    when = F.trunc("order_date", "month") if period == "month" else F.col("order_date")
    per = (returned.select("order_id", "region", when.alias("period")).distinct()
           .groupBy("region", "period").agg(F.count(F.lit(1)).alias("orders")))
    best = F.rank().over(Window.partitionBy("region").orderBy(F.desc("orders")))
    return (per.withColumn("_r", best).where(F.col("_r") == 1).drop("_r").orderBy("region", "period"))


def region_sales_contribution(sl: DataFrame) -> DataFrame:
    """Each region's share of total sales, in percent (window over 1 row per region)."""
    agg = sl.groupBy("region").agg(F.sum("sales").alias("_s"))
    return agg.select("region", pct("_s", F.sum("_s").over(_all_rows())).alias("perc_contribution"))


def month_region_contribution(sl: DataFrame) -> DataFrame:
    agg = (sl.groupBy(month_of_year("order_date").alias("months"), "region")
           .agg(F.sum("sales").alias("_s"), F.sum("profit").alias("_p")))
    w = _all_rows()
    return (agg.select("months", "region",
                       pct("_s", F.sum("_s").over(w)).alias("perc_t_sales"),
                       pct("_p", F.sum("_p").over(w)).alias("perc_t_profit"))
            .orderBy("months", "region"))


def monthname_region_sales_profit(sl: DataFrame) -> DataFrame:
    """Sales and profit per calendar month name x region, in calendar order."""
    agg = (sl.groupBy(month_of_year("order_date").alias("_m"), "region")
           .agg(F.sum("sales").alias("_s"), F.sum("profit").alias("_p")))
    return (agg.orderBy("_m", F.desc("_s"))
            .select(month_name_of("_m").alias("months"), "region", _d("_s").alias("t_sales"),
                    _d("_p").alias("t_profit")))


def region_sales_and_lines(sl: DataFrame) -> DataFrame:
    """Sales and line count per region; ``states_per_region`` counts lines as written,
    ``distinct_states`` is the count the name promises."""
    return sl.groupBy("region").agg(
        _d(F.sum("sales")).alias("t_sales"),
        _lines(sl, "state_province").alias("states_per_region"),
        F.count_distinct("state_province").alias("distinct_states"))


def yearmonth_subcat_sales(sl: DataFrame) -> DataFrame:
    return (sl.groupBy(month_key("order_date").alias("_m"), "product_category", "product_sub_category")
            .agg(F.sum("sales").alias("_s"))
            .orderBy("_m", "product_category", F.desc("_s"))
            .select(year_month_label("_m").alias("monthly"), "product_category", "product_sub_category",
                    _d("_s").alias("sales")))


def yearmonth_category_sales(sl: DataFrame) -> DataFrame:
    return (sl.groupBy(month_key("order_date").alias("_m"), "product_category")
            .agg(F.sum("sales").alias("_s"))
            .orderBy("_m", "product_category", F.desc("_s"))
            .select(year_month_label("_m").alias("monthly"), "product_category", _d("_s").alias("sales")))


def product_sales(sl: DataFrame) -> DataFrame:
    return sl.groupBy("product_name").agg(_d(F.sum("sales")).alias("sum_sales"))


def product_avg_sales_exact(sl: DataFrame) -> DataFrame:
    """product_name, sales = ROUND(AVG(sales), 2) kept as an exact DECIMAL."""
    return sl.groupBy("product_name").agg(_line_average(sl, 2).alias("sales"))


def product_avg_sales(sl: DataFrame) -> DataFrame:
    return product_avg_sales_exact(sl).select("product_name", _d("sales").alias("sales"))


def product_avg_prefix(sl: DataFrame, prefix: str) -> DataFrame:
    """Average line sales of the products whose name starts with ``prefix``
    (case-insensitive, like the reference's LIKE 'x%')."""
    return product_avg_sales(sl.where(F.lower("product_name").startswith(prefix.lower())))


def _distinct_count(c: str, approx: bool, rsd: float = 0.01):
    """COUNT(DISTINCT c); with ``approx`` a HyperLogLog++ sketch (relative error
    ``rsd``) that merges map-side instead of shuffling every distinct value."""
    return F.approx_count_distinct(c, rsd) if approx else F.count_distinct(c)


def region_active_customers(sl: DataFrame, approx: bool = False) -> DataFrame:
    return sl.groupBy("region").agg(_distinct_count("customer_id", approx).alias("customers"),
                                    _d(F.sum("sales")).alias("sales"))


def month_region_engagement(sl: DataFrame, approx: bool = False) -> DataFrame:
    return sl.groupBy(month_of_year("order_date").alias("month_wise"), "region").agg(
        _distinct_count("customer_id", approx).alias("engagement"), _d(F.sum("sales")).alias("sales"))


def subcategory_count(sl: DataFrame) -> DataFrame:
    return sl.agg(F.count_distinct("product_sub_category").alias("cnt"))


def priority_by_region_state(sl: DataFrame) -> DataFrame:
    return (sl.groupBy("region", F.col("state_province").alias("state"), "order_priority")
            .agg(_lines(sl).alias("counts"))
            .orderBy("region", "state", F.desc("counts")))


def priority_counts(sl: DataFrame) -> DataFrame:
    return sl.groupBy("order_priority").agg(_lines(sl).alias("cnt"))


def month_region_sales(sl: DataFrame) -> DataFrame:
    return (sl.groupBy(month_of_year("order_date").alias("monthly"), "region")
            .agg(_d(F.sum("sales")).alias("sales")).orderBy("monthly"))


def ship_mode_counts(sl: DataFrame) -> DataFrame:
    return sl.groupBy("ship_mode").agg(F.count("order_id").alias("counts"))


def order_line_vs_order_count(sl: DataFrame) -> DataFrame:
    """Lines vs distinct orders. The delivery-day column of the reference's inner
    table does not reach the output, so it is not computed."""
    return sl.agg(F.count("order_id").alias("lines"), F.count_distinct("order_id").alias("orders"))


def total_sales(sl: DataFrame) -> DataFrame:
    return sl.agg(_d(F.sum("sales")).alias("total_sales"))


def row_count(sl: DataFrame) -> DataFrame:
    return sl.agg(F.count("row_id").alias("cnt"))


def subcat_share_in_category(sl: DataFrame) -> DataFrame:
    """Lines per sub-category as a percentage of its category's lines."""
    agg = sl.groupBy("product_category", "product_sub_category").agg(_lines(sl).alias("total_orders"))
    grand = F.sum("total_orders").over(Window.partitionBy("product_category"))
    return agg.select("product_category", "product_sub_category", grand.alias("grand_total"),
                      "total_orders", pct("total_orders", grand).alias("percentage"))


def month_share_of_sales_profit(sl: DataFrame) -> DataFrame:
    """Profit and sales per month-of-year and their share of the computed totals
    (the reference divides by totals typed in by hand)."""
    agg = sl.groupBy(month_of_year("order_date").alias("months")).agg(
        F.sum("profit").alias("_p"), F.sum("sales").alias("_s"))
    w = _all_rows()
    return (agg.select("months", _d("_p").alias("profits"), pct("_p", F.sum("_p").over(w)).alias("profit_pct"),
                       _d("_s").alias("sales"), pct("_s", F.sum("_s").over(w)).alias("sales_pct"))
            .orderBy("months"))


def avg_line_vs_avg_month(sl: DataFrame) -> DataFrame:
    """Average line sales, then average monthly total (UNION ALL, one column).

    AVG of a DECIMAL(s=2) carries 4 more decimals (scale 6, half-up), as in MySQL
    and Spark.
    """
    line_avg = sl.agg(F.avg("sales").cast("decimal(38,6)").alias("sales"))
    monthly = sl.groupBy(month_of_year("order_date").alias("m")).agg(F.sum("sales").alias("s"))
    month_avg = monthly.agg(F.avg("s").cast("decimal(38,6)").alias("sales"))
    return line_avg.unionAll(month_avg).select(_d("sales").alias("sales"))


def state_share_of_totals(sl: DataFrame, state: str) -> DataFrame:
    """One state's sales as a percentage of (1) total sales and (2) its region's sales.

    The reference divides by two totals typed in by hand; both are computed
    here (the second divisor's meaning is inferred as the state's region). The
    two rows are UNION-ed (distinct), as written.
    """
    agg = sl.groupBy("region", "state_province").agg(F.sum("sales").alias("_s"))
    w_all, w_region = _all_rows(), Window.partitionBy("region")
    shares = (agg.select("state_province", "_s", F.sum("_s").over(w_all).alias("_t"),
                         F.sum("_s").over(w_region).alias("_r"))
              .where(F.col("state_province") == state))
    return (shares.select(pct("_s", "_t").alias("results"))
            .union(shares.select(pct("_s", "_r").alias("results")))
            .distinct())


# --- two-level aggregates (GROUP BY as DISTINCT, then count) -------------

def _state_city_region(sl: DataFrame) -> DataFrame:
    return sl.select(F.col("state_province").alias("state"), "city", "region").distinct()


def cities_per_region(sl: DataFrame) -> DataFrame:
    return _state_city_region(sl).groupBy("region").agg(F.count("region").alias("cnt"))


def states_per_city(sl: DataFrame) -> DataFrame:
    return (_state_city_region(sl).groupBy("city").agg(F.count("city").alias("cnt"))
            .orderBy(F.desc("cnt")))


def customers_in_city(sl: DataFrame, city: str) -> DataFrame:
    return sl.where(F.col("city") == city).select("customer_name").distinct()


def city_repeated_in_region(sl: DataFrame) -> DataFrame:
    return (_state_city_region(sl).groupBy("region", "city").agg(F.count("city").alias("times"))
            .where(F.col("times") > 1))


def city_drilldown(sl: DataFrame, city: str) -> DataFrame:
    """State/city/region totals for one city; the city filter is pushed below the
    aggregate (and into the scan) by Catalyst."""
    return (sl.groupBy(F.col("state_province").alias("state"), "city", "region")
            .agg(_d(F.sum("sales")).alias("t_sales"), _d(F.sum("profit")).alias("t_profit"))
            .where(F.col("city") == city))


def city_repeated_states(sl: DataFrame) -> DataFrame:
    """City names found in more than one state of a region, with the sorted state list.

    The list per (region, city) is bounded by the number of states, not by the
    data size, so ``collect_set`` is safe here.
    """
    return (_state_city_region(sl).groupBy("region", "city")
            .agg(F.count("city").alias("times"),
                 F.array_join(F.array_sort(F.collect_set("state")), ",").alias("states"))
            .where(F.col("times") > 1)
            .orderBy("region", F.desc("times")))


def covered_city_count(sl: DataFrame) -> DataFrame:
    return sl.select("state_province", "city").distinct().agg(F.count(F.lit(1)).alias("cnt"))


def ship_mode_cities_by_state(sl: DataFrame) -> DataFrame:
    """In how many cities of a state each ship mode is used."""
    return (sl.select(F.col("state_province").alias("state"), "city", F.col("ship_mode").alias("shipping"))
            .distinct()
            .groupBy("state", "shipping").agg(F.count("shipping").alias("mode_count"))
            .orderBy("state", F.desc("mode_count"), "shipping"))


def widest_ship_mode_by_state(sl: DataFrame) -> DataFrame:
    """The ship mode(s) used in most cities of each state (ties kept): the
    reference's correlated scalar subquery (count = the state's max count) as
    RANK = 1, which lets Spark limit each group map-side (WindowGroupLimit)."""
    per = ship_mode_cities_by_state(sl)
    ranked = per.withColumn("_r", F.rank().over(Window.partitionBy("state").orderBy(F.desc("mode_count"))))
    return ranked.where(F.col("_r") == 1).drop("_r")


def customers_nplus_lines_month(sl: DataFrame, n: int = 3) -> DataFrame:
    return (sl.groupBy("customer_id", "customer_name", month_key("order_date").alias("_m"))
            .agg(_lines(sl, "customer_name").alias("order_no"))
            .where(F.col("order_no") >= n)
            .select("customer_id", "customer_name", year_month_label("_m").alias("monthly"), "order_no"))


def customers_by_value_bracket(sl: DataFrame, digits: int = -2) -> DataFrame:
    """Customers per bracket of their total sales, ROUND(total, -2) (half-up)."""
    per = sl.groupBy("customer_id").agg(F.sum("sales").alias("t_sales"))
    return (per.groupBy(F.round("t_sales", digits).alias("sales_bracket"))
            .agg(F.count_distinct("customer_id").alias("no_of_customers"))
            .orderBy("sales_bracket")
            .select(_d("sales_bracket").alias("sales_bracket"), "no_of_customers"))


def subcategories_per_region(sl: DataFrame) -> DataFrame:
    """Number of sub-categories sold per region (the reference's MAX of RANK over
    the distinct pairs, which is a count of the distinct pairs)."""
    return (sl.select("region", "product_sub_category").distinct()
            .groupBy("region").agg(F.count(F.lit(1)).cast("int").alias("maximum")))


def subcat_cumulative_pct(sl: DataFrame) -> DataFrame:
    """Revenue share per sub-category and its running total in ascending share order.

    ``total_sales`` is ROUND(SUM(sales), 0); ``rev_pct`` is the half-up rounded
    share; the running sum uses the default RANGE frame, so equal shares share
    one running value. Both windows run on one row per sub-category.
    """
    agg = sl.groupBy("product_sub_category").agg(F.sum("sales").alias("revenue"))
    total = F.round(F.sum("revenue").over(Window.partitionBy()), 0)
    with_pct = agg.select("product_sub_category", "revenue", total.alias("total_sales"))
    with_pct = with_pct.withColumn(
        "rev_pct", F.round(F.col("revenue").cast("decimal(24,2)") * 100
                           / F.col("total_sales").cast("decimal(24,0)"), 2))
    running = F.sum("rev_pct").over(Window.orderBy("rev_pct")
                                    .rangeBetween(Window.unboundedPreceding, Window.currentRow))
    return with_pct.select("product_sub_category", _d("revenue").alias("revenue"),
                           _d("total_sales").alias("total_sales"), _d("rev_pct").alias("rev_pct"),
                           _d(running).alias("cumulative_sum_perc"))


def manager_monthly_bonus_exact(sl: DataFrame, users: DataFrame, low: float = 50000, high: float = 60000,
                                rate: float = 0.15, special_manager: str | None = None) -> DataFrame:
    """Year-month x manager sales, profit and tiered bonus, as exact decimals.

    Branch order as in the reference: the special manager above ``high`` is paid
    on the excess over ``high``; otherwise anyone above ``low`` on the excess over
    ``low``; else NULL. ``users`` has one row per region (Spark broadcasts it by
    its measured size).
    """
    lo, hi, r = (F.lit(Decimal(str(v))) for v in (low, high, rate))
    agg = (sl.join(users, "region")
           .groupBy(month_key("order_date").alias("_m"), "manager")
           .agg(F.sum("sales").alias("t_sales"), F.sum("profit").alias("t_profit"))
           .withColumn("month_data", year_month_label("_m")))
    bonus = (F.when((F.col("manager") == F.lit(special_manager)) & (F.col("t_sales") > hi), (F.col("t_sales") - hi) * r)
             .when(F.col("t_sales") > lo, (F.col("t_sales") - lo) * r))
    return agg.select("month_data", "manager", "t_sales", "t_profit", bonus.alias("bonus"))


def manager_monthly_bonus(sl: DataFrame, users: DataFrame, **params) -> DataFrame:
    b = manager_monthly_bonus_exact(sl, users, **params)
    return b.select("month_data", "manager", _d("t_sales").alias("t_sales"), _d("t_profit").alias("t_profit"),
                    _d("bonus").alias("bonus"))


def bonus_rollup(sl: DataFrame, users: DataFrame, **params) -> DataFrame:
    """Bonus per month x manager with month subtotals and a grand total (ROLLUP),
    summed in decimal before the final cast."""
    b = manager_monthly_bonus_exact(sl, users, **params)
    return (b.rollup("month_data", "manager").agg(F.sum("bonus").alias("_b"))
            .select("month_data", "manager", _d("_b").alias("t_bonus")))
