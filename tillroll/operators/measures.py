"""BI-model measures re-expressed as DataFrame operators.

The reference describes report measures (time intelligence, calculated
tables, logical functions, row-level security, relationship filtering, KPI
cards, geography / segment / category tooltips). Each is a plain aggregate,
window or join here; every window runs on already aggregated rows (one per
period or group), and every join of a small table relies on Spark's measured
broadcast decision.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillroll.functions.columns import half_up_div, month_start, pct


def _d(c):
    return (F.col(c) if isinstance(c, str) else c).cast("double")


# --- time intelligence (D01, D02, D37) -----------------------------------

def total_ytd(df: DataFrame, date_col: str, measure: str, by: list[str] | None = None) -> DataFrame:
    """Monthly value and its year-to-date running total (TOTALYTD).

    Output: *by, month (first day), value, ytd.
    """
    by = list(by or [])
    m = df.groupBy(*by, month_start(date_col).alias("month")).agg(F.sum(measure).alias("_v"))
    w = (Window.partitionBy(*by, F.year("month")).orderBy("month")
         .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return m.select(*by, "month", _d("_v").alias("value"), _d(F.sum("_v").over(w)).alias("ytd"))


def same_period_last_year(df: DataFrame, date_col: str, measure: str, by: list[str] | None = None) -> DataFrame:
    """Monthly value, the value of the same month a year earlier (NULL when that
    month has no data) and the year-over-year change in percent.

    An equi-join on the month shifted by 12 (not ``lag(12)``, which would pick
    a wrong month when months are missing); both sides are monthly aggregates.
    """
    by = list(by or [])
    m = df.groupBy(*by, month_start(date_col).alias("month")).agg(F.sum(measure).alias("_v"))
    prior = m.select(*by, F.add_months("month", 12).alias("month"), F.col("_v").alias("_p"))
    j = m.join(prior, [*by, "month"], "left")
    return j.select(*by, "month", _d("_v").alias("value"), _d("_p").alias("prior"),
                    pct(F.col("_v") - F.col("_p"), "_p").alias("yoy_pct"))


def mom_change(df: DataFrame, date_col: str = "order_date") -> DataFrame:
    """Year-month sales and profit with their change in percent over the previous
    calendar month (NULL when that month has no data)."""
    m = df.groupBy(month_start(date_col).alias("month")).agg(F.sum("sales").alias("_s"), F.sum("profit").alias("_p"))
    w = Window.orderBy("month")
    is_prev = F.lag("month").over(w) == F.add_months("month", -1)
    ps = F.when(is_prev, F.lag("_s").over(w))
    pp = F.when(is_prev, F.lag("_p").over(w))
    return m.select("month", _d("_s").alias("sales"), pct(F.col("_s") - ps, ps).alias("sales_mom_pct"),
                    _d("_p").alias("profit"), pct(F.col("_p") - pp, pp).alias("profit_mom_pct"))


# --- calculated tables and logical functions (D03-D06) --------------------

def summarize(df: DataFrame, keys: list[str], measures: dict[str, Column]) -> DataFrame:
    """SUMMARIZE: group by ``keys`` with named aggregate expressions."""
    return df.groupBy(*keys).agg(*[expr.alias(name) for name, expr in measures.items()])


def add_columns(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """ADDCOLUMNS: named expressions evaluated per row."""
    return df.withColumns(columns)


def categorize(df: DataFrame, column: str, bands: list[tuple], name: str = "band",
               default: str | None = None) -> DataFrame:
    """SWITCH(TRUE(), ...): the first band whose upper bound the value is below.

    ``bands`` is an ordered list of (upper_bound_exclusive, label); a bound of
    None matches everything left.
    """
    expr = None
    for bound, label in bands:
        cond = F.lit(True) if bound is None else F.col(column) < F.lit(bound)
        expr = F.when(cond, F.lit(label)) if expr is None else expr.when(cond, F.lit(label))
    if default is not None:
        expr = expr.otherwise(F.lit(default))
    return df.withColumn(name, expr)


def value_if_single(df: DataFrame, keys: list[str], column: str, name: str = "value") -> DataFrame:
    """HASONEVALUE: the group's value of ``column`` when it has exactly one
    distinct non-NULL value, else NULL; ``n_values`` is that distinct count."""
    return df.groupBy(*keys).agg(
        F.count_distinct(column).alias("n_values"),
        F.when(F.count_distinct(column) == 1, F.max(column)).alias(name))


# --- relationships and security (D07-D09) ---------------------------------

def lookup_related(fact: DataFrame, dim: DataFrame, key: str | list[str], cols: list[str]) -> DataFrame:
    """RELATED: bring ``cols`` of the dimension onto each fact row (left join;
    Spark broadcasts the dimension when its measured size allows)."""
    keys = [key] if isinstance(key, str) else list(key)
    return fact.join(dim.select(*keys, *cols), keys, "left")


def row_level_security(df: DataFrame, users: DataFrame, manager: str, key: str = "region") -> DataFrame:
    """Rows of the regions a manager may see (semi join on the security table)."""
    allowed = users.where(F.col("manager") == manager).select(key)
    return df.join(allowed, key, "left_semi")


def bidirectional_filter(dim: DataFrame, fact: DataFrame, dim_key: str, fact_key: str,
                         fact_predicate: Column) -> DataFrame:
    """Dimension rows that have at least one fact row matching ``fact_predicate``
    (a filter flowing from the fact side back to the dimension)."""
    hits = fact.where(fact_predicate).select(F.col(fact_key).alias(dim_key)).distinct()
    return dim.join(hits, dim_key, "left_semi")


# --- KPI card and tooltips (D36, D41-D44) ---------------------------------

def _distinct(c: str, approx: bool):
    """COUNT(DISTINCT c), or a HyperLogLog++ sketch (1 % error) with ``approx``."""
    return F.approx_count_distinct(c, 0.01) if approx else F.count_distinct(c)


def kpi_summary(sl: DataFrame, approx: bool = False, orders: DataFrame | None = None) -> DataFrame:
    """sales, profit, margin %, orders, customers, average order value (half-up 2 dp).

    With ``orders`` (one row per order: order_id, customer_id) the two counts are taken
    from those rows and ``sl`` may be summed at any grain; two distinct counts over lines
    would multiply every line. ``approx`` counts with sketches instead."""
    money = [F.sum("sales").alias("_s"), F.sum("profit").alias("_p")]
    if orders is None:
        a = sl.agg(*money, _distinct("order_id", approx).alias("orders"), _distinct("customer_id", approx).alias("customers"))
    else:
        counts = orders.agg(F.struct(F.count("order_id").alias("orders"), _distinct("customer_id", approx).alias("customers")).alias("c")).scalar()
        a = sl.agg(*money).withColumn("_c", counts).select("_s", "_p", "_c.orders", "_c.customers")
    return a.select(_d("_s").alias("sales"), _d("_p").alias("profit"), pct("_p", "_s").alias("margin_pct"),
                    "orders", "customers", _d(half_up_div("_s", "orders", 2)).alias("aov"))


def geo_performance(sl: DataFrame) -> DataFrame:
    """Sales and profit per region x state, and each state's gap to the mean
    state sales of its region (the mean rounded half-up to 2 dp)."""
    a = sl.groupBy("region", "state_province").agg(F.sum("sales").alias("_s"), F.sum("profit").alias("_p"))
    w = Window.partitionBy("region")
    region_mean = half_up_div(F.sum("_s").over(w), F.count(F.lit(1)).over(w), 2)
    return a.select("region", "state_province", _d("_s").alias("sales"), _d("_p").alias("profit"),
                    _d(F.col("_s") - region_mean).alias("gap_to_region_mean"))


def segment_performance(sl: DataFrame) -> DataFrame:
    """Sales, profit, margin % per customer segment, ranked by profit."""
    a = sl.groupBy("customer_segment").agg(F.sum("sales").alias("_s"), F.sum("profit").alias("_p"))
    return a.select("customer_segment", _d("_s").alias("sales"), _d("_p").alias("profit"),
                    pct("_p", "_s").alias("margin_pct"),
                    F.rank().over(Window.orderBy(F.desc("_p"))).alias("profit_rank"))


def orders_by_category(sl: DataFrame, approx: bool = False) -> DataFrame:
    return sl.groupBy("product_category").agg(_distinct("order_id", approx).alias("orders"))


def sales_by_weekday(sl: DataFrame) -> DataFrame:
    """Sales per day of week (0 = Monday ... 6 = Sunday) with the day name."""
    return (sl.groupBy(F.weekday("order_date").alias("weekday"))
            .agg(F.date_format(F.min("order_date"), "EEEE").alias("day_name"), _d(F.sum("sales")).alias("sales")))


# --- questions stated in the reference without SQL (D52) -------------------

def region_sales_net_of_returns(sl: DataFrame, returns: DataFrame) -> DataFrame:
    """Gross sales, sales of returned orders and net sales per region."""
    r = returns.select(F.col("order_id").alias("_rid"))
    return region_sales_net_of_returns_joined(sl.join(r, sl.order_id == r._rid, "left"))


def region_sales_net_of_returns_joined(j: DataFrame) -> DataFrame:
    """As above, for lines already carrying ``_rid`` (the returned order key or NULL)."""
    a = j.groupBy("region").agg(F.sum("sales").alias("_g"),
                                F.sum(F.when(F.col("_rid").isNotNull(), F.col("sales"))).alias("_r"))
    ret = F.coalesce(F.col("_r"), F.lit(0).cast("decimal(18,2)"))
    return a.select("region", _d("_g").alias("gross"), _d(ret).alias("returned"), _d(F.col("_g") - ret).alias("net"))


def state_revenue(sl: DataFrame) -> DataFrame:
    return (sl.groupBy("state_province").agg(F.sum("sales").alias("_s")).orderBy(F.desc("_s"))
            .select("state_province", _d("_s").alias("revenue")))


def priority_by_customer(sl: DataFrame) -> DataFrame:
    n = F.sum("lines") if "lines" in sl.columns else F.count(F.lit(1))
    return sl.groupBy("customer_id", "order_priority").agg(n.alias("lines"))


# --- logistics (D45) --------------------------------------------------------

def shipping_effectiveness(sl: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Per ship mode (optionally per state too): orders, average delivery days
    (half-up 2 dp), exact discrete p50 / p90 of delivery days, shipping cost and
    profit margin %.

    One chain: a line of each group and order is marked (``once``; lines that come
    with the column are marked already, see ``binding.delivery_lines``), and the sums
    per (group, day) give the day histogram, whose running count holds the
    quantiles, and the totals.
    """
    keys = list(by or []) + ["ship_mode"]
    days = F.datediff("ship_date", "order_date").alias("_days")
    once = F.col("once") if "once" in sl.columns else F.row_number().over(
        Window.partitionBy("order_id", *keys).orderBy("ship_date")) == 1
    marked = sl.select(*keys, days, "shipping_cost", "profit", "sales", (once & F.col("order_id").isNotNull()).cast("long").alias("_once"))
    per_day = marked.groupBy(*keys, "_days").agg(
        F.sum("_once").alias("_orders"), F.count(F.lit(1)).alias("_c"), F.sum("shipping_cost").alias("_cost"), F.sum("profit").alias("_p"),
        F.sum("sales").alias("_s"))
    counted = F.when(F.col("_days").isNotNull(), F.col("_c")).otherwise(F.lit(0))
    group = Window.partitionBy(*keys)
    upto = group.orderBy("_days").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    per_day = per_day.withColumn("_upto", F.sum(counted).over(upto)).withColumn("_n", F.sum(counted).over(group))

    def at(p):
        target = F.greatest(F.ceil(F.col("_n") * F.lit(Decimal(p))), F.lit(1))
        return F.max(F.when((F.col("_upto") >= target) & (F.col("_upto") - counted < target), F.col("_days")))

    a = per_day.groupBy(*keys).agg(
        F.sum("_orders").alias("orders"), F.sum(F.col("_days") * F.col("_c")).alias("_dsum"), F.sum(counted).alias("_dn"),
        at("0.5").alias("p50_days"), at("0.9").alias("p90_days"), F.sum("_cost").alias("_cost"), F.sum("_p").alias("_p"),
        F.sum("_s").alias("_s"))
    return a.select(*keys, "orders", _d(half_up_div("_dsum", "_dn", 2)).alias("avg_days"), "p50_days", "p90_days",
                    _d("_cost").alias("shipping_cost"), pct("_p", "_s").alias("margin_pct"))
