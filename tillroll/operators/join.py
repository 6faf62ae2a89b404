"""Joins: returns, point lookups, and lines compared with group averages.

Scale notes
-----------
* ``IN (subquery)`` becomes a ``left_semi`` join and LEFT JOIN + IS NULL a
  ``left_anti`` join, so the fact side never carries the other side's columns.
* "Lines above/below their group's average" joins the fact with an aggregate
  of itself. The aggregate is partial+final (hot keys pre-aggregate); the join
  back salts hot groups by their own row counts (``attach_group_stats``), since
  AQE's skew split does not apply when one side is an aggregate; AQE may still
  turn it into a broadcast join after measuring the aggregate. A window average
  partitioned by the group would put a hot group's rows into one task.
* The month-of-year average has at most 12 rows, a bound known before the
  data is read, so it is broadcast explicitly.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillroll.functions.columns import decimals_to_double, exact_avg, half_up_round, month_of_year
from tillroll.operators.quantile import null_safe_join


#: columns by which the lines of a group are spread (next to unique; equal pairs only share a salt)
LINE_KEY = ["order_id", "line_number"]


def _d(c):
    return (F.col(c) if isinstance(c, str) else c).cast("double")


def returned_orders_by_region(sl: DataFrame, returns: DataFrame, period: str = "date") -> DataFrame:
    """Returned order lines with region and order date (or month-of-year).

    ``returns`` has one row per order, so the inner join does not fan out.
    """
    r = returns.select(F.col("order_id").alias("return_order_id"))
    joined = sl.join(r, sl.order_id == r.return_order_id)
    when = (F.col("order_date") if period == "date" else month_of_year("order_date").alias("monthly"))
    return joined.select("order_id", "return_order_id", "region", when)


def returned_order_details(sl: DataFrame, returns: DataFrame) -> DataFrame:
    """Full lines of returned orders (semi join straight to the returns table)."""
    return decimals_to_double(sl.join(returns.select("order_id"), "order_id", "left_semi"))


def lookup_row(sl: DataFrame, row_id: str) -> DataFrame:
    """The line with this row id. The id starts with its order's key, so the scan is
    filtered on that as well, before the id is built."""
    order_id = int(row_id.split("-", 1)[0])
    return decimals_to_double(sl.where((F.col("order_id") == order_id) & (F.col("row_id") == row_id)))


def lookup_return(returns: DataFrame, order_id: int) -> DataFrame:
    return returns.where(F.col("order_id") == order_id)


def orders_with_returns(sl: DataFrame, returns: DataFrame) -> DataFrame:
    """Every line with its return status (NULL when not returned)."""
    r = returns.select(F.col("order_id").alias("return_order_id"), "order_status")
    return decimals_to_double(sl.join(r, sl.order_id == r.return_order_id, "left"))


def _product_avg(sl: DataFrame) -> DataFrame:
    """product_name, avg_sales (ROUND(AVG, 2), exact), n (lines of the product)."""
    return sl.groupBy("product_name").agg(half_up_round(exact_avg("sales"), 2).alias("avg_sales"),
                                          F.count(F.lit(1)).alias("n"))


def lines_below_product_avg(sl: DataFrame) -> DataFrame:
    """Lines whose sales are under their product's (2 dp) average line sales.
    The average is joined back with hot products salted (``attach_group_stats``)."""
    lines = sl.select("product_name", "sales", *LINE_KEY)
    j = attach_group_stats(lines, _product_avg(sl), ["product_name"], ["avg_sales"], LINE_KEY, how="inner")
    return (j.where(F.col("sales") < F.col("avg_sales"))
            .select("product_name", _d("avg_sales").alias("avg_sales"), _d("sales").alias("sales")))


def customer_day_below_product_avg(sl: DataFrame) -> DataFrame:
    """Customer x day x product totals under the product's average line sales."""
    per = (sl.groupBy("order_date", "customer_name", "product_name").agg(F.sum("sales").alias("_s2")))
    j = attach_group_stats(per, _product_avg(sl), ["product_name"], ["avg_sales"],
                           ["order_date", "customer_name", "product_name"], how="inner")
    return (j.where(F.col("_s2") < F.col("avg_sales"))
            .select("order_date", "customer_name", _d("_s2").alias("sales2"), "product_name",
                    _d("avg_sales").alias("sales")))


def lines_above_month_avg(sl: DataFrame) -> DataFrame:
    """Lines whose sales exceed the ROUND(AVG, 0) of their month-of-year."""
    monthly = (sl.groupBy(month_of_year("order_date").alias("monthly"))
               .agg(half_up_round(exact_avg("sales"), 0).alias("avg_sales")))
    lines = sl.select("customer_id", month_of_year("order_date").alias("month_wise"), "product_name",
                      "sales", "profit")
    joined = lines.join(F.broadcast(monthly), lines.month_wise == monthly.monthly)
    return (joined.where(F.col("sales") > F.col("avg_sales"))
            .select("customer_id", "month_wise", "product_name", _d("sales").alias("sales"),
                    _d("profit").alias("profit"), "monthly", _d("avg_sales").alias("avg_sales")))


def lines_above_month_region_subcat_avg(sl: DataFrame) -> DataFrame:
    """Lines above the ROUND(AVG, 0) of their month-of-year x region x sub-category."""
    keys = ["month_wise", "region", "product_sub_category"]
    lines = sl.select("customer_id", month_of_year("order_date").alias("month_wise"), "region",
                      "product_sub_category", "product_name", "sales", "profit", *LINE_KEY)
    avg = lines.groupBy(*keys).agg(half_up_round(exact_avg("sales"), 0).alias("avg_sales"),
                                   F.count(F.lit(1)).alias("n"))
    return (attach_group_stats(lines, avg, keys, ["avg_sales"], LINE_KEY, how="inner")
            .where(F.col("sales") > F.col("avg_sales"))
            .select("customer_id", "month_wise", "region", "product_sub_category", "product_name",
                    _d("sales").alias("sales"), _d("profit").alias("profit"), _d("avg_sales").alias("avg_sales"))
            .orderBy("month_wise", "region", "product_sub_category", "customer_id"))


def snowflake_join(fact: DataFrame, dims: list[tuple]) -> DataFrame:
    """Join a fact with a chain of dimensions and sub-dimensions (snowflake).

    ``dims`` is a list of (dim, left_key, right_key) applied in order, each key
    already present after the previous joins. Dimension sizes are measured by
    Spark (broadcast when small, sort-merge otherwise); nothing is forced.
    """
    out = fact
    for dim, left_key, right_key in dims:
        out = out.join(dim, F.col(left_key) == dim[right_key])
    return out


#: A group is hot when it holds more than 1 / HOT_SHARE of all rows; so there are
#: fewer than HOT_SHARE hot groups, whatever the data, and that many keys are broadcast.
HOT_SHARE = 20_000


def attach_group_stats(df: DataFrame, stats: DataFrame, keys: list[str], cols: list[str],
                       row_key: list[str], n_col: str = "n", how: str = "left") -> DataFrame:
    """Join per-group statistics (one row per group, with its row count ``n_col``) onto
    the rows of ``df``, splitting hot groups; NULL keys are a group like any other.

    One plan for all sizes. A hot group gets ceil(n * HOT_SHARE / total) salts, so that
    no (group, salt) holds more than about 1 / HOT_SHARE of all rows; the salt of a row
    is a hash of ``row_key``, columns (next to) unique per row, so equal rows part as well. The
    hot keys and their salts (fewer than HOT_SHARE rows) are broadcast, the statistics
    of a hot group come once per salt, and all other groups keep salt 0. The result is
    that of the plain join.
    """
    total = stats.agg(F.sum(n_col)).scalar()
    salts = F.ceil(F.col(n_col) * F.lit(HOT_SHARE) / total).cast("int")
    hot = F.broadcast(stats.where(F.col(n_col) * F.lit(HOT_SHARE) > total).select(*keys, salts.alias("_salts")))
    rows = null_safe_join(df, hot, keys, "left")
    own = F.when(F.col("_salts").isNotNull(), F.pmod(F.xxhash64(*row_key), F.col("_salts"))).otherwise(F.lit(0))
    rows = rows.withColumn("_salt", own.cast("int")).drop("_salts")
    several = F.when(F.col(n_col) * F.lit(HOT_SHARE) > total, salts).otherwise(F.lit(1))
    salted = stats.select(*keys, *cols, F.explode(F.sequence(F.lit(0), several - 1)).alias("_salt"))
    return null_safe_join(rows, salted, [*keys, "_salt"], how).drop("_salt")
