"""Period-over-period comparisons.

All windows here run after aggregation to one row per period (at most 12
month-of-year rows, or one per calendar month), never over raw lines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillroll.functions.columns import half_up_div, month_of_year, pct


def _d(c):
    return (F.col(c) if isinstance(c, str) else c).cast("double")


def _monthly_totals(sl: DataFrame, name: str) -> DataFrame:
    return sl.groupBy(month_of_year("order_date").alias(name)).agg(F.sum("sales").alias("_s"))


def mom_sales_diff(sl: DataFrame) -> DataFrame:
    """Month-of-year totals and the difference to the previous month-of-year."""
    m = _monthly_totals(sl, "monthly")
    prev = F.lag("_s").over(Window.orderBy("monthly"))
    return (m.select("monthly", _d("_s").alias("total_sales"), _d(F.col("_s") - prev).alias("diff"))
            .orderBy("monthly"))


def avg_mom_pct_change(sl: DataFrame) -> DataFrame:
    """Average of the month-over-month % changes, each rounded half-up to 2 dp;
    the average keeps 4 more decimals (half-up), as AVG of a DECIMAL does."""
    m = _monthly_totals(sl, "monthly")
    prev = F.lag("_s").over(Window.orderBy("monthly"))
    change = half_up_div((F.col("_s") - prev) * 100, prev, 2)
    per = m.select(change.alias("pc"))
    return per.agg(_d(F.avg("pc").cast("decimal(38,6)")).alias("average"))


def pct_growth_per_month(sl: DataFrame) -> DataFrame:
    """Sales per month-of-year and % growth over the previous month-of-year (unrounded)."""
    m = _monthly_totals(sl, "months")
    prev = F.lag("_s").over(Window.orderBy("months"))
    return (m.select("months", _d("_s").alias("sales"), pct(F.col("_s") - prev, prev).alias("percentage"))
            .orderBy("months"))


def period_trend(sl: DataFrame, period: str = "week", window: int = 4) -> DataFrame:
    """Sales per week (Monday start) or calendar month, with the moving average
    of the last ``window`` periods present (half-up 2 dp)."""
    start = F.to_date(F.date_trunc(period, F.col("order_date")))
    p = sl.groupBy(start.alias("period")).agg(F.sum("sales").alias("_s"))
    w = Window.orderBy("period").rowsBetween(-(window - 1), Window.currentRow)
    return p.select("period", _d("_s").alias("sales"),
                    _d(half_up_div(F.sum("_s").over(w), F.count("_s").over(w), 2)).alias("moving_avg"))


def seasonality_index(sl: DataFrame) -> DataFrame:
    """Per month-of-year: mean monthly sales of that month across years divided
    by the mean monthly sales over all months ( = (S_m * c) / (c_m * S) )."""
    monthly = sl.groupBy(F.trunc("order_date", "MM").alias("m")).agg(F.sum("sales").alias("_s"))
    moy = monthly.groupBy(F.month("m").alias("month_of_year")).agg(F.sum("_s").alias("_sm"),
                                                                  F.count(F.lit(1)).alias("_cm"))
    w = Window.partitionBy()
    total, count = F.sum("_sm").over(w), F.sum("_cm").over(w)
    index = (F.col("_sm") * count).cast("double") / (F.col("_cm") * total).cast("double")
    return moy.select("month_of_year", F.col("_cm").alias("months"), index.alias("index"))


def sales_anomalies(sl: DataFrame, trailing: int = 12, z_threshold: float = 2.0, min_periods: int = 3) -> DataFrame:
    """Monthly sales with a z-score against the previous ``trailing`` months
    (sample standard deviation) and ``is_anomaly`` when |z| > threshold.

    Moments are exact integers (cents); only the final formula is DOUBLE.
    """
    monthly = sl.groupBy(F.trunc("order_date", "MM").alias("month")).agg(F.sum("sales").alias("_s"))
    # monthly totals in cents can exceed the 64-bit product range: keep them DECIMAL(38,0)
    x = (F.col("_s") * 100).cast("decimal(38,0)")
    w = Window.orderBy("month").rowsBetween(-trailing, -1)
    m = monthly.select("month", "_s", x.alias("_x"), F.count("_s").over(w).alias("_n"),
                       F.sum(x).over(w).alias("_sx"), F.sum(x * x).over(w).alias("_sxx"))
    a = (F.col("_n").cast("decimal(38,0)") * F.col("_x") - F.col("_sx")).cast("double")
    b = (F.col("_n").cast("decimal(38,0)") * F.col("_sxx") - F.col("_sx") * F.col("_sx")).cast("double")
    z = F.when((F.col("_n") >= min_periods) & (b > 0), a / F.sqrt(b * F.col("_n") / (F.col("_n") - 1)))
    return m.select("month", _d("_s").alias("sales"), F.col("_n").alias("periods"), z.alias("z"),
                    (F.abs(z) > z_threshold).alias("is_anomaly"))
