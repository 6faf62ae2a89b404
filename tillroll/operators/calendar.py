"""Time intelligence on a whole calendar: months without sales have a row too.

A group's months run from its first month with sales to the last month of the data; a month
without sales counts as 0, so a running total carries over it, a moving average covers
calendar months, and a change is against the month before. The spine is a bounded sequence
per group (one row per calendar month), joined to monthly aggregates; windows run on those
rows, never on order lines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillroll.functions.columns import half_up_div, month_start, pct

def _zero():
    return F.lit(0).cast("decimal(28,2)")


def whole_calendar(df: DataFrame, by: list[str], measure: str = "sales", date_col: str = "order_date") -> DataFrame:
    """*by, month, _v (decimal sum, 0 without rows), present: every month of every group."""
    monthly = (df.where(F.col(date_col).isNotNull()).groupBy(*by, month_start(date_col).alias("month"))
               .agg(F.coalesce(F.sum(measure).cast("decimal(28,2)"), _zero()).alias("_v")))
    last = monthly.agg(F.max("month")).scalar()
    spine = (monthly.groupBy(*by).agg(F.min("month").alias("_first")).withColumn("_last", last)
             .select(*[F.col(c).alias(f"_g_{c}") for c in by],
                     F.explode(F.sequence("_first", "_last", F.expr("INTERVAL 1 MONTH"))).alias("_m")))
    same = [F.col(c).eqNullSafe(F.col(f"_g_{c}")) for c in by] + [F.col("month") == F.col("_m")]
    on = same[0]
    for part in same[1:]:
        on = on & part
    return (spine.join(monthly, on, "left")
            .select(*[F.col(f"_g_{c}").alias(c) for c in by], F.col("_m").alias("month"),
                    F.coalesce("_v", _zero()).alias("_v"), F.col("_v").isNotNull().alias("present")))


def _d(c):
    return (F.col(c) if isinstance(c, str) else c).cast("double")


def total_ytd_calendar(df: DataFrame, by: list[str]) -> DataFrame:
    """*by, month, value, ytd: the running total of the calendar year, carried over months without sales."""
    w = Window.partitionBy(*by, F.year("month")).orderBy("month").rowsBetween(Window.unboundedPreceding, 0)
    m = whole_calendar(df, by)
    return m.select(*by, "month", _d("_v").alias("value"), _d(F.sum("_v").over(w)).alias("ytd"), "present")


def same_period_calendar(df: DataFrame, by: list[str]) -> DataFrame:
    """*by, month, value, prior, yoy_pct: the same month a year before, 0 where it had no sales and NULL
    before the group's first month. On a whole calendar that is simply the row twelve before."""
    w = Window.partitionBy(*by).orderBy("month")
    m = whole_calendar(df, by).withColumn("_p", F.lag("_v", 12).over(w))
    return m.select(*by, "month", _d("_v").alias("value"), _d("_p").alias("prior"), pct(F.col("_v") - F.col("_p"), "_p").alias("yoy_pct"))


def moving_average_calendar(df: DataFrame, by: list[str], window: int = 4) -> DataFrame:
    """*by, month, value, moving_avg over the last ``window`` calendar months (half-up 2 dp)."""
    w = Window.partitionBy(*by).orderBy("month").rowsBetween(-(window - 1), 0)
    m = whole_calendar(df, by)
    return m.select(*by, "month", _d("_v").alias("value"),
                    _d(half_up_div(F.sum("_v").over(w), F.count("_v").over(w), 2)).alias("moving_avg"))


def mom_change_calendar(df: DataFrame, by: list[str]) -> DataFrame:
    """*by, month, value, mom_pct: change over the calendar month before (NULL after a month of 0 or none)."""
    w = Window.partitionBy(*by).orderBy("month")
    m = whole_calendar(df, by).withColumn("_p", F.lag("_v").over(w))
    return m.select(*by, "month", _d("_v").alias("value"), pct(F.col("_v") - F.col("_p"), "_p").alias("mom_pct"))
