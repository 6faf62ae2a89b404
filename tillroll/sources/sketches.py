"""Stored sketches: distinct counts and quantiles over any span of months, without the lines.

Counts of distinct customers do not add up over months, and neither do medians, so a
report on another span reads all lines again. Here every (month, region, category) keeps a
theta sketch of its customers and of its orders, a KLL sketch of its line values, and its
exact sums. Sketches of any months, regions or categories merge into the sketch of them all.

Errors: a theta sketch is exact up to ``2 ** LG_ENTRIES`` distinct values and has a relative
standard error of about 1 / sqrt(2 ** LG_ENTRIES) beyond (1.6 % at 12); a KLL sketch with
k = ``KLL_K`` has a rank error of about 1.3 % at 200. The exact keys stay the default.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillroll.functions.columns import month_start

LG_ENTRIES = 12
KLL_K = 200
GRAIN = ("month", "region", "product_category")


def build_sketches(lines: DataFrame, grain: tuple = GRAIN) -> DataFrame:
    """One row per grain from order lines: customers, orders (theta), sales_kll (cents), sales, lines.

    Sketches are partial aggregates: a map task hands on one sketch per group, whatever its lines.
    """
    rows = lines.withColumn("month", month_start("order_date"))
    return rows.groupBy(*grain).agg(
        F.theta_sketch_agg("customer_id", LG_ENTRIES).alias("customers"), F.theta_sketch_agg("order_id", LG_ENTRIES).alias("orders"),
        F.kll_sketch_agg_bigint((F.col("sales") * 100).cast("long"), KLL_K).alias("sales_kll"),
        F.sum("sales").alias("sales"), F.count(F.lit(1)).alias("lines"))


def store_sketches(lines: DataFrame, path: str, months: list[str] | None = None) -> None:
    """Write the sketches below ``path``, one folder per month.

    With ``months`` ('yyyy-MM') only those are built again and replace their folders, so a
    late line costs its month and not the table.
    """
    if months is not None:
        lines = lines.where(F.date_format("order_date", "yyyy-MM").isin(months))
    (build_sketches(lines).withColumn("order_month", F.date_format("month", "yyyy-MM"))
     .repartition("order_month").write.mode("overwrite").option("partitionOverwriteMode", "dynamic" if months is not None else "static")
     .partitionBy("order_month").parquet(path))


def read_sketches(spark: SparkSession, path: str, first: str, last: str) -> DataFrame:
    """Sketch rows of the months ``first`` to ``last`` ('yyyy-MM', both included); others' folders are not read."""
    return spark.read.parquet(path).where(F.col("order_month").between(first, last))


def merged(sketches: DataFrame, by: list[str]) -> DataFrame:
    """customers, orders, median_sales, p90_sales, sales and lines per ``by``, from sketches alone."""
    a = sketches.groupBy(*by).agg(
        F.theta_union_agg("customers", LG_ENTRIES).alias("_c"), F.theta_union_agg("orders", LG_ENTRIES).alias("_o"),
        F.kll_merge_agg_bigint("sales_kll", KLL_K).alias("_q"), F.sum("sales").alias("_s"), F.sum("lines").alias("lines"))
    at = lambda p: (F.kll_sketch_get_quantile_bigint("_q", F.lit(p)) / 100).cast("double")
    return a.select(*by, F.theta_sketch_estimate("_c").alias("customers"), F.theta_sketch_estimate("_o").alias("orders"),
                    at(0.5).alias("median_sales"), at(0.9).alias("p90_sales"), F.col("_s").cast("double").alias("sales"), "lines")


def rolling_customers(lines: DataFrame, by: list[str], months: int = 12) -> DataFrame:
    """*by, month, customers, of the ``months`` calendar months that end with each month of the data.

    Each line meets one sketch of its month; the sketches, not the lines, are copied to the
    spans that hold them.
    """
    monthly = (lines.groupBy(*by, month_start("order_date").alias("m"))
               .agg(F.theta_sketch_agg("customer_id", LG_ENTRIES).alias("_c")))
    last = monthly.agg(F.max("m")).scalar()
    spans = (monthly.withColumn("_last", last)
             .select(*by, "_c", "_last", F.explode(F.transform(F.sequence(F.lit(0), F.lit(months - 1)), lambda k: F.add_months("m", k))).alias("month"))
             .where(F.col("month") <= F.col("_last")))
    return spans.groupBy(*by, "month").agg(F.theta_sketch_estimate(F.theta_union_agg("_c", LG_ENTRIES)).alias("customers"))
