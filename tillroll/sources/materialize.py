"""Materialised order-line table for repeated analysis at scale.

A BI workload runs many queries over the same star join. Writing the joined
order lines once -- Parquet, partitioned by order month -- turns every later
query into a columnar scan with column pruning and month-partition pruning,
instead of re-running the lineitem / orders / customer / part joins each time.
The registered queries read the driver tables directly; this is the
deployment option for large, repeated workloads.

Partitioned by region too, a reader who may see some regions reads their folders alone: the
regions come from the security table while the query runs (dynamic partition pruning).

``relabel_materialized`` is the UPDATE of stored lines: months without a matching row keep
their files as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tillroll.sources.binding import SALES_LINE_COLUMNS, sales_line

PARTITION_COLUMN = "order_month"


def materialize_sales_line(spark: SparkSession, sf_dir: str, path: str, mode: str = "overwrite", by_region: bool = False) -> None:
    """Write the full order-line table to ``path``, partitioned by order month, and first by region with ``by_region``.

    Lines are range-partitioned by (month, order), so a task holds one stretch of
    months and a large month is spread over several tasks: few files per month.
    """
    lines = sales_line(spark, sf_dir, first="part").withColumn(PARTITION_COLUMN, F.date_format("order_date", "yyyy-MM"))
    folders = ["region", PARTITION_COLUMN] if by_region else [PARTITION_COLUMN]
    (lines.repartitionByRange(*folders, "order_id")
     .write.mode(mode).partitionBy(*folders).parquet(path))


def read_materialized(spark: SparkSession, path: str, columns=None, months: list[str] | None = None) -> DataFrame:
    """The materialised order lines (optionally only some columns / months;
    the month filter prunes whole directories)."""
    df = spark.read.parquet(path)
    if months is not None:
        df = df.where(F.col(PARTITION_COLUMN).isin(months))
    want = [c for c in SALES_LINE_COLUMNS if columns is None or c in set(columns)]
    return df.select(*want)


def read_for_manager(spark: SparkSession, path: str, users: DataFrame, manager: str, columns=None) -> DataFrame:
    """The lines of the regions that ``manager`` may see, from a table partitioned by region.

    The semi join is on the partition column, so Spark reads the security table first and
    then only the folders of its regions.
    """
    allowed = users.where(F.col("manager") == manager).select("region")
    lines = read_materialized(spark, path, None if columns is None else [*columns, "region"])
    return lines.join(F.broadcast(allowed), "region", "left_semi").select(*(columns or lines.columns))


# --- customer-months ------------------------------------------------------------

def materialize_customer_months(spark: SparkSession, sf_dir: str, table: str, path: str, buckets: int = 64) -> None:
    """Write one row per customer and month with orders to ``table``, bucketed and sorted by customer.

    Retention, churn, first and last orders and lifespans all group or order by customer: on
    this table they start without a shuffle, since the rows of a customer lie in one bucket.
    """
    months = (sales_line(spark, sf_dir, ["customer_id", "customer_name", "order_date", "sales", "lines"], grain="order")
              .groupBy("customer_id", "customer_name", F.trunc("order_date", "MM").alias("month"))
              .agg(F.min("order_date").alias("first_order"), F.max("order_date").alias("last_order"),
                   F.count(F.lit(1)).alias("orders"), F.sum("lines").alias("lines"), F.sum("sales").alias("sales")))
    (months.repartition(buckets, "customer_id").write.mode("overwrite").option("path", path)
     .bucketBy(buckets, "customer_id").sortBy("customer_id", "month").saveAsTable(table))


def read_customer_months(spark: SparkSession, table: str) -> DataFrame:
    """customer_id, customer_name, month, first_order, last_order, orders, lines, sales."""
    return spark.table(table)


# --- UPDATE of stored lines -----------------------------------------------------

STAGED, READY, REPLACED = "_rewrite_staged", "_rewrite_ready", "_rewrite_replaced"


def _fs(spark: SparkSession, path: str):
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return hadoop(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hadoop


def relabel_materialized(spark: SparkSession, path: str, condition: Column, changes: dict[str, Column]) -> list[str]:
    """SET ``changes`` WHERE ``condition`` on stored lines; returns the months that were rewritten.

    1. The months that hold a matching row are found (column pruning: the condition's columns).
    2. Those months are written anew below ``path`` under a name that readers skip.
    3. Its list of months is put beside it, in one rename: from now on the rewrite counts.
    4. Each month's folder is swapped for the new one, and the old one deleted.

    A crash before 3 leaves the table as it was; after 3, ``finish_rewrite`` (called first by
    every rewrite) completes the swaps, each of which may be repeated. Lines are rewritten
    with the condition evaluated on their old values, all changes at once, as UPDATE does.
    """
    finish_rewrite(spark, path)
    fs, hadoop = _fs(spark, path)
    lines = spark.read.parquet(path)
    hit = F.coalesce(condition, F.lit(False))
    months = sorted(r[0] for r in lines.where(hit).select(PARTITION_COLUMN).distinct().collect())
    if not months:
        return []
    staged = f"{path}/{STAGED}"
    fs.delete(hadoop(staged), True)
    new = {c: F.when(hit, value).otherwise(F.col(c)).cast(lines.schema[c].dataType) for c, value in changes.items()}
    touched = lines.where(F.col(PARTITION_COLUMN).isin(months))
    (touched.select(*[new.get(c, F.col(c)).alias(c) for c in lines.columns])
     .repartitionByRange(PARTITION_COLUMN, "order_id").write.mode("overwrite").partitionBy(PARTITION_COLUMN).parquet(staged))
    listing = f"{path}/_rewrite_list"
    out = fs.create(hadoop(listing), True)
    out.write(bytearray("\n".join(months).encode()))
    out.close()
    if not fs.rename(hadoop(listing), hadoop(f"{path}/{READY}")):
        raise RuntimeError(f"cannot commit the rewrite of {path}")
    finish_rewrite(spark, path)
    return months


def finish_rewrite(spark: SparkSession, path: str) -> None:
    """Complete the swaps of a committed rewrite; nothing to do without one."""
    fs, hadoop = _fs(spark, path)
    ready, staged, replaced = (hadoop(f"{path}/{x}") for x in (READY, STAGED, REPLACED))
    if not fs.exists(ready):
        return
    stream = fs.open(ready)
    months = bytes(stream.readAllBytes()).decode().split("\n")
    stream.close()
    fs.mkdirs(replaced)
    for month in months:
        name = f"{PARTITION_COLUMN}={month}"
        fresh, old, live = hadoop(staged, name), hadoop(replaced, name), hadoop(f"{path}/{name}")
        if not fs.exists(fresh):
            continue                                          # swapped before the crash
        if fs.exists(live) and not fs.exists(old):
            fs.rename(live, old)
        fs.delete(live, True)
        fs.rename(fresh, live)
    for leftover in (ready, staged, replaced):
        fs.delete(leftover, True)
    spark.catalog.refreshByPath(path)                         # cached rows and file listings are out of date
