"""Ranking, top-k per group and positional (n-th row) operators.

Scale notes
-----------
* Top-k per group ranks *aggregated* rows (one per key), and the rank filter
  lets Catalyst insert a ``WindowGroupLimit`` below the shuffle, so each task
  ships at most k candidates per group.
* ROW_NUMBER always gets a total order (all group keys as tie-break) so
  results do not depend on task order.
* A global position over raw rows (``global_position``) never goes through a
  single partition: rows are range-partitioned on the sort key (plus a unique
  tie-break, so even one hot value is split), numbered inside each partition,
  and shifted by the running count of the partitions before them. Only one
  row per partition is combined on a single task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillroll.functions.columns import month_of_year
from tillroll.operators.quantile import at_positions, counted, rows_before, whole_number


def _d(c):
    return (F.col(c) if isinstance(c, str) else c).cast("double")


def top_k_per_group(agg: DataFrame, partition_by, order_by, k: int = 1, fn: str = "rank",
                    name: str = "ranking", keep_rank: bool = True, strict: bool = False) -> DataFrame:
    """Keep rows whose rank within ``partition_by`` is <= k (``< k`` when ``strict``).

    ``fn`` is 'rank' / 'dense_rank' (ties kept) or 'row_number' (exactly k,
    the caller must give a total order).
    """
    w = Window.partitionBy(*partition_by).orderBy(*order_by)
    rank_col = {"rank": F.rank(), "dense_rank": F.dense_rank(), "row_number": F.row_number()}[fn].over(w)
    out = agg.withColumn(name, rank_col)
    out = out.where(F.col(name) < k) if strict else out.where(F.col(name) <= k)
    return out if keep_rank else out.drop(name)


def top_ship_mode_by_state(sl: DataFrame) -> DataFrame:
    agg = sl.groupBy("state_province", "ship_mode").agg(F.count("ship_mode").alias("no_of_times"))
    return top_k_per_group(agg, ["state_province"], [F.desc("no_of_times")], 1, "rank")


def ship_mode_winner_tally(sl: DataFrame) -> DataFrame:
    """How many states each winning ship mode takes, and its total uses there."""
    return (top_ship_mode_by_state(sl).groupBy("ship_mode")
            .agg(F.count(F.lit(1)).alias("occurance"), F.sum("no_of_times").alias("total_times")))


def region_priority_container_index(sl: DataFrame) -> DataFrame:
    """Counts, sales and profit per region x priority x container, numbered in
    region order (tie-broken by the other keys). The global window runs on the
    aggregated rows only."""
    agg = (sl.groupBy("region", "order_priority", F.col("product_container").alias("container"))
           .agg(F.count(F.lit(1)).alias("no_of_items"), F.sum("sales").alias("_s"),
                F.sum("profit").alias("_p")))
    idx = F.row_number().over(Window.orderBy("region", "order_priority", "container"))
    return (agg.select(idx.alias("r_index"), "region", "order_priority", "container", "no_of_items",
                       _d("_s").alias("t_sales"), _d("_p").alias("t_profit"))
            .orderBy("r_index"))


def top_products_per_category(sl: DataFrame, k: int = 3) -> DataFrame:
    """Products with DENSE_RANK < k by total sales inside their category."""
    agg = sl.groupBy("product_category", "product_name").agg(F.sum("sales").alias("_s"))
    top = top_k_per_group(agg, ["product_category"], [F.desc("_s")], k, "dense_rank", strict=True)
    return (top.orderBy("product_category", "_s")
            .select("product_category", "product_name", _d("_s").alias("total_sales"), "ranking"))


def customers_in_n_categories(sl: DataFrame, n: int = 3) -> DataFrame:
    """Customers who bought in at least ``n`` categories (relational division);
    ``categorizing`` is n, the position the reference filters on."""
    per = (sl.select("customer_id", "product_category").distinct()
           .groupBy("customer_id").agg(F.count(F.lit(1)).alias("_n")))
    return per.where(F.col("_n") >= n).select("customer_id", F.lit(n).cast("int").alias("categorizing"))


def products_in_n_regions(sl: DataFrame, n: int = 4) -> DataFrame:
    """Products sold in at least ``n`` regions, carrying the n-th region by name."""
    pairs = sl.select("product_name", "region").distinct()
    w = Window.partitionBy("product_name").orderBy("region")
    return pairs.withColumn("listing", F.rank().over(w)).where(F.col("listing") == n)


def product_region_drill(sl: DataFrame, product: str) -> DataFrame:
    return sl.where(F.col("product_name") == product).select("product_name", "region").distinct()


def top_subcat_per_region(sl: DataFrame) -> DataFrame:
    """Most ordered sub-category per region, ties kept: the reference's correlated
    HAVING subquery (count = the region's max count), written as RANK = 1 so
    Spark applies a partial top-k before the shuffle (WindowGroupLimit)."""
    agg = sl.groupBy("product_sub_category", "region").agg(F.count("product_sub_category").alias("occurance"))
    top = top_k_per_group(agg, ["region"], [F.desc("occurance")], 1, "rank", name="_r")
    return top.select("region", "product_sub_category", F.col("occurance").alias("max_occurance"))


def top_subcat_per_region_rank(sl: DataFrame) -> DataFrame:
    """Same answer through DENSE_RANK (must equal ``top_subcat_per_region``)."""
    agg = sl.groupBy("product_sub_category", "region").agg(F.count("product_sub_category").alias("occurance"))
    return top_k_per_group(agg, ["region"], [F.desc("occurance")], 1, "dense_rank", name="top_most")


def top_product_per_state(sl: DataFrame) -> DataFrame:
    agg = sl.groupBy("state_province", "product_name").agg(F.count("product_name").alias("occurance"))
    return top_k_per_group(agg, ["state_province"], [F.desc("occurance")], 1, "dense_rank")


def best_and_worst_cells(sl: DataFrame) -> DataFrame:
    """Highest and lowest selling region x state x category x sub-category cell
    per category (RANK, ties kept), UNION ALL of the two; one aggregate feeds both."""
    agg = (sl.groupBy("region", "state_province", "product_category", "product_sub_category")
           .agg(F.sum("sales").alias("_s")))
    w = Window.partitionBy("product_category")
    ranked = agg.select("*", F.rank().over(w.orderBy(F.desc("_s"))).alias("_hi"),
                        F.rank().over(w.orderBy("_s")).alias("_lo"))
    cols = ["region", "state_province", "product_category", "product_sub_category", _d("_s").alias("t_sales")]
    best = ranked.where(F.col("_hi") == 1).select(*cols, F.col("_hi").alias("maximum"))
    worst = ranked.where(F.col("_lo") == 1).select(*cols, F.col("_lo").alias("maximum"))
    return best.unionAll(worst)


def best_ship_mode_by_state(sl: DataFrame, k: int = 1) -> DataFrame:
    """One ship mode per state: highest profit, then most uses, then mode name."""
    agg = sl.groupBy("state_province", "ship_mode").agg(F.count("ship_mode").alias("counts"),
                                                         F.sum("profit").alias("_p"))
    top = top_k_per_group(agg, ["state_province"], [F.desc("_p"), F.desc("counts"), "ship_mode"], k,
                          "row_number")
    return top.select("state_province", "ship_mode", "counts", _d("_p").alias("total_profits"), "ranking")


def top_state_per_month(sl: DataFrame, k: int = 1) -> DataFrame:
    agg = (sl.groupBy(month_of_year("order_date").alias("months"), "state_province")
           .agg(F.sum("profit").alias("_p")))
    top = top_k_per_group(agg, ["months"], [F.desc("_p"), "state_province"], k, "row_number")
    return top.select("months", "state_province", _d("_p").alias("profits"), "ranking")


# --- positions over raw rows (counted values, no sort of the rows) --------

#: rows of one equal value that a task numbers
POSITIONS_PER_ROW = 10_000


def nth_value(df: DataFrame, column: str, n: Column | int, name: str = "position") -> DataFrame:
    """The value of ``column`` at 1-based position ``n`` in sorted order, and ``n``; no row
    when there is no such position. ``n`` may be a column over the row count ``_n``."""
    _, back = whole_number(df, column)
    hist = counted(df.withColumn("_all", F.lit(0)), ["_all"], column)
    want = (F.lit(n) if isinstance(n, int) else n).cast("long")
    wanted = hist.groupBy("_all").agg(F.sum("_c").alias("_n")).select("_all", want.alias(name), want.alias("_want"))
    return at_positions(hist, ["_all"], wanted).select(back(F.col("_v")).alias(column), name)


def sorted_positions(df: DataFrame, column: str, name: str = "position") -> DataFrame:
    """Every non-NULL value of ``column`` with its 1-based position in sorted order.

    Equal values take consecutive positions, so each distinct value is expanded to
    its run of positions; a long run is cut first and its cuts are spread over tasks.
    """
    _, back = whole_number(df, column)
    runs = rows_before(counted(df, [], column))
    cuts = runs.select("_v", "_c", "_before", F.explode(F.sequence(
        F.lit(0).cast("long"), F.floor((F.col("_c") - 1) / POSITIONS_PER_ROW))).alias("_cut")).repartition("_v", "_cut")
    start, end = F.col("_cut") * POSITIONS_PER_ROW + 1, F.least((F.col("_cut") + 1) * POSITIONS_PER_ROW, F.col("_c"))
    return (cuts.select(back(F.col("_v")).alias(column), "_before", F.explode(F.sequence(start, end)).alias("_i"))
            .select(column, (F.col("_before") + F.col("_i")).cast("bigint").alias(name)))


def nth_sales_value(sl: DataFrame, n: int = 863) -> DataFrame:
    """The sales value at sorted position ``n``."""
    return nth_value(sl.select("sales"), "sales", n, "numbering").select(_d("sales").alias("sales"), "numbering")


def sales_value_index(sl: DataFrame, max_value: float = 3000) -> DataFrame:
    """Position of every sale <= ``max_value`` among those sales, in sales order."""
    small = sl.where(F.col("sales") <= F.lit(max_value).cast("decimal(18,2)")).select("sales")
    return sorted_positions(small, "sales", "numbering").select(_d("sales").alias("sales"), "numbering")


def median_profit(sl: DataFrame) -> DataFrame:
    """The median line profit (lower median for an even count) and its position, ceil(n / 2)."""
    middle = F.floor((F.col("_n") + 1) / 2)
    return nth_value(sl.select("profit"), "profit", middle, "ranking").select(_d("profit").alias("profit"), "ranking")
