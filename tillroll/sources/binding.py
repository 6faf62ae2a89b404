"""Binding of the driver's star schema to the retail order-line shape.

The analytic operators are written against one wide order-line table
(``sales_line``: one row per order line, with customer, product and geography
attributes) plus two small tables (``o_return``: returned orders, ``users``:
region -> manager). The driver tables are TPC-H-like, so the order line is

    lineitem ⋈ orders ⋈ customer ⋈ nation ⋈ region ⋈ part

Scale notes
-----------
* Only the tables whose columns are asked for are joined. The dimension joins
  are key/foreign-key joins (every lineitem has its order, part, customer,
  nation, region), so leaving out an unreferenced dimension does not change the
  rows; ``validate`` (operators/quality.py) checks that integrity, and the
  oracle SQL always joins every table, which re-checks it on every run.
* ``orders`` is joined to the customer geography *before* it meets
  ``lineitem``: the fact table is shuffled on the order key once, instead of
  once per dimension; queries at line grain that also need part attributes
  shuffle it a second time, on the part key. Queries that return every line
  whole meet ``part`` first (``first='part'``): the second shuffle then carries
  the part's few short values, not the order's and the customer's.
* ``nation`` and ``region`` are never broadcast by hand; their parquet size is
  known at planning time and Spark's own size threshold broadcasts them. Larger
  sides are left to sort-merge joins that AQE may convert after measuring them.
* Money is DECIMAL(18,2) from the start, so sums are exact and do not depend on
  partitioning or task order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tillroll.functions.columns import MONEY
from tillroll.sources.tables import read_table

# Which source a sales_line column needs (beyond lineitem itself).
_NEEDS_ORDERS = {"order_priority", "order_date", "customer_id", "city"}
_NEEDS_CUSTOMER = {"customer_name", "customer_segment"}
_NEEDS_NATION = {"state_province"}
_NEEDS_REGION = {"region"}
_NEEDS_PART = {"product_category", "product_sub_category", "product_container",
               "product_name", "product_base_margin", "unit_price", "profit"}

SALES_LINE_COLUMNS = (
    "row_id", "order_priority", "customer_id", "customer_name", "ship_mode",
    "customer_segment", "product_category", "product_sub_category",
    "product_container", "product_name", "product_base_margin", "country",
    "region", "state_province", "city", "order_date", "ship_date", "discount",
    "unit_price", "shipping_cost", "profit", "quantity_ordered_new", "sales",
    "order_id",
)
# Columns a query may ask for beside those.
EXTRA_COLUMNS = ("line_number",)

# Fixed values of the binding (not data): the users table maps each region of
# the driver's region table to a manager; one of them is the manager with the
# special bonus rule.
REGION_MANAGERS = {
    "AFRICA": "Erin",
    "AMERICA": "Chris",
    "ASIA": "Sam",
    "EUROPE": "William",
    "MIDDLE EAST": "Anna",
}
COUNTRY = "WORLD"


def _customer_geo(spark: SparkSession, sf_dir: str, need_customer: bool, need_nation: bool,
                  need_region: bool) -> DataFrame:
    cust = read_table(spark, sf_dir, "customer")
    cols = [F.col("c_custkey")]
    if need_customer:
        cols += [F.col("c_name").alias("customer_name"),
                 F.col("c_mktsegment").alias("customer_segment")]
    if need_nation or need_region:
        nation = read_table(spark, sf_dir, "nation")
        cust = cust.join(nation, cust.c_nationkey == nation.n_nationkey)
        if need_nation:
            cols.append(F.col("n_name").alias("state_province"))
        if need_region:
            region = read_table(spark, sf_dir, "region")
            cust = cust.join(region, F.col("n_regionkey") == region.r_regionkey)
            cols.append(F.col("r_name").alias("region"))
    return cust.select(*cols)


# Columns available at order grain (one row per order): order attributes and
# the additive line measures, summed per order.
ORDER_GRAIN_COLUMNS = ("order_priority", "customer_id", "customer_name", "customer_segment", "country",
                       "region", "state_province", "city", "order_date", "order_id",
                       "sales", "quantity_ordered_new", "shipping_cost", "lines")
_ORDER_MEASURES = ("sales", "quantity_ordered_new", "shipping_cost", "lines")


def _order_level_exprs() -> dict:
    """Order-level columns from orders (+ the customer geography columns)."""
    return {
        "order_priority": F.col("o_orderpriority"),
        "customer_id": F.col("o_custkey"),
        "customer_name": F.col("customer_name"),
        "customer_segment": F.col("customer_segment"),
        "region": F.col("region"),
        "state_province": F.col("state_province"),
        "city": F.concat(F.lit("CITY_"), (F.col("o_custkey") % 97).cast("string")),
        "order_date": F.to_date(F.col("o_orderdate")),
    }


def sales_line(spark: SparkSession, sf_dir: str, columns=None, order_join=None, grain: str = "line",
               first: str = "order") -> DataFrame:
    """The order-line table, restricted to ``columns`` (all when None).

    Columns come out in the declared order of ``SALES_LINE_COLUMNS``.

    ``order_join = (table, how, keep)`` joins an order-keyed table (column
    ``order_id``) to ``lineitem`` *before* any dimension: ``how`` is 'left_semi',
    'inner' or 'left', ``keep`` maps output names to the table's columns
    (appended after the order-line columns). Joined here, the table shares the
    order-key partitioning of the orders join, so a semi join shrinks the fact
    before the part join instead of re-shuffling every wide line afterwards.

    ``grain='order'`` pre-aggregates lineitem to one row per order *before* the
    joins (sales, quantity and shipping cost summed and lines counted per order). Only
    for queries that group by order-level attributes and only sum these measures:
    the sums are unchanged (exact decimals), while the fact shuffle carries one
    partial aggregate per order instead of every line (lines of an order are
    stored together, so the map-side combine is effective), and the aggregate's
    order-key partitioning is reused by the orders join.

    ``first='part'`` joins ``part`` before everything else and derives what it can
    after the last shuffle, for queries that keep every line: the same rows, fewer
    bytes shuffled. A filter on orders or customers shrinks the lines early only
    with ``first='order'``, so it does not go with a semi or inner ``order_join``.
    """
    if first not in ("order", "part"):
        raise ValueError(first)
    if first == "part":
        if grain != "line" or (order_join is not None and order_join[1] != "left"):
            raise ValueError("first='part' is for whole lines, with no or a left order_join")
        return _lines_part_first(spark, sf_dir, columns, order_join)
    if grain == "order":
        return _order_grain(spark, sf_dir, columns)
    if grain == "part":
        return _part_grain(spark, sf_dir, columns)
    if grain != "line":
        raise ValueError(grain)
    known = SALES_LINE_COLUMNS + EXTRA_COLUMNS
    want = list(SALES_LINE_COLUMNS) if columns is None else [c for c in known if c in set(columns)]
    missing = set(columns or ()) - set(known)
    if missing:
        raise ValueError(f"unknown sales_line columns: {sorted(missing)}")
    wanted = set(want)
    need_region = bool(wanted & _NEEDS_REGION)
    need_nation = bool(wanted & _NEEDS_NATION)
    need_customer = bool(wanted & _NEEDS_CUSTOMER)
    need_orders = bool(wanted & (_NEEDS_ORDERS | _NEEDS_CUSTOMER | _NEEDS_NATION | _NEEDS_REGION))
    need_part = bool(wanted & _NEEDS_PART)

    li = read_table(spark, sf_dir, "lineitem")
    fact = li
    keep = {}
    if order_join is not None:
        table, how, keep = order_join
        keep = dict(keep or {})
        right = table.select(F.col("order_id").alias("_oj_key"),
                             *[F.col(src).alias(f"_oj_{name}") for name, src in keep.items()])
        fact = fact.join(right, fact.l_orderkey == right._oj_key, how)
    if need_orders:
        # order-level attributes are derived on order rows, before the lines join
        orders = read_table(spark, sf_dir, "orders")
        orders = orders.select("o_orderkey", "o_custkey", "o_orderpriority",
                               F.to_date("o_orderdate").alias("_order_date"),
                               F.concat(F.lit("CITY_"), (F.col("o_custkey") % 97).cast("string")).alias("_city"))
        if need_customer or need_nation or need_region:
            geo = _customer_geo(spark, sf_dir, need_customer, need_nation, need_region)
            orders = orders.join(geo, orders.o_custkey == geo.c_custkey)
        fact = fact.join(orders, fact.l_orderkey == orders.o_orderkey)
    if need_part:
        # part-level attributes are derived on part rows (far fewer than lines)
        part = read_table(spark, sf_dir, "part")
        part = part.select(
            "p_partkey", "p_type", "p_brand",
            F.concat(F.lit("BOX_"), (F.col("p_size") % 7).cast("string")).alias("_container"),
            F.concat(F.col("p_name"), F.lit(" "), F.col("p_partkey").cast("string")).alias("_name"),
            (F.col("p_size").cast(MONEY) / F.lit(100)).cast(MONEY).alias("_margin"),
            F.col("p_retailprice").cast(MONEY).alias("_unit_price"))
        fact = fact.join(part, fact.l_partkey == part.p_partkey)

    sales = F.col("l_extendedprice").cast(MONEY)
    unit_price = F.col("_unit_price")
    exprs = {
        **_order_level_exprs(),
        "city": F.col("_city"),
        "order_date": F.col("_order_date"),
        "row_id": F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"),
                              F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string"),
                              sales.cast("string")),
        "ship_mode": F.concat(F.lit("MODE_"), (F.col("l_suppkey") % 4).cast("string")),
        "product_category": F.col("p_type"),
        "product_sub_category": F.col("p_brand"),
        "product_container": F.col("_container"),
        "product_name": F.col("_name"),
        "product_base_margin": F.col("_margin"),
        "country": F.lit(COUNTRY),
        "ship_date": F.to_date(F.col("l_shipdate")),
        "discount": F.col("l_discount").cast(MONEY),
        "unit_price": unit_price,
        "shipping_cost": F.round(sales * F.col("l_tax").cast(MONEY), 2).cast(MONEY),
        "profit": (sales - F.col("l_quantity").cast(MONEY) * unit_price).cast(MONEY),
        "quantity_ordered_new": F.col("l_quantity").cast("int"),
        "sales": sales,
        "order_id": F.col("l_orderkey"),
        "line_number": F.col("l_linenumber"),
    }
    return fact.select(*[exprs[c].alias(c) for c in want], *[F.col(f"_oj_{n}").alias(n) for n in keep])


def _compact_lines(li: DataFrame) -> DataFrame:
    """Lineitem with money as DECIMAL and dates as DATE: the values the order line is made of, in
    a form that a shuffle compresses far better than DOUBLEs and timestamps."""
    return li.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
                     F.col("l_extendedprice").cast(MONEY).alias("_sales"), F.col("l_discount").cast(MONEY).alias("_discount"),
                     F.col("l_tax").cast(MONEY).alias("_tax"), F.to_date("l_shipdate").alias("_ship_date"))


def _lines_part_first(spark: SparkSession, sf_dir: str, columns, order_join) -> DataFrame:
    """``sales_line`` for queries that keep every line: lines meet part, then (shuffled once more,
    on the order key) the order-keyed table and orders."""
    known = SALES_LINE_COLUMNS + EXTRA_COLUMNS
    want = list(SALES_LINE_COLUMNS) if columns is None else [c for c in known if c in set(columns)]
    missing = set(columns or ()) - set(known)
    if missing:
        raise ValueError(f"unknown sales_line columns: {sorted(missing)}")
    wanted = set(want)
    fact = _compact_lines(read_table(spark, sf_dir, "lineitem"))
    if wanted & _NEEDS_PART:
        part = read_table(spark, sf_dir, "part").select("p_partkey", "p_type", "p_brand", "p_size", "p_name",
                                                        F.col("p_retailprice").cast(MONEY).alias("_unit_price"))
        fact = fact.join(part, fact.l_partkey == part.p_partkey).drop("p_partkey")
    keep = {}
    if order_join is not None:
        table, how, keep = order_join
        keep = dict(keep or {})
        right = table.select(F.col("order_id").alias("_oj_key"),
                             *[F.col(src).alias(f"_oj_{name}") for name, src in keep.items()])
        fact = fact.join(right, fact.l_orderkey == right._oj_key, how)
    need_customer, need_nation, need_region = (bool(wanted & needs) for needs in (_NEEDS_CUSTOMER, _NEEDS_NATION, _NEEDS_REGION))
    if wanted & _NEEDS_ORDERS or need_customer or need_nation or need_region:
        orders = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority",
                                                            F.to_date("o_orderdate").alias("_order_date"))
        if need_customer or need_nation or need_region:
            geo = _customer_geo(spark, sf_dir, need_customer, need_nation, need_region)
            orders = orders.join(geo, orders.o_custkey == geo.c_custkey)
        fact = fact.join(orders, fact.l_orderkey == orders.o_orderkey)
    sales, unit_price = F.col("_sales"), F.col("_unit_price")
    exprs = {
        **_order_level_exprs(),
        "order_date": F.col("_order_date"),
        "row_id": F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"),
                              F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string"),
                              sales.cast("string")),
        "ship_mode": F.concat(F.lit("MODE_"), (F.col("l_suppkey") % 4).cast("string")),
        "product_category": F.col("p_type"),
        "product_sub_category": F.col("p_brand"),
        "product_container": F.concat(F.lit("BOX_"), (F.col("p_size") % 7).cast("string")),
        "product_name": F.concat(F.col("p_name"), F.lit(" "), F.col("l_partkey").cast("string")),
        "product_base_margin": (F.col("p_size").cast(MONEY) / F.lit(100)).cast(MONEY),
        "country": F.lit(COUNTRY),
        "ship_date": F.col("_ship_date"),
        "discount": F.col("_discount"),
        "unit_price": unit_price,
        "shipping_cost": F.round(sales * F.col("_tax"), 2).cast(MONEY),
        "profit": (sales - F.col("l_quantity").cast(MONEY) * unit_price).cast(MONEY),
        "quantity_ordered_new": F.col("l_quantity").cast("int"),
        "sales": sales,
        "order_id": F.col("l_orderkey"),
        "line_number": F.col("l_linenumber"),
    }
    return fact.select(*[exprs[c].alias(c) for c in want], *[F.col(f"_oj_{n}").alias(n) for n in keep])


# Lines that one task of ``delivery_lines`` sorts, however many there are in all.
LINES_PER_TASK = 500_000


def _line_tasks(spark: SparkSession, sf_dir: str) -> list[int]:
    """The number of partitions that keeps tasks to ``LINES_PER_TASK``, as repartition's first argument;
    none while the session's own number (which AQE may lower) is enough. The count reads no column."""
    needed = -(-read_table(spark, sf_dir, "lineitem").count() // LINES_PER_TASK)
    return [needed] if needed > int(spark.conf.get("spark.sql.shuffle.partitions")) else []


def delivery_lines(spark: SparkSession, sf_dir: str, by_state: bool = False) -> DataFrame:
    """Order lines with what ``measures.shipping_effectiveness`` reads (and the state), and ``once``:
    true for one line of each order and ship mode (and state), so orders are counted without an
    aggregate per order.

    Lines meet part before orders, by a hash of each partition's parts (a key and a price), without
    a sort. Both sides of the orders join are marked on the order key's own partitions (the first
    line of an order and mode, the first orders row of a key, and state), whose order the join then
    reuses: one sort of the lines, nothing kept per order, at most about ``LINES_PER_TASK`` in a task.
    """
    part = read_table(spark, sf_dir, "part").select("p_partkey", F.col("p_retailprice").cast(MONEY).alias("_unit_price"))
    lines = _compact_lines(read_table(spark, sf_dir, "lineitem"))
    lines = lines.join(part.hint("shuffle_hash"), lines.l_partkey == part.p_partkey).select(
        F.col("l_orderkey").alias("order_id"), (F.col("l_suppkey") % 4).alias("_mode"), F.col("_ship_date").alias("ship_date"),
        F.col("_sales").alias("sales"), F.round(F.col("_sales") * F.col("_tax"), 2).cast(MONEY).alias("shipping_cost"),
        (F.col("_sales") - F.col("l_quantity").cast(MONEY) * F.col("_unit_price")).cast(MONEY).alias("profit"))
    tasks = _line_tasks(spark, sf_dir)
    lines = lines.repartition(*tasks, "order_id").withColumn("_line", F.row_number().over(Window.partitionBy("order_id", "_mode").orderBy("ship_date")))
    state = ["state_province"] if by_state else []
    orders = sales_line_dims(spark, sf_dir, ["order_date", *state])
    orders = orders.repartition(*tasks, "_okey").withColumn("_order", F.row_number().over(Window.partitionBy("_okey", *state).orderBy("order_date")))
    return lines.join(orders, lines.order_id == orders._okey).select(
        *state, F.concat(F.lit("MODE_"), F.col("_mode").cast("string")).alias("ship_mode"), "order_id", "shipping_cost", "profit",
        "sales", "ship_date", "order_date", ((F.col("_line") == 1) & (F.col("_order") == 1)).alias("once"))


def _order_grain(spark: SparkSession, sf_dir: str, columns) -> DataFrame:
    want = [c for c in ORDER_GRAIN_COLUMNS if columns is None or c in set(columns)]
    bad = set(columns or ()) - set(ORDER_GRAIN_COLUMNS)
    if bad:
        raise ValueError(f"not available at order grain: {sorted(bad)}")
    li = read_table(spark, sf_dir, "lineitem")
    sales = F.col("l_extendedprice").cast(MONEY)
    per_order = li.groupBy("l_orderkey").agg(
        F.sum(sales).alias("sales"),
        F.sum(F.col("l_quantity").cast("int")).alias("quantity_ordered_new"),
        F.sum(F.round(sales * F.col("l_tax").cast(MONEY), 2).cast(MONEY)).alias("shipping_cost"),
        F.count(F.lit(1)).alias("lines"))
    order_level = [c for c in want if c not in _ORDER_MEASURES]
    if set(order_level) - {"order_id", "country"}:
        dims = sales_line_dims(spark, sf_dir, order_level)
        per_order = per_order.join(dims, per_order.l_orderkey == dims._okey)
    exprs = {"order_id": F.col("l_orderkey"), "country": F.lit(COUNTRY)}
    return per_order.select(*[(exprs[c] if c in exprs else F.col(c)).alias(c) for c in want])


# Columns available at part grain (one row per part with lines): part attributes
# and the additive line measures summed per part. Profit stays exact: each part
# has one unit price, so the sum of profits is sum(sales) - sum(quantity) * price.
PART_GRAIN_COLUMNS = ("product_category", "product_sub_category", "product_container", "product_name",
                      "product_base_margin", "unit_price", "sales", "quantity_ordered_new", "profit", "lines")


def _part_grain(spark: SparkSession, sf_dir: str, columns) -> DataFrame:
    """Lineitem summed per part (a hash aggregate), then joined to part on the
    aggregate's own part-key partitioning: no sort of every line for a
    sort-merge join, and the part table meets one row per part."""
    want = [c for c in PART_GRAIN_COLUMNS if columns is None or c in set(columns)]
    bad = set(columns or ()) - set(PART_GRAIN_COLUMNS)
    if bad:
        raise ValueError(f"not available at part grain: {sorted(bad)}")
    li = read_table(spark, sf_dir, "lineitem")
    per_part = li.groupBy("l_partkey").agg(
        F.sum(F.col("l_extendedprice").cast(MONEY)).alias("_sales"),
        F.sum(F.col("l_quantity").cast("int")).alias("_qty"), F.count(F.lit(1)).alias("_lines"))
    part = read_table(spark, sf_dir, "part")
    j = per_part.join(part, per_part.l_partkey == part.p_partkey)
    unit_price = F.col("p_retailprice").cast(MONEY)
    exprs = {
        "product_category": F.col("p_type"),
        "product_sub_category": F.col("p_brand"),
        "product_container": F.concat(F.lit("BOX_"), (F.col("p_size") % 7).cast("string")),
        "product_name": F.concat(F.col("p_name"), F.lit(" "), F.col("p_partkey").cast("string")),
        "product_base_margin": (F.col("p_size").cast(MONEY) / F.lit(100)).cast(MONEY),
        "unit_price": unit_price,
        "sales": F.col("_sales"),
        "quantity_ordered_new": F.col("_qty"),
        "profit": F.col("_sales") - F.col("_qty").cast(MONEY) * unit_price,
        "lines": F.col("_lines"),
    }
    return j.select(*[exprs[c].alias(c) for c in want])


def sales_line_dims(spark: SparkSession, sf_dir: str, columns) -> DataFrame:
    """Order-level attributes keyed by ``_okey`` (orders joined to the customer geography)."""
    wanted = set(columns)
    orders = read_table(spark, sf_dir, "orders")
    need_customer = bool(wanted & _NEEDS_CUSTOMER)
    need_nation = bool(wanted & _NEEDS_NATION)
    need_region = bool(wanted & _NEEDS_REGION)
    if need_customer or need_nation or need_region:
        geo = _customer_geo(spark, sf_dir, need_customer, need_nation, need_region)
        orders = orders.join(geo, orders.o_custkey == geo.c_custkey)
    exprs = _order_level_exprs()
    cols = [c for c in exprs if c in wanted]
    return orders.select(F.col("o_orderkey").alias("_okey"), *[exprs[c].alias(c) for c in cols])


def o_return(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Returned orders: one row per order with at least one line flagged 'R'."""
    li = read_table(spark, sf_dir, "lineitem")
    return (li.where(F.col("l_returnflag") == "R")
            .select(F.col("l_orderkey").alias("order_id"))
            .distinct()
            .withColumn("order_status", F.lit("Returned")))


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """region -> manager, one row per region of the driver's region table."""
    region = read_table(spark, sf_dir, "region")
    mapping = F.create_map(*[x for kv in REGION_MANAGERS.items() for x in (F.lit(kv[0]), F.lit(kv[1]))])
    return region.select(F.col("r_name").alias("region"),
                         F.coalesce(mapping[F.col("r_name")], F.concat(F.lit("Manager of "), F.col("r_name")))
                         .alias("manager"))


# --- workforce (HR) binding ------------------------------------------------
# employee := customer. Fixed values of the binding: business-travel labels by
# c_custkey % 4, in this order.
TRAVEL_LABELS = ("Non-Travel", "Travel_Rarely", "Travel_Frequently", "Travel_Rarely")
EXIT_AFTER_DAYS = 180


def employees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per employee (a customer with orders).

    employee_id, department, job_role, ethnicity, gender, age, salary (decimal),
    overtime, business_travel, hire_date (first order), exit_date (last order
    when it is more than 180 days before the data's last order date), attrition.
    The data's last date is an uncorrelated scalar subquery, not a join.
    """
    orders = read_table(spark, sf_dir, "orders")
    per = orders.groupBy("o_custkey").agg(F.min(F.to_date("o_orderdate")).alias("hire_date"),
                                          F.max(F.to_date("o_orderdate")).alias("_last"))
    data_end = orders.agg(F.max(F.to_date("o_orderdate"))).scalar()
    nation = read_table(spark, sf_dir, "nation")
    region = read_table(spark, sf_dir, "region")
    cust = (read_table(spark, sf_dir, "customer")
            .join(nation, F.col("c_nationkey") == nation.n_nationkey)
            .join(region, F.col("n_regionkey") == region.r_regionkey)
            .select("c_custkey", "c_mktsegment", "c_acctbal", F.col("r_name").alias("region")))
    emp = cust.join(per, F.col("c_custkey") == F.col("o_custkey"))
    key = F.col("c_custkey")
    exit_date = F.when(F.col("_last") < F.date_sub(data_end, EXIT_AFTER_DAYS), F.col("_last"))
    travel = F.element_at(F.array(*[F.lit(t) for t in TRAVEL_LABELS]), (key % 4 + 1).cast("int"))
    return emp.select(
        key.alias("employee_id"),
        F.col("c_mktsegment").alias("department"),
        F.concat(F.lit("ROLE_"), (key % 12).cast("string")).alias("job_role"),
        F.col("region").alias("ethnicity"),
        F.when(key % 2 == 0, "F").otherwise("M").alias("gender"),
        (F.lit(18) + key % 45).cast("int").alias("age"),
        F.col("c_acctbal").cast(MONEY).alias("salary"),
        F.when(key % 3 == 0, "Yes").otherwise("No").alias("overtime"),
        travel.alias("business_travel"),
        "hire_date",
        exit_date.alias("exit_date"),
        F.when(exit_date.isNotNull(), "Yes").otherwise("No").alias("attrition"),
    )


# --- make-versus-buy binding ------------------------------------------------
# item := part. Fixed values of the binding (parameters of the cost model):
MAKE_SHARES = {"raw_material": "0.50", "labour": "0.30", "energy": "0.10"}
MAKE_NRE = 2000
SUPPLIER_NRE_STEP = 1000          # supplier NRE = step * (suppkey % 3)
CAPACITY_UNITS = 600              # units the existing line can make
MACHINE_CAPACITY = 600            # units one extra machine adds
MACHINE_COST = 5000


def supplier_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """item, supplier, unit_price (quantity-weighted average price, half-up 2 dp), nre, and the
    item's volume: one aggregate of lineitem per (part, supplier), summed per part over its
    suppliers, so whatever needs prices and volumes reads lineitem once."""
    li = read_table(spark, sf_dir, "lineitem")
    totals = li.groupBy(F.col("l_partkey").alias("item"), F.col("l_suppkey").alias("suppkey")).agg(
        F.sum(F.col("l_extendedprice").cast(MONEY)).alias("_v"),
        F.sum(F.col("l_quantity").cast("bigint")).alias("_q"))
    price = F.round(F.try_divide(F.col("_v").cast("decimal(20,2)"), F.col("_q").cast("decimal(20,2)")), 2)
    return totals.select("item", F.concat(F.lit("SUPPLIER_"), F.col("suppkey").cast("string")).alias("supplier"),
                         price.cast(MONEY).alias("unit_price"),
                         (F.lit(SUPPLIER_NRE_STEP) * (F.col("suppkey") % 3)).cast(MONEY).alias("nre"),
                         F.sum("_q").over(Window.partitionBy("item")).alias("volume"))


def item_demand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """item, volume = total ordered quantity per part."""
    li = read_table(spark, sf_dir, "lineitem")
    return li.groupBy(F.col("l_partkey").alias("item")).agg(F.sum(F.col("l_quantity").cast("bigint")).alias("volume"))


def make_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """item, component, unit_cost: fixed shares of the part's retail price (half-up 2 dp)."""
    part = read_table(spark, sf_dir, "part")
    price = F.col("p_retailprice").cast(MONEY)
    parts = [F.struct(F.lit(name).alias("component"),
                      F.round(price * F.lit(share).cast("decimal(3,2)"), 2).cast(MONEY).alias("unit_cost"))
             for name, share in MAKE_SHARES.items()]
    return (part.select(F.col("p_partkey").alias("item"), F.explode(F.array(*parts)).alias("c"))
            .select("item", "c.component", "c.unit_cost"))


def register_analytic_views(spark: SparkSession, sf_dir: str, prefix: str = "") -> None:
    """Register the bound shapes as temp views under the reference's table names
    (``orders`` = order lines, ``o_return``, ``users``) so analyses can also be
    written in Spark SQL. The views are lazy plans over the Parquet tables;
    Catalyst prunes the columns and joins each statement does not use only as
    far as the plan allows (the DataFrame binding prunes whole joins)."""
    sales_line(spark, sf_dir).createOrReplaceTempView(f"{prefix}orders")
    o_return(spark, sf_dir).createOrReplaceTempView(f"{prefix}o_return")
    users(spark, sf_dir).createOrReplaceTempView(f"{prefix}users")
