"""Make-versus-buy cost model.

Inputs (sources/binding.py): demand per item (volume), supplier quotes per
item (unit_price, nre), make-side cost components per item (unit_cost per
component). All money is exact DECIMAL; the few joins are item-keyed equi
joins between per-item aggregates (no fan-out beyond quotes per item).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillroll.session import ensure_checkpoint_dir

from tillroll.functions.columns import MONEY, pct


def _d(c):
    return (F.col(c) if isinstance(c, str) else c).cast("double")


def unit_cost(components: DataFrame, quotes: DataFrame) -> DataFrame:
    """item, source ('MAKE' or the supplier), unit_cost (exact decimal)."""
    make = components.groupBy("item").agg(F.sum("unit_cost").alias("unit_cost")).select(
        "item", F.lit("MAKE").alias("source"), "unit_cost")
    return make.unionByName(quotes.select("item", F.col("supplier").alias("source"), F.col("unit_price").alias("unit_cost")))


def sourced(components: DataFrame, quotes: DataFrame, make_nre) -> DataFrame:
    """item, source, volume, unit_cost, nre: the suppliers of an item and, beside its first
    supplier by name, making it. ``quotes`` carries the item's volume; it is read once."""
    make = components.groupBy("item").agg(F.sum("unit_cost").alias("_mu"))
    first = F.row_number().over(Window.partitionBy("item").orderBy("supplier")) == 1
    price = F.col("unit_price").cast("decimal(28,2)")
    buy = F.struct(F.col("supplier").alias("source"), price.alias("unit_cost"), F.col("nre"))
    own = F.struct(F.lit("MAKE").alias("source"), F.col("_mu").cast("decimal(28,2)").alias("unit_cost"),
                   F.lit(make_nre).cast(MONEY).alias("nre"))
    rows = quotes.withColumn("_first", first).join(make, "item", "left")
    sources = F.when(F.col("_first") & F.col("_mu").isNotNull(), F.array(buy, own)).otherwise(F.array(buy))
    return rows.select("item", "volume", F.explode(sources).alias("s")).select(
        "item", "s.source", "volume", "s.unit_cost", "s.nre")


def extended_cost(rows: DataFrame) -> DataFrame:
    """``sourced`` rows with extended_cost = unit_cost x volume."""
    return rows.select("item", "source", "volume", "unit_cost",
                       (F.col("unit_cost") * F.col("volume")).alias("extended_cost"))


def full_cost(rows: DataFrame) -> DataFrame:
    """``sourced`` rows with their extended cost, full_cost = extended + NRE and
    full_unit_cost = full_cost / volume (half-up 2 dp)."""
    extended = F.col("unit_cost") * F.col("volume")
    nre = F.coalesce("nre", F.lit(0).cast(MONEY))
    full = extended + nre
    unit = F.round(F.try_divide(full.cast("decimal(24,2)"), F.col("volume").cast("decimal(20,0)")), 2)
    return rows.select("item", "source", "volume", "unit_cost", extended.alias("extended_cost"), nre.alias("nre"),
                       full.alias("full_cost"), unit.alias("full_unit_cost"))


def incremental_capacity(demand: DataFrame, capacity: int, machine_capacity: int, machine_cost, keep=()) -> DataFrame:
    """Extra machines needed when volume exceeds capacity, and their cost (only
    the decision-relevant, incremental cost)."""
    short = F.greatest(F.col("volume") - F.lit(capacity), F.lit(0))
    machines = F.ceil(short / F.lit(machine_capacity)).cast("bigint")
    return demand.select("item", "volume", short.cast("bigint").alias("units_short"), machines.alias("machines"),
                         (machines * F.lit(machine_cost)).cast(MONEY).alias("incremental_cost"), *keep)


def make_cost_breakdown(components: DataFrame) -> DataFrame:
    """item, component, unit_cost, share % of the item's make unit cost."""
    total = F.sum("unit_cost").over(Window.partitionBy("item"))
    return components.select("item", "component", _d("unit_cost").alias("unit_cost"),
                             pct("unit_cost", total).alias("share"))


def make_vs_buy(components: DataFrame, quotes: DataFrame, make_nre, capacity: int,
                machine_capacity: int, machine_cost) -> DataFrame:
    """Compare the full cost of making (unit x volume + NRE + incremental
    equipment) with the cheapest supplier's full cost (unit x volume + NRE).

    item, volume, make_full, best_supplier, buy_full, decision ('MAKE'/'BUY'),
    saving (cost avoided by the decision). ``quotes`` carries the item's volume.
    """
    buy_full = F.col("unit_price") * F.col("volume") + F.col("nre")
    best = (quotes.groupBy("item", "volume").agg(F.min(F.struct(buy_full.alias("f"), F.col("supplier").alias("s"))).alias("_b"))
            .select("item", "volume", F.col("_b.s").alias("best_supplier"), F.col("_b.f").alias("buy_full")))
    make_unit = components.groupBy("item").agg(F.sum("unit_cost").alias("_mu"))
    cap = incremental_capacity(best.select("item", "volume", "best_supplier", "buy_full"), capacity, machine_capacity, machine_cost,
                               keep=["best_supplier", "buy_full"])
    j = make_unit.join(cap, "item").withColumn(
        "make_full", F.col("_mu") * F.col("volume") + F.lit(make_nre).cast(MONEY) + F.col("incremental_cost"))
    decision = F.when(F.col("buy_full").isNull() | (F.col("make_full") <= F.col("buy_full")), "MAKE").otherwise("BUY")
    saving = F.abs(F.col("make_full") - F.col("buy_full"))
    return j.select("item", "volume", _d("make_full").alias("make_full"), "best_supplier",
                    _d("buy_full").alias("buy_full"), decision.alias("decision"), _d(saving).alias("saving"))


# --- one capacity shared by all items -------------------------------------------

_DIGIT = 1 << 16


def capacity_cut(items: DataFrame, capacity: int) -> tuple[int, int, int] | None:
    """(saving, item, units) of the item at which ``capacity`` ends when items are taken by saving per unit,
    largest first, then by item; None when all fit.

    Found by weighted counted digits: volumes are summed by 16 bits of the saving, then of the
    item, from the top; each time the digit where the running total passes the capacity is
    followed. A step sums few numbers (65,536 at most) whatever the number of items, and
    no item is sorted. ``items`` (item, volume, cents: whole, positive) should be settled,
    since each step reads it.
    """
    left, here, following = capacity, items, []
    for name, down in (("cents", True), ("item", False)):
        for shift in (48, 32, 16, 0):
            digit = F.shiftrightunsigned(F.col(name), shift).bitwiseAND(_DIGIT - 1)
            rank = -digit if down else digit
            sums = here.groupBy(rank.alias("rank")).agg(F.sum("volume").alias("v"))
            upto = F.sum("v").over(Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))
            passed = (sums.withColumn("upto", upto).where(F.col("upto") > left)
                      .agg(F.min(F.struct("rank", (F.col("upto") - F.col("v")).alias("before"))).alias("m")).first()["m"])
            if passed is None:
                return None                                  # only at the first step: everything fits
            left -= passed["before"]
            here = here.where(rank == passed["rank"])
            following.append(abs(passed["rank"]))
    saving, item = (sum(d << s for d, s in zip(part, (48, 32, 16, 0))) for part in (following[:4], following[4:]))
    return saving, item, int(left)


def shared_capacity(components: DataFrame, quotes: DataFrame, capacity: int) -> DataFrame:
    """How many units of each item to make when all items share ``capacity`` units.

    An item is worth making by what a unit saves: its lowest quoted price less its make cost.
    Capacity goes to the largest savings first; the item at which it ends is split, and what is
    left over, or saves nothing, is bought. One-off costs are left out (``make_vs_buy`` has them).
    """
    make = components.groupBy("item").agg(F.sum("unit_cost").alias("make_unit"))
    buy = quotes.groupBy("item").agg(F.min("unit_price").alias("buy_unit"), F.max("volume").alias("volume"))
    items = make.join(buy, "item").withColumn("cents", ((F.col("buy_unit") - F.col("make_unit")) * 100).cast("long"))
    ensure_checkpoint_dir(items.sparkSession)
    items = items.checkpoint(eager=True)
    worth = (F.col("cents") > 0) & (F.col("volume") > 0)
    cut = capacity_cut(items.where(worth).select("item", "volume", "cents"), capacity)
    made = F.col("volume")
    if cut is not None:
        saving, item, units = cut
        first = (F.col("cents") > saving) | ((F.col("cents") == saving) & (F.col("item") < item))
        made = F.when(first, F.col("volume")).when((F.col("cents") == saving) & (F.col("item") == item), F.lit(units)).otherwise(0)
    units = F.when(worth, made).otherwise(0).cast("long")
    return items.select("item", "volume", _d("make_unit").alias("make_unit"), _d("buy_unit").alias("buy_unit"), units.alias("make_units"),
                        (F.col("volume") - units).alias("buy_units"), ((units * F.col("cents")).cast("double") / 100).alias("saving"))
