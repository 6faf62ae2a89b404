"""Exact positions and quantiles by counting values, not by sorting rows.

Spark's exact ``percentile``/``median`` aggregates merge a group's values in one
task. Here rows are first counted per (group, value): a partial aggregate, so
neither a hot group nor a value that a third of all rows share costs more than
one row per map task. The value at a position is then found digit by digit:
a value is a 64-bit whole number (cents, days, units) of three digits, the last
two of 16 bits; the counts per first digit tell which one holds the position,
then the counts per second digit inside it, then per third. Every window runs
over one digit's values, at most 65,536 rows (the first digit's range is that of
the data: one per 4 * 10**9 units), however many rows there are.

The plan is lazy and needs no checkpoint: each level reads the same counted
values (one exchange, reused), and the positions found so far meet them in an
equi-join whose small side Spark measures before it broadcasts it.
"""

from __future__ import annotations

from decimal import Decimal
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

DIGITS = ["_d1", "_d2", "_d3"]


def null_safe_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on equal keys, NULL matching NULL; the keys come out once, from the left."""
    r = right.select(*[F.col(k).alias(f"_r_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    cond = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys])
    return left.join(r, cond, how).drop(*[f"_r_{k}" for k in keys])


def whole_number(df: DataFrame, name: str) -> tuple[Column, callable]:
    """(column as a 64-bit whole number in the same order, function back to the type)."""
    kind = df.schema[name].dataType
    if isinstance(kind, T.DecimalType) and kind.precision <= 18:
        unit = Decimal(1).scaleb(-kind.scale)
        return ((F.col(name) * F.lit(10 ** kind.scale)).cast("long"),
                lambda v: (v.cast("decimal(19,0)") * F.lit(unit)).cast(kind))
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return F.col(name).cast("long"), lambda v: v.cast(kind)
    if isinstance(kind, T.DateType):
        return F.unix_date(name).cast("long"), lambda v: F.date_from_unix_date(v.cast("int"))
    raise TypeError(f"exact positions need whole, decimal or date values, not {kind.simpleString()}")


def counted(df: DataFrame, group_cols: list[str], value_col: str) -> DataFrame:
    """One row per group and non-NULL value: its digits, the value ``_v`` and its count ``_c``."""
    whole, _ = whole_number(df, value_col)
    hist = (df.where(F.col(value_col).isNotNull()).groupBy(*group_cols, whole.alias("_v"))
            .agg(F.count(F.lit(1)).alias("_c")))
    return hist.select("*", F.shiftright("_v", 32).alias("_d1"),
                       F.shiftright("_v", 16).bitwiseAND(F.lit(65535)).alias("_d2"),
                       F.col("_v").bitwiseAND(F.lit(65535)).alias("_d3"))


def at_positions(hist: DataFrame, keys: list[str], wanted: DataFrame) -> DataFrame:
    """``wanted`` (keys, any columns, ``_want``: a 1-based position in the group) with ``_v``, the value there.

    Positions outside the group give no row.
    """
    carried = [c for c in wanted.columns if c not in keys and c != "_want"]
    t = wanted
    for i, digit in enumerate(DIGITS):
        fixed = DIGITS[:i]
        rows = hist if i else hist.groupBy(*keys, digit).agg(F.sum("_c").alias("_c"))
        met = null_safe_join(rows.select(*keys, *fixed, digit, "_c"), t, keys + fixed)
        cell = keys + carried + ["_want"] + fixed
        sums = met.groupBy(*cell, digit).agg(F.sum("_c").alias("_s"))
        upto = F.sum("_s").over(Window.partitionBy(*cell).orderBy(digit))
        t = (sums.withColumn("_upto", upto).where((F.col("_upto") >= F.col("_want")) & (F.col("_upto") - F.col("_s") < F.col("_want")))
             .withColumn("_want", F.col("_want") - F.col("_upto") + F.col("_s")).select(*cell, digit))
    value = F.shiftleft("_d1", 32).bitwiseOR(F.shiftleft("_d2", 16)).bitwiseOR(F.col("_d3"))
    return t.select(*keys, *carried, value.alias("_v"))


def rows_before(hist: DataFrame) -> DataFrame:
    """``hist`` of the whole table with ``_before``, the number of rows of smaller values."""
    def running(df, part, by):
        w = Window.partitionBy(*part).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
        return F.coalesce(F.sum("_c").over(w), F.lit(0))

    first = hist.groupBy("_d1").agg(F.sum("_c").alias("_c"))
    first = first.select(F.col("_d1").alias("_f1"), running(first, [], "_d1").alias("_b1"))
    second = hist.groupBy("_d1", "_d2").agg(F.sum("_c").alias("_c"))
    second = second.select(F.col("_d1").alias("_s1"), F.col("_d2").alias("_s2"), running(second, ["_d1"], "_d2").alias("_b2"))
    return (hist.withColumn("_b3", running(hist, ["_d1", "_d2"], "_d3"))
            .join(second, (F.col("_d1") == F.col("_s1")) & (F.col("_d2") == F.col("_s2")))
            .join(first, F.col("_d1") == F.col("_f1"))
            .select("_v", "_c", (F.col("_b1") + F.col("_b2") + F.col("_b3")).alias("_before")))


def grouped_quantiles(df: DataFrame, group_cols: list[str], value_col: str, probs: dict) -> DataFrame:
    """Exact discrete quantiles (PERCENTILE_DISC: the value at position
    ceil(p * n), at least 1) of ``value_col`` per group; NULL values are ignored.

    ``probs`` maps output column name -> probability. Also returns ``n``,
    ``min`` and ``max`` per group.
    """
    _, back = whole_number(df, value_col)
    keys = list(group_cols) or ["_all"]
    rows = df if group_cols else df.withColumn("_all", F.lit(0))
    hist = counted(rows, keys, value_col)
    totals = hist.groupBy(*keys).agg(F.sum("_c").alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    wants = [F.struct(F.lit(name).alias("_name"), F.greatest(F.ceil(F.col("_n") * F.lit(Decimal(str(p)))), F.lit(1))
                      .cast("long").alias("_want")) for name, p in probs.items()]
    wanted = totals.select(*keys, "_n", "_lo", "_hi", F.explode(F.array(*wants)).alias("_t")).select(
        *keys, "_n", "_lo", "_hi", "_t._name", "_t._want")
    found = at_positions(hist, keys, wanted)
    aggs = [F.max("_n").alias("n"), back(F.max("_lo")).alias("min"), back(F.max("_hi")).alias("max")]
    aggs += [back(F.max(F.when(F.col("_name") == name, F.col("_v")))).alias(name) for name in probs]
    return found.groupBy(*group_cols).agg(*aggs) if group_cols else found.agg(*aggs)


def grouped_quantiles_by_histogram(df: DataFrame, group_cols: list[str], value_col: str,
                                   probs: dict) -> DataFrame:
    """The same exact discrete quantiles for values from a bounded domain
    (whole days, ages, small integers).

    Rows are counted per (group, value) -- a partial aggregate, so a hot group
    is combined map-side -- and the cumulative count runs over each group's
    *distinct values*: the window partition holds at most one row per possible
    value, however many rows the group has. Use ``grouped_quantiles`` when the
    values are not from a bounded domain.
    """
    hist = (df.where(F.col(value_col).isNotNull())
            .groupBy(*group_cols, value_col).agg(F.count(F.lit(1)).alias("_c")))
    w_group = Window.partitionBy(*group_cols)
    upto = w_group.orderBy(value_col).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cum = hist.select(*group_cols, value_col, "_c", F.sum("_c").over(upto).alias("_cum"),
                      F.sum("_c").over(w_group).alias("_n"))
    aggs = [F.max("_n").alias("n"), F.min(value_col).alias("min"), F.max(value_col).alias("max")]
    for name, p in probs.items():
        target = F.greatest(F.ceil(F.col("_n") * F.lit(Decimal(str(p)))), F.lit(1))
        # the value whose cumulative count first reaches the target position
        hit = (F.col("_cum") >= target) & (F.col("_cum") - F.col("_c") < target)
        aggs.append(F.max(F.when(hit, F.col(value_col))).alias(name))
    return cum.groupBy(*group_cols).agg(*aggs) if group_cols else cum.agg(*aggs)


def grouped_quantiles_approx(df: DataFrame, group_cols: list[str], value_col: str, probs: dict,
                             accuracy: int = 10000) -> DataFrame:
    """Approximate quantiles per group from mergeable sketches
    (``percentile_approx``: rank error about n / accuracy); same output columns
    as ``grouped_quantiles``. For inputs where an exact answer is not needed."""
    names = list(probs)
    sketch = F.percentile_approx(value_col, [float(probs[n]) for n in names], accuracy)
    vals = df.where(F.col(value_col).isNotNull())
    aggs = [F.count(F.lit(1)).alias("n"), F.min(value_col).alias("min"), F.max(value_col).alias("max"),
            sketch.alias("_q")]
    out = vals.groupBy(*group_cols).agg(*aggs) if group_cols else vals.agg(*aggs)
    return out.select(*group_cols, "n", "min", "max", *[F.col("_q")[i].alias(n) for i, n in enumerate(names)])
