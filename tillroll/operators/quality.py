"""Exploratory data analysis and data quality.

Every profile is one pass over the data: many conditional counts in a single
aggregate, then ``stack`` turns the one wide row into one row per column or
rule. Quantiles are exact and distributed (operators/quantile.py); statistics
that would otherwise depend on float summation order use exact moments
(functions/stats.py).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillroll.functions.columns import pct
from tillroll.functions.stats import corr_from_moments, moments_from_limbs, pair_moments
from tillroll.operators.join import attach_group_stats
from tillroll.operators.quantile import (grouped_quantiles, grouped_quantiles_approx,
                                        grouped_quantiles_by_histogram)


def _quantiles(approx: bool):
    return grouped_quantiles_approx if approx else grouped_quantiles


def _d(c):
    return (F.col(c) if isinstance(c, str) else c).cast("double")


def _stack(row: DataFrame, labels: list[str], value_cols: list[list[str]], names: list[str]) -> DataFrame:
    """Unpivot one wide row: for label i, the columns value_cols[i] become ``names``."""
    n = len(names)
    parts = []
    for label, cols in zip(labels, value_cols):
        parts.append(f"'{label}'")
        parts.extend(f"`{c}`" for c in cols)
    expr = f"stack({len(labels)}, {', '.join(parts)}) as ({', '.join(['_label'] + names[:n])})"
    return row.selectExpr(expr)


def null_profile(df: DataFrame) -> DataFrame:
    """column, nulls, pct (of rows) for every column, in one aggregate."""
    cols = df.columns
    row = df.agg(F.count(F.lit(1)).alias("_rows"),
                 *[F.count_if(F.col(c).isNull()).alias(f"_n{i}") for i, c in enumerate(cols)])
    stacked = _stack(row, cols, [[f"_n{i}", "_rows"] for i in range(len(cols))], ["nulls", "rows"])
    return stacked.select(F.col("_label").alias("column"), "nulls", pct("nulls", "rows").alias("pct"))


def _attach(df: DataFrame, stats: DataFrame, by: list[str], cols: list[str], row_key: list[str] | None) -> DataFrame:
    """Attach per-group statistics (hot groups salted, see ``attach_group_stats``);
    without groups they are scalar subqueries. ``row_key``: columns unique per row,
    all columns when not given."""
    if by:
        return attach_group_stats(df, stats, by, cols, row_key or df.columns, n_col="n", how="left")
    return df.withColumns({c: stats.select(c).scalar() for c in cols})


def impute_median(df: DataFrame, cols: list[str], by: list[str] | None = None,
                  bounded_domain: bool = False, approx: bool = False,
                  row_key: list[str] | None = None) -> DataFrame:
    """Replace NULLs of ``cols`` by the group's exact (discrete) median.
    ``bounded_domain`` selects the histogram method (whole days, ages, ...);
    ``approx`` a sketch median."""
    by = list(by or [])
    out = df
    quantiles = grouped_quantiles_by_histogram if bounded_domain else _quantiles(approx)
    for c in cols:
        med = quantiles(df, by, c, {f"_med_{c}": 0.5})
        out = _attach(out, med, by, [f"_med_{c}"], row_key)
        out = out.withColumn(c, F.coalesce(F.col(c), F.col(f"_med_{c}"))).drop(f"_med_{c}")
    return out


def iqr_outliers(df: DataFrame, column: str, by: list[str] | None = None, k: float = 1.5,
                 approx: bool = False, row_key: list[str] | None = None) -> DataFrame:
    """Rows with the fences q1 - k*IQR and q3 + k*IQR of their group (exact
    discrete quartiles, or sketch quartiles with ``approx``) and ``is_outlier``."""
    by = list(by or [])
    q = _quantiles(approx)(df, by, column, {"_q1": 0.25, "_q3": 0.75})
    kk = F.lit(str(k)).cast("decimal(10,4)")
    fences = q.select(*by, "n", (F.col("_q1") - kk * (F.col("_q3") - F.col("_q1"))).alias("lo"),
                      (F.col("_q3") + kk * (F.col("_q3") - F.col("_q1"))).alias("hi"))
    j = _attach(df, fences, by, ["lo", "hi"], row_key)
    return j.withColumn("is_outlier", (F.col(column) < F.col("lo")) | (F.col(column) > F.col("hi")))


def winsorize(df: DataFrame, column: str, p_lo: float = 0.05, p_hi: float = 0.95,
              by: list[str] | None = None, name: str | None = None, approx: bool = False,
              row_key: list[str] | None = None) -> DataFrame:
    """Clip ``column`` to its group's exact discrete p_lo / p_hi quantiles
    (sketch quantiles with ``approx``)."""
    by = list(by or [])
    q = _quantiles(approx)(df, by, column, {"_lo": p_lo, "_hi": p_hi})
    j = _attach(df, q, by, ["_lo", "_hi"], row_key)
    clipped = F.least(F.greatest(F.col(column), F.col("_lo")), F.col("_hi"))
    return j.withColumn(name or column, clipped).drop("_lo", "_hi")


def box_stats(df: DataFrame, column: str, by: list[str], approx: bool = False) -> DataFrame:
    """group, n, min, q1, median, q3, max (exact discrete quartiles; sketch
    quartiles with ``approx``)."""
    q = _quantiles(approx)(df, by, column, {"q1": 0.25, "median": 0.5, "q3": 0.75})
    return q.select(*by, "n", "min", "q1", "median", "q3", "max")


def category_frequency(df: DataFrame, column: str) -> DataFrame:
    """value, count, pct of rows (NULL counted as its own value)."""
    n = F.sum("lines") if "lines" in df.columns else F.count(F.lit(1))
    a = df.groupBy(F.col(column).alias("value")).agg(n.alias("count"))
    total = F.sum("count").over(Window.partitionBy())          # one row per value
    return a.select("value", "count", pct("count", total).alias("pct"))


def correlation_matrix(df: DataFrame, cols: list[str], scale: int = 2) -> DataFrame:
    """col_a, col_b, n, corr for every pair: all moments in one aggregate, and the
    one result row unpivoted with ``stack`` (a UNION of per-pair selects would let
    column pruning split it into one aggregate -- one scan -- per pair)."""
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i + 1:]]
    aggs = [m for i, (a, b) in enumerate(pairs) for m in pair_moments(a, b, f"p{i}", scale, scale)]
    row = df.agg(*aggs).select(*[c for i in range(len(pairs)) for c in moments_from_limbs(f"p{i}")])
    row = row.select(*[c for i in range(len(pairs)) for c in (
        F.col(f"p{i}_n").cast("bigint").alias(f"n{i}"), corr_from_moments(f"p{i}").alias(f"c{i}"))])
    return _stack(row, [f"{a}|{b}" for a, b in pairs], [[f"n{i}", f"c{i}"] for i in range(len(pairs))],
                  ["n", "corr"]).select(F.split("_label", r"\|")[0].alias("col_a"),
                                        F.split("_label", r"\|")[1].alias("col_b"), "n", "corr")


def binned_pairs(df: DataFrame, x: str, y: str, x_width: float, y_width: float) -> DataFrame:
    """2-D histogram: x_bin = floor(x / w_x), y_bin = floor(y / w_y), n."""
    xb = F.floor(F.col(x) / F.lit(x_width)).cast("bigint")
    yb = F.floor(F.col(y) / F.lit(y_width)).cast("bigint")
    return df.groupBy(xb.alias("x_bin"), yb.alias("y_bin")).agg(F.count(F.lit(1)).alias("n"))


def deduplicate(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Keep one row per ``keys``: the first in ``order`` (ties broken by the other
    columns). ``min`` of a struct is a partial aggregate, so a key holding a
    third of all rows is reduced map-side instead of sorted in one task."""
    rest = [c for c in df.columns if c not in keys and c not in order]
    packed = F.min(F.struct(*[F.col(c) for c in order + rest])).alias("_row")
    return df.groupBy(*keys).agg(packed).select(*keys, *[F.col(f"_row.{c}").alias(c) for c in order + rest])


def duplicate_summary(df: DataFrame, keys: list[str]) -> DataFrame:
    """rows, distinct keys, duplicate rows (rows beyond the first per key),
    keys having duplicates."""
    per = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_c"))
    return per.agg(F.sum("_c").alias("rows"), F.count(F.lit(1)).alias("distinct_keys"),
                   F.sum(F.col("_c") - 1).alias("duplicate_rows"),
                   F.count_if(F.col("_c") > 1).alias("duplicated_keys"))


def validate(checks: dict[str, DataFrame]) -> DataFrame:
    """rule, violations: each check is a one-row DataFrame with a ``violations`` column
    (``row_rules`` returns one such DataFrame holding many rules)."""
    parts = []
    for rule, d in checks.items():
        if "rule" in d.columns:
            parts.append(d.select("rule", F.col("violations").cast("bigint").alias("violations")))
        else:
            parts.append(d.select(F.lit(rule).alias("rule"), F.col("violations").cast("bigint").alias("violations")))
    return reduce(DataFrame.unionAll, parts)


def row_rules(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Row-level rules (True = violation) counted in one aggregate and unpivoted:
    rule, violations (one scan for all rules)."""
    row = df.agg(*[F.count_if(cond).alias(f"_r{i}") for i, cond in enumerate(rules.values())])
    return _stack(row, list(rules), [[f"_r{i}"] for i in range(len(rules))], ["violations"]) \
        .withColumnRenamed("_label", "rule")


def unique_rule(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows beyond the first per key (primary-key / UNIQUE violations)."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_c")).agg(
        F.coalesce(F.sum(F.col("_c") - 1), F.lit(0)).alias("violations"))


def foreign_key_rule(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """Child rows whose key has no parent row (anti join)."""
    missing = child.join(parent.select(F.col(parent_key).alias(child_key)), child_key, "left_anti")
    return missing.agg(F.count(F.lit(1)).alias("violations"))


def normalize(df: DataFrame, numeric: list[str], text: list[str] | None = None, method: str = "minmax",
              suffix: str = "_norm") -> DataFrame:
    """Trim/upper-case ``text`` columns; rescale ``numeric`` columns.

    ``minmax``: (x - min) / (max - min) in DOUBLE from the exact decimals.
    ``zscore``: (x - mean) / stddev_samp. The min/max/mean/stddev are one-row
    aggregates attached as scalar subqueries (no join, no window over all rows).
    """
    out = df
    for c in text or []:
        out = out.withColumn(c + suffix, F.upper(F.trim(F.col(c))))
    if method == "minmax":
        # one aggregate (one scan) for every bound, attached as one scalar subquery
        bounds = df.agg(F.struct(*[x for c in numeric for x in (F.min(c).alias(f"lo_{c}"),
                                                                F.max(c).alias(f"hi_{c}"))]).alias("b"))
        b = bounds.scalar()
        for c in numeric:
            lo, hi = b[f"lo_{c}"], b[f"hi_{c}"]
            span = (hi - lo).cast("double")
            out = out.withColumn(c + suffix, F.try_divide((F.col(c) - lo).cast("double"), F.when(span != 0, span)))
    elif method == "zscore":
        stats = df.agg(F.struct(*[x for c in numeric for x in (
            F.avg(F.col(c).cast("double")).alias(f"mu_{c}"),
            F.stddev_samp(F.col(c).cast("double")).alias(f"sd_{c}"))]).alias("b"))
        b = stats.scalar()
        for c in numeric:
            out = out.withColumn(c + suffix, (F.col(c).cast("double") - b[f"mu_{c}"]) / b[f"sd_{c}"])
    else:
        raise ValueError(method)
    return out

