"""String-based filters and relabels on the order-line table.

All are row-local projections/filters (no shuffle) on built-in string
functions, so they stay in whole-stage codegen and the equality filters reach
the Parquet scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillroll.functions.columns import decimals_to_double, month_of_year


def refined_order_priority(sl: DataFrame, old: str = "Not Specified", new: str = "Completed") -> DataFrame:
    """All columns plus ``refined``: the priority with ``old`` replaced by ``new``
    (case-sensitive, like REPLACE)."""
    return decimals_to_double(sl.withColumn("refined", F.replace("order_priority", F.lit(old), F.lit(new))))


def long_subcategory_names(sl: DataFrame, min_len: int = 15) -> DataFrame:
    """Distinct sub-categories longer than ``min_len`` characters."""
    return (sl.select("product_sub_category", F.length("product_sub_category").alias("char_len"))
            .where(F.col("char_len") > min_len).distinct()
            .orderBy(F.desc("char_len")))


def relabel(df: DataFrame, column: str, rules) -> DataFrame:
    """Apply relabel rules in sequence, each seeing the previous one's output.

    A rule is ``(kind, match, old, new)``: ``kind='contains'`` fires when the
    value contains ``match`` case-insensitively (MySQL LIKE '%x%'),
    ``kind='equals'`` on an exact match; the replacement itself is
    case-sensitive (MySQL REPLACE).
    """
    c = F.col(column)
    for kind, match, old, new in rules:
        if kind == "contains":
            cond = F.lower(c).contains(match.lower())
        elif kind == "equals":
            cond = c == F.lit(match)
        elif kind == "word":
            cond = c.rlike(match)
        else:
            raise ValueError(kind)
        if kind == "word":
            c = F.when(cond, F.regexp_replace(c, match, new)).otherwise(c)
        else:
            c = F.when(cond, F.replace(c, F.lit(old), F.lit(new))).otherwise(c)
    return df.withColumn(column, c)


# The two relabels of the reference, in their order.
SUBCATEGORY_RULES = (
    ("contains", "and", "and", " & "),
    ("equals", "Binders and Binder Accessories", "Binders and Binder Accessories", "Binders and Accessories"),
)
SUBCATEGORY_RULES_WHOLE_WORD = (
    ("word", r"\band\b", None, "&"),
    ("equals", "Binders and Binder Accessories", "Binders and Binder Accessories", "Binders and Accessories"),
)


def relabel_subcategory(sl: DataFrame, whole_word: bool = False) -> DataFrame:
    """All columns with the sub-category relabelled ('and' -> ' & ', then one exact
    name). ``whole_word`` replaces only the word 'and'."""
    rules = SUBCATEGORY_RULES_WHOLE_WORD if whole_word else SUBCATEGORY_RULES
    return decimals_to_double(relabel(sl, "product_sub_category", rules))


def product_name_regex(sl: DataFrame, pattern: str = "[0-9]{3,}$") -> DataFrame:
    """Order lines whose product name matches ``pattern`` (one row per line)."""
    return sl.where(F.col("product_name").rlike(pattern)).select("product_name")


def customer_lines(sl: DataFrame, customer_name: str) -> DataFrame:
    return decimals_to_double(sl.where(F.col("customer_name") == customer_name))


def customer_month_lines(sl: DataFrame, customer_name: str, month: int) -> DataFrame:
    return decimals_to_double(sl.where((F.col("customer_name") == customer_name)
                                       & (month_of_year("order_date") == month)))
