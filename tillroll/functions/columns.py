"""Column-level helpers shared by the operators.

Everything here returns a ``Column`` built from ``pyspark.sql.functions`` so it
stays inside whole-stage codegen; no Python runs per row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MONEY = T.DecimalType(18, 2)


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def money(c) -> Column:
    """Exact money value: DECIMAL(18,2) (the reference's decimal(7,2), widened)."""
    return col(c).cast(MONEY)


def month_of_year(d) -> Column:
    """MONTH(date): 1..12, merges years (as the reference's queries do)."""
    return F.month(col(d))


def year_month(d) -> Column:
    """'yyyy-MM' string key of a date."""
    return F.date_format(col(d), "yyyy-MM")


def month_start(d) -> Column:
    """First day of the date's month, as DATE."""
    return F.trunc(col(d), "MM")


def month_name(d) -> Column:
    """Full English month name ('January'), not Spark's 3-letter monthname()."""
    return F.date_format(col(d), "MMMM")


# Grouping keys: group on a cheap key (a date truncated to its month, an int)
# and format the few aggregated rows afterwards -- formatting text on every
# line before grouping is a per-row cost with the same result.

def month_key(d) -> Column:
    """First day of the month: the grouping key behind 'yyyy-MM' labels."""
    return F.trunc(col(d), "MM")


def year_month_label(month_start_col) -> Column:
    """'yyyy-MM' of an already aggregated month key."""
    return F.date_format(col(month_start_col), "yyyy-MM")


def month_name_of(month_number) -> Column:
    """Full month name of a month number 1..12 (formats one date per row it is applied to)."""
    return F.date_format(F.make_date(F.lit(2000), col(month_number), F.lit(1)), "MMMM")


def half_up_div(num, den, scale: int) -> Column:
    """Exact ``ROUND(num / den, scale)`` with half-up rounding; NULL when den = 0.

    Both operands are cast to a DECIMAL narrow enough that Spark keeps 18
    fractional digits in the quotient, so the final half-up
    rounding is decided on the exact rational (no double rounding, no binary
    floating point).
    """
    n = col(num).cast(T.DecimalType(20, 2))
    d = col(den).cast(T.DecimalType(20, 2))
    return F.round(F.try_divide(n, F.when(d != 0, d)), scale)


def pct(num, den) -> Column:
    """``num / den * 100`` as DOUBLE (IEEE, identical in any engine); NULL when den = 0."""
    n = col(num).cast("double")
    d = col(den).cast("double")
    return F.try_divide(n, F.when(d != 0, d)) * F.lit(100.0)


def half_up_round(c, scale: int) -> Column:
    """ROUND(x, scale) on an exact decimal (HALF_UP, like MySQL)."""
    return F.round(col(c), scale)


def exact_avg(c) -> Column:
    """AVG as an exact decimal quotient SUM/COUNT (kept wide for later rounding)."""
    s = F.sum(col(c)).cast(T.DecimalType(24, 2))
    n = F.count(col(c)).cast(T.DecimalType(24, 0))
    return F.try_divide(s, F.when(n != 0, n))


def decimals_to_double(df: DataFrame) -> DataFrame:
    """Cast every DECIMAL output column to DOUBLE (the output convention)."""
    exprs = []
    for field in df.schema.fields:
        if isinstance(field.dataType, T.DecimalType):
            exprs.append(F.col(field.name).cast("double").alias(field.name))
        else:
            exprs.append(F.col(field.name))
    return df.select(*exprs)
