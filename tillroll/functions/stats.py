"""Exact moment aggregates and the statistics built from them.

Correlation and z-scores are computed from exact integer moments (values
scaled to 64-bit integers, products exact in 64 bits, sums exact: 21-bit limbs
in primitive longs, recombined in DECIMAL(38,0)) in one partial+final
aggregate, and only the final formula runs in DOUBLE. The result therefore does not
depend on how rows are split into tasks, unlike a streaming (Welford) update
whose rounding follows the merge order. Valid while the scaled moments stay
below 1e38.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WIDE = "decimal(38,0)"


#: the largest whole number whose square fits in 64 bits
_LARGEST = 3_037_000_499


def scaled(c, scale: int = 2) -> Column:
    """Value times 10**scale as an exact 64-bit integer. A value whose products would not
    fit in 64 bits is an error, not a wrapped sum; ``wide`` moments take those."""
    col = F.col(c) if isinstance(c, str) else c
    # value * 10**scale is a whole number; its DOUBLE is within 1e-6 of it (for
    # |value| < 2**52 / 10**scale), so rint recovers it exactly -- e.g. 0.29 * 100
    # is 28.999999999999996 -- on primitives instead of BigDecimal rounding
    whole = F.rint(col.cast("double") * F.lit(float(10 ** scale)))
    fits = F.when(whole.isNull() | (F.abs(whole) <= _LARGEST), whole)
    return fits.otherwise(F.raise_error(F.lit("a value is too large for 64-bit moments; use wide=True"))).cast("long")


# A 64-bit value v is h * 2**42 + m * 2**21 + l with l, m in [0, 2**21) and
# |h| < 2**21 (arithmetic shift). Summing each limb as a primitive long cannot
# overflow below ~4e12 rows, and the three sums recombine exactly in DECIMAL.
_LIMB = 21
_MASK = (1 << _LIMB) - 1


def exact_long_sum(e: Column, name: str) -> list[Column]:
    """Aggregate columns ``{name}_l0/1/2`` whose recombination is the exact sum of ``e``."""
    return [F.sum(e.bitwiseAND(F.lit(_MASK))).alias(f"{name}_l0"),
            F.sum(F.shiftright(e, _LIMB).bitwiseAND(F.lit(_MASK))).alias(f"{name}_l1"),
            F.sum(F.shiftright(e, 2 * _LIMB)).alias(f"{name}_l2")]


def combine_long_sum(name: str) -> Column:
    """The exact DECIMAL(38,0) sum from ``exact_long_sum``'s partial columns."""
    l0, l1, l2 = (F.col(f"{name}_l{i}").cast(WIDE) for i in range(3))
    return l2 * F.lit(1 << (2 * _LIMB)) + l1 * F.lit(1 << _LIMB) + l0


def pair_moments(x, y, prefix: str, sx: int = 2, sy: int = 2, wide: bool = False) -> list[Column]:
    """n, Σx, Σy, Σx², Σy², Σxy over rows where both are not NULL.

    Values (|v| < 3e9) and their products are exact 64-bit integers, summed as
    three 21-bit limbs in primitive longs (fast, codegen'd) and recombined
    exactly by ``moments_from_limbs``. ``wide`` sums DECIMAL(38,0) values and
    products instead, for inputs that are themselves large totals.
    """
    both = (F.col(x).isNotNull() & F.col(y).isNotNull()) if isinstance(x, str) else (x.isNotNull() & y.isNotNull())
    def value(c, scale):
        if not wide:
            return scaled(c, scale)
        return ((F.col(c) if isinstance(c, str) else c).cast(f"decimal(28,{scale})") * F.lit(10 ** scale)).cast(WIDE)

    xv, yv = F.when(both, value(x, sx)), F.when(both, value(y, sy))
    terms = {"sx": xv, "sy": yv, "sxx": xv * xv, "syy": yv * yv, "sxy": xv * yv}
    out = [F.count(xv).cast(WIDE).alias(f"{prefix}_n")]
    for t, e in terms.items():
        out += [F.sum(e).alias(f"{prefix}_{t}")] if wide else exact_long_sum(e, f"{prefix}_{t}")
    return out


def moments_from_limbs(prefix: str, wide: bool = False) -> list[Column]:
    """Recombined moment columns for ``corr_from_moments`` (identity when ``wide``)."""
    names = ["sx", "sy", "sxx", "syy", "sxy"]
    cols = [F.col(f"{prefix}_n")]
    cols += [F.col(f"{prefix}_{t}") if wide else combine_long_sum(f"{prefix}_{t}").alias(f"{prefix}_{t}")
             for t in names]
    return cols


def corr_from_moments(prefix: str) -> Column:
    """Pearson correlation from ``pair_moments`` columns (NULL when undefined)."""
    n, sx, sy = F.col(f"{prefix}_n"), F.col(f"{prefix}_sx"), F.col(f"{prefix}_sy")
    sxx, syy, sxy = F.col(f"{prefix}_sxx"), F.col(f"{prefix}_syy"), F.col(f"{prefix}_sxy")
    num = (n * sxy - sx * sy).cast("double")
    vx = (n * sxx - sx * sx).cast("double")
    vy = (n * syy - sy * sy).cast("double")
    den = F.sqrt(vx * vy)
    return F.when((vx > 0) & (vy > 0), num / den)
