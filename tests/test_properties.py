"""Property tests for the custom primitives, on random data (hypothesis)."""

from decimal import ROUND_HALF_UP, Decimal

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tillroll.functions.columns import half_up_div
from tillroll.operators.quantile import grouped_quantiles, grouped_quantiles_by_histogram
from tillroll.operators.rank import nth_value, sorted_positions

SETTINGS = settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))


@SETTINGS
@given(st.lists(st.tuples(st.integers(-10**9, 10**9), st.integers(1, 10**6)), min_size=1, max_size=40))
def test_half_up_div_is_decimal_half_up(spark, pairs):
    df = spark.createDataFrame(pairs, "n long, d long")
    got = [r[0] for r in df.select(half_up_div("n", "d", 2).alias("q")).collect()]
    want = [(Decimal(n) / Decimal(d)).quantize(Decimal("0.01"), rounding=ROUND_HALF_UP) for n, d in pairs]
    # Decimal's default 28-digit context is exact enough for these sizes
    assert got == want


@SETTINGS
@given(st.lists(st.integers(-(2**40), 2**40) | st.integers(-3, 3), min_size=1, max_size=60))
def test_sorted_positions_are_row_numbers(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "v long")
    got = sorted((r["pos"], r["v"]) for r in sorted_positions(df, "v", "pos").collect())
    assert got == [(i + 1, v) for i, v in enumerate(sorted(values))]


@SETTINGS
@given(st.lists(st.tuples(st.sampled_from("abc"), st.integers(0, 9)), min_size=1, max_size=120),
       st.sampled_from([0.1, 0.25, 0.5, 0.9, 1.0]))
def test_quantiles_are_percentile_disc(spark, rows, p):
    import math
    df = spark.createDataFrame(rows, "g string, v int")
    want = {}
    for g in {g for g, _ in rows}:
        vals = sorted(v for gg, v in rows if gg == g)
        want[g] = vals[max(math.ceil(Decimal(str(p)) * len(vals)), 1) - 1]
    fast = {r["g"]: r["q"] for r in grouped_quantiles(df, ["g"], "v", {"q": p}).collect()}
    hist = {r["g"]: r["q"] for r in grouped_quantiles_by_histogram(df, ["g"], "v", {"q": p}).collect()}
    assert fast == want == hist


@SETTINGS
@given(st.lists(st.integers(-(2**33), 2**33) | st.integers(0, 30), min_size=1, max_size=80), st.integers(1, 90))
def test_nth_value_is_exact(spark, values, n):
    df = spark.createDataFrame([(v,) for v in values], "v long")
    got = [(r["v"], r["pos"]) for r in nth_value(df, "v", n, "pos").collect()]
    assert got == ([(sorted(values)[n - 1], n)] if n <= len(values) else [])
