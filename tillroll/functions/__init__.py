from tillroll.functions.columns import (  # noqa: F401
    MONEY,
    decimals_to_double,
    exact_avg,
    half_up_div,
    half_up_round,
    money,
    month_key,
    month_name,
    month_name_of,
    month_of_year,
    month_start,
    pct,
    year_month,
    year_month_label,
)
from tillroll.functions.stats import corr_from_moments, exact_long_sum, pair_moments, scaled  # noqa: F401
