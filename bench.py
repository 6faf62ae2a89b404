"""Benchmark the headline queries.

Runs each query on ``$BENCH_SF_DIR`` (default /root/testdata/sf0.1) with
``local[$BENCH_CPUS]`` (default 8): one warm-up run, then ``$BENCH_RUNS``
(default 3) timed runs; a run executes the full plan into Spark's ``noop``
sink (every row computed, nothing collected to the driver). Prints one JSON
line: the metric is the sum of the per-query medians.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import tempfile
import time

REPO = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, REPO)

from tillroll.plans.registry import QUERIES  # noqa: E402
from tillroll.session import get_session  # noqa: E402

HEADLINE = [
    # grouped aggregates and shares
    "region_sales_contribution", "customer_totals", "yearmonth_subcat_sales", "sales_month_subcat_rollup",
    "city_repeated_states", "manager_monthly_bonus",
    # ranking / top-k
    "top_ship_mode_by_state", "top2_products_per_category", "best_and_worst_cells", "products_in_n_regions",
    # joins against own aggregates, semi/anti joins
    "returned_order_details", "lines_above_month_region_subcat_avg", "customer_day_below_product_avg",
    "customers_3plus_days_month",
    # customer lifecycle
    "retention_monthly", "churn_monthly", "retained_flag_by_geo", "true_churn",
    # distributed positions and quantiles
    "sales_value_index", "median_profit", "shipping_effectiveness", "box_stats",
    # described analyses
    "correlation_matrix", "null_profile", "make_vs_buy", "rate_by_year",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    only = [q for q in os.environ.get("BENCH_QUERIES", "").split(",") if q]
    spark = get_session(f"local[{cpus}]", int(cpus),
                        extra_conf={"spark.local.dir": tempfile.mkdtemp(prefix="tillroll-bench-")})
    times, failed = {}, {}
    for key in only or HEADLINE:
        fn = QUERIES[key]
        try:
            fn(spark, sf_dir).write.format("noop").mode("overwrite").save()   # warm-up
            samples = []
            for _ in range(runs):
                t0 = time.perf_counter()
                fn(spark, sf_dir).write.format("noop").mode("overwrite").save()
                samples.append(time.perf_counter() - t0)
        except Exception as e:  # noqa: BLE001 - report the failure, keep benchmarking the rest
            failed[key] = str(e).splitlines()[0][:200]
            print(f"# {key}: FAILED {failed[key]}", file=sys.stderr)
            continue
        times[key] = round(statistics.median(samples), 4)
        print(f"# {key}: {times[key]:.3f}s", file=sys.stderr)
    sf_name = os.path.basename(os.path.normpath(sf_dir)).replace("sf", "")
    try:
        sf = float(sf_name)
    except ValueError:
        sf = sf_name
    out = {"metric": "sum_of_median_query_seconds", "value": round(sum(times.values()), 4),
           "unit": "sec", "queries": times, "sf": sf, "cpus": int(cpus), "runs": runs, "spark": spark.version}
    if failed:
        out["failed"] = failed
    print(json.dumps(out))
    spark.stop()


if __name__ == "__main__":
    main()
