"""Hot-key stress check: a third of all order lines moved to one customer (and
one product).

Runs customer-keyed operators on the skewed lines and reads Spark's event log
(scratch folder, no UI) for the largest single task's share of each stage's
shuffle-read records. A share near 1/3 or more would mean the hot customer's
rows were processed by one task.

usage: python tools/skew_check.py [sf_dir] [--scale-thresholds] [--force-salt]
"""

from __future__ import annotations

import glob
import json
import os
import sys
import tempfile

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, REPO)

from pyspark.sql import functions as F  # noqa: E402

from tillroll.operators import aggregate as agg  # noqa: E402
from tillroll.operators import customer as cust  # noqa: E402
from tillroll.operators import join as jn  # noqa: E402
from tillroll.operators import quality  # noqa: E402
from tillroll.session import get_session  # noqa: E402
from tillroll.sources.binding import sales_line  # noqa: E402

HOT = 42


def main(argv):
    sf_dir = next((a for a in argv[1:] if not a.startswith("--")), "/root/testdata/sf0.1")
    log_dir = tempfile.mkdtemp(prefix="tillroll-skew-")
    conf = {"spark.eventLog.enabled": "true", "spark.eventLog.dir": log_dir, "spark.eventLog.compress": "false"}
    if "--scale-thresholds" in argv:
        # AQE only splits a skewed join partition above 256 MB by default; at 100 TB a
        # third of the lines is far above that, so lower it to what 600k lines reach
        conf.update({"spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "256k",
                     "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
                     "spark.sql.adaptive.advisoryPartitionSizeInBytes": "256k",
                     "spark.sql.autoBroadcastJoinThreshold": "-1"})
    spark = get_session("local[8]", 8, extra_conf=conf)
    lines = sales_line(spark, sf_dir, ["row_id", "customer_id", "customer_name", "order_date", "order_id",
                                       "quantity_ordered_new", "sales", "profit", "product_name",
                                       "line_number"])
    hot = F.col("order_id") % 3 == 0
    skewed = (lines.withColumn("customer_id", F.when(hot, F.lit(HOT)).otherwise(F.col("customer_id")))
              .withColumn("customer_name", F.when(hot, F.lit("HOT")).otherwise(F.col("customer_name")))
              .withColumn("sales", F.when(hot, F.lit("10.00").cast("decimal(18,2)")).otherwise(F.col("sales")))
              .withColumn("product_name", F.when(hot, F.lit("HOT PRODUCT")).otherwise(F.col("product_name"))))
    runs = {
        "retention_monthly": lambda: cust.retention_monthly(skewed),
        "customer_totals": lambda: agg.customer_totals(skewed),
        "customer_lifespan": lambda: cust.customer_lifespan(skewed),
        "customers_3plus_days_month": lambda: cust.customers_nplus_days_month(skewed),
        "deduplicate_by_customer": lambda: quality.deduplicate(skewed.select("customer_id", "row_id", "sales"),
                                                              ["customer_id"], ["row_id"]),
        "iqr_by_customer": lambda: quality.iqr_outliers(skewed.select("customer_id", "sales", "row_id"), "sales",
                                                        ["customer_id"], row_key=["row_id"]),
        "lines_below_product_avg": lambda: jn.lines_below_product_avg(skewed),
    }
    total_lines = lines.count()
    for name, make in runs.items():
        spark.sparkContext.setJobGroup(name, name)
        make().write.format("noop").mode("overwrite").save()
    spark.stop()
    stage_group, tasks = {}, {}
    for path in sorted(p for p in glob.glob(os.path.join(log_dir, "**", "*"), recursive=True) if os.path.isfile(p)):
        with open(path) as fh:
            for line in fh:
                ev = json.loads(line)
                if ev.get("Event") == "SparkListenerJobStart":
                    group = (ev.get("Properties") or {}).get("spark.jobGroup.id")
                    for sid in ev.get("Stage IDs", []):
                        stage_group[sid] = group
                elif ev.get("Event") == "SparkListenerTaskEnd":
                    m = ev.get("Task Metrics") or {}
                    recs = (m.get("Shuffle Read Metrics") or {}).get("Total Records Read", 0)
                    tasks.setdefault(ev["Stage ID"], []).append(recs)
    print(f"lines={total_lines}, hot customer holds a third of them")
    for name in runs:
        worst = 0.0
        for sid, recs in tasks.items():
            if stage_group.get(sid) == name and sum(recs) > 0:
                worst = max(worst, max(recs) / total_lines)
        print(f"{name:30s} largest task read {worst:7.2%} of all lines' worth of shuffled records")


if __name__ == "__main__":
    main(sys.argv)
