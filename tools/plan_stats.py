"""Plan shape per key as it would be at large scale: auto-broadcast off, so
every join of two big inputs shows as a shuffle. Prints shuffles, sort-merge
joins, broadcasts, fact (lineitem) scans and whether a single-partition
exchange appears.

usage: python tools/plan_stats.py [sf_dir] [key ...]
"""

from __future__ import annotations

import os
import re
import sys

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, REPO)

from tillroll.plans.registry import QUERIES  # noqa: E402
from tillroll.session import get_session  # noqa: E402


def plan_text(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def main(argv):
    sf_dir = argv[1] if len(argv) > 1 and os.path.isdir(argv[1]) else "/root/testdata/sf0.01"
    keys = [a for a in argv[1:] if not os.path.isdir(a)] or list(QUERIES)
    threshold = os.environ.get("PLAN_BCAST", "10240")
    spark = get_session("local[8]", 8, extra_conf={"spark.sql.autoBroadcastJoinThreshold": threshold,
                                                   "spark.sql.adaptive.enabled": "false"})
    print(f"{'key':45s} shuffles smj bcast li_scans single")
    for k in keys:
        try:
            t = plan_text(QUERIES[k](spark, sf_dir))
        except Exception as e:  # noqa: BLE001
            print(f"{k:45s} ERROR {str(e)[:80]}")
            continue
        sh = len(re.findall(r"Exchange hashpartitioning|Exchange rangepartitioning|Exchange RoundRobin", t))
        single = "SinglePartition" in t
        smj = t.count("SortMergeJoin")
        bc = t.count("BroadcastExchange")
        li = len(re.findall(r"FileScan parquet \[l_", t))
        print(f"{k:45s} {sh:8d} {smj:3d} {bc:5d} {li:8d} {'YES' if single else ''}")
    spark.stop()


if __name__ == "__main__":
    main(sys.argv)
