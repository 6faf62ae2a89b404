"""Per-stage wall times of one or more keys, from Spark's event log written to
a fresh scratch folder (no UI, no server).

usage: python tools/stage_times.py sf_dir key [key ...]
"""

from __future__ import annotations

import glob
import json
import os
import sys
import tempfile

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, REPO)

from tillroll.plans.registry import QUERIES  # noqa: E402
from tillroll.session import get_session  # noqa: E402


def main(argv):
    sf_dir, keys = argv[1], argv[2:]
    log_dir = tempfile.mkdtemp(prefix="tillroll-events-")
    spark = get_session("local[8]", 8, extra_conf={"spark.eventLog.enabled": "true",
                                                   "spark.eventLog.dir": log_dir,
                                                   "spark.eventLog.compress": "false"})
    for k in keys:                                   # warm-up outside the measured group
        QUERIES[k](spark, sf_dir).write.format("noop").mode("overwrite").save()
    for k in keys:
        spark.sparkContext.setJobGroup(k, k)
        QUERIES[k](spark, sf_dir).write.format("noop").mode("overwrite").save()
    spark.stop()
    stages, job_group = {}, {}
    for path in sorted(p for p in glob.glob(os.path.join(log_dir, "**", "*"), recursive=True) if os.path.isfile(p)):
        with open(path) as fh:
            for line in fh:
                ev = json.loads(line)
                kind = ev.get("Event")
                if kind == "SparkListenerJobStart":
                    group = (ev.get("Properties") or {}).get("spark.jobGroup.id")
                    for sid in ev.get("Stage IDs", []):
                        job_group[sid] = group
                elif kind == "SparkListenerStageCompleted":
                    info = ev["Stage Info"]
                    dur = (info.get("Completion Time", 0) - info.get("Submission Time", 0)) / 1000
                    stages[info["Stage ID"]] = (info["Stage Name"][:60], info["Number of Tasks"], dur)
    for k in keys:
        rows = sorted(((sid, *v) for sid, v in stages.items() if job_group.get(sid) == k), key=lambda r: -r[3])
        print(f"{k}: {len(rows)} stages, {sum(r[3] for r in rows):.2f}s stage time")
        for sid, name, ntasks, dur in rows[:6]:
            print(f"   stage {sid:4d} tasks={ntasks:3d} {dur:6.3f}s  {name}")


if __name__ == "__main__":
    main(sys.argv)
