"""Single-node reference timing: the oracle SQL of the bench's headline keys on
DuckDB (in-process, no server) over the same Parquet files. One warm-up, then
the median of ``$BENCH_RUNS`` (default 3). Prints one JSON line like bench.py.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

import duckdb

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, REPO)

from bench import HEADLINE  # noqa: E402
from tillroll.plans.registry import ORACLE_SQL  # noqa: E402
from tillroll.sources.tables import DRIVER_TABLES  # noqa: E402


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    threads = int(os.environ.get("BENCH_CPUS", "8"))
    con = duckdb.connect()
    con.sql(f"SET threads = {threads}")
    for t in DRIVER_TABLES:
        p = os.path.join(sf_dir, f"{t}.parquet")
        if os.path.exists(p):
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    times = {}
    for key in HEADLINE:
        sql = ORACLE_SQL[key]
        con.sql(sql).fetchall()
        samples = []
        for _ in range(runs):
            t0 = time.perf_counter()
            con.sql(sql).fetchall()
            samples.append(time.perf_counter() - t0)
        times[key] = round(statistics.median(samples), 4)
    print(json.dumps({"metric": "duckdb_sum_of_median_query_seconds", "value": round(sum(times.values()), 4),
                      "unit": "sec", "queries": times, "threads": threads}))


if __name__ == "__main__":
    main()
