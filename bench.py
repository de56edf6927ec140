"""Time the headline queries; print one JSON line.

Each query runs once to warm up and then five times. `queries` has the median seconds from the
statement to the rows. It is the sum of `plan_ms` (parsing, binding, footers, Catalyst) and
`action_ms` (running the plan); the 95th percentile is that of the whole. `scans` says what the
last run read: columns, files, rows out of the scan, and row groups kept of all.
"""

from __future__ import annotations

import json
import os
import time
from statistics import median

from quarry.benchmark import cases, percentile
from quarry.engine import Engine, scanned_rows
from quarry.session import session

RUNS = 5


def once(engine: Engine, sql: str) -> tuple[float, float, dict]:
    """Milliseconds of planning and of running, and what was read."""
    started = time.perf_counter()
    q = engine.bind(sql)
    frame = engine.frame(q)
    frame._jdf.queryExecution().executedPlan()
    planned = time.perf_counter()
    frame.collect()
    ended = time.perf_counter()
    kept = engine.kept(q, engine.catalog[q.table])
    scan = {"columns": len(q.columns), "files": len(kept.files), "rows_out": scanned_rows(frame), "bytes": kept.bytes, "row_groups_kept": kept.count, "row_groups": kept.total}
    return (planned - started) * 1000, (ended - planned) * 1000, scan


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = session(int(os.environ.get("BENCH_CPUS", "8")), **{"spark.driver.memory": "8g"})
    engine = Engine(spark, sf_dir)
    found: dict[str, dict] = {"queries": {}, "plan_ms": {}, "action_ms": {}, "p95_ms": {}, "scans": {}}
    for case in cases():
        name = case.id.lower().replace("-", "_")
        once(engine, case.sql)
        runs = [once(engine, case.sql) for _ in range(RUNS)]
        whole = [plan + action for plan, action, _ in runs]
        found["queries"][name] = round(median(whole) / 1000, 4)
        found["plan_ms"][name] = round(median(r[0] for r in runs), 1)
        found["action_ms"][name] = round(median(r[1] for r in runs), 1)
        found["p95_ms"][name] = round(percentile(whole, 0.95), 1)
        found["scans"][name] = runs[-1][2]
    total = round(sum(found["queries"].values()), 4)
    print(json.dumps({"metric": "headline_queries_total", "value": total, "unit": "sec", **found, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
