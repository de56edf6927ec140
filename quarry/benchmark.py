"""The benchmark protocol: warm up, measure, and report what was read.

A query runs once unmeasured and then `repeat` times. The first measured run is
reported by itself; median and 95th percentile are over the others (over all, if
there is one). The clock covers the action on an analysed DataFrame.
"""

from __future__ import annotations

import math
import os
import platform
import resource
import time
from dataclasses import dataclass
from datetime import datetime, timezone
from statistics import median

from . import __version__
from .engine import Engine, Options

SCHEMA = "quarry-bench-v1"


@dataclass(frozen=True)
class Case:
    id: str
    showcase: str
    ordered: bool
    sql: str


@dataclass(frozen=True)
class Variant:
    name: str
    engine: str
    skip: bool
    prune: bool


VARIANTS = (Variant("row-naive", "row", False, False), Variant("row-opt", "row", True, True), Variant("vectorized", "vectorized", True, True))
_CASES = (
    ("Q1", "scan-prune", False, "q1_scan_agg"),
    ("Q2", "time-skip", False, "q2_time_window"),
    ("Q3", "filter", False, "q3_filter_agg"),
    ("Q4", "groupby-lowcard", True, "q4_low_card_group"),
    ("Q5", "groupby-highcard", True, "q5_high_card_group"),
    ("Q6", "resume", True, "q6_filter_group_topn"),
    ("Q7", "string-in", False, "q7_string_in"),
    ("Q8", "prune-narrow", True, "q8_narrow"),
    ("Q8-wide", "prune-wide", True, "q8_wide"),
)


def cases() -> list[Case]:
    from .queries import STATEMENTS

    return [Case(i, show, ordered, STATEMENTS[key][0]) for i, show, ordered, key in _CASES]


def percentile(values: list[float], share: float) -> float:
    """By nearest rank."""
    ordered = sorted(values)
    return ordered[max(0, math.ceil(share * len(ordered)) - 1)]


def summary(warmup: float, runs: list[float]) -> dict:
    hot = runs[1:] or runs
    return {"warmup_ms": warmup, "runs_ms": runs, "first_run_ms": runs[0], "hot_median_ms": median(hot), "hot_p95_ms": percentile(hot, 0.95)}


def measure(engine: Engine, case: Case, variant: Variant, repeat: int, jobs: int = 0) -> dict:
    options = Options(engine=variant.engine, skip=variant.skip, prune=variant.prune, jobs=jobs)
    q = engine.bind(case.sql)
    times = []
    for _ in range(repeat + 1):
        result = engine.run(q, options)
        times.append(result.profile["elapsed_ms"])
    p = result.profile
    return {
        "id": case.id,
        "showcase": case.showcase,
        "variant": variant.name,
        "engine": p["engine"],
        "no_skip": not variant.skip,
        "no_prune": not variant.prune,
        **summary(times[0], times[1:]),
        "rows_read": p["rows_read"],
        "rows_emitted": p["rows_emitted"],
        "bytes_read": p["bytes_read"],
        "row_groups_read": p["row_groups_read"],
        "row_groups_skipped": p["row_groups_skipped"],
        "columns_read": p["columns_read"],
        "jobs": jobs,
        "peak_rss_bytes": resource.getrusage(resource.RUSAGE_SELF).ru_maxrss * 1024,
    }


def report(engine: Engine, scale: str, repeat: int = 3, jobs: int = 0, only: set[str] | None = None) -> dict:
    results = [measure(engine, c, v, repeat, jobs) for c in cases() if not only or c.id in only for v in VARIANTS]
    hot = {(r["id"], r["variant"]): r["hot_median_ms"] for r in results}
    return {
        "schema": SCHEMA,
        "scale": scale,
        "data_dir": engine.catalog.path,
        "rows": engine.catalog["events"].rows if "events" in engine.catalog.tables else 0,
        "repeat": repeat,
        "jobs": jobs,
        "version": __version__,
        "generated_at": datetime.now(timezone.utc).isoformat(timespec="seconds"),
        "hardware": {"os": platform.system().lower(), "arch": platform.machine(), "cpus": os.cpu_count(), "host": platform.node()},
        "variants": [{"name": v.name, "engine": v.engine, "no_skip": not v.skip, "no_prune": not v.prune} for v in VARIANTS],
        "results": results,
        "speedups": [
            {"id": i, "naive_hot_median_ms": hot[i, "row-naive"], "vectorized_hot_median_ms": hot[i, "vectorized"], "speedup_x": round(hot[i, "row-naive"] / max(hot[i, "vectorized"], 1e-9), 3)}
            for i in dict.fromkeys(r["id"] for r in results)
        ],
    }


def timed(action) -> float:
    start = time.perf_counter()
    action()
    return time.perf_counter() - start
