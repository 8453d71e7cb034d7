"""Latency of a query over repeated runs: first, median, p95, max, min."""

from __future__ import annotations

import statistics
import time
from collections.abc import Callable


def p95(samples: list[float]) -> float:
    s = sorted(samples)
    return s[max(0, int(len(s) * 0.95) - 1)]


def measure(run: Callable[[], object], runs: int = 5, clock: Callable[[], float] = time.perf_counter) -> dict[str, float]:
    if runs < 1:
        raise ValueError("at least one run")
    took = []
    for _ in range(runs):
        t = clock()
        run()
        took.append((clock() - t) * 1000)
    return {"first_ms": took[0], "median_ms": statistics.median(took), "p95_ms": p95(took), "max_ms": max(took), "min_ms": min(took)}
