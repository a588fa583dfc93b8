"""Wall time, CPU time and memory of steps on the driver."""

from __future__ import annotations

import resource
import time
from collections.abc import Iterator
from contextlib import contextmanager


class Tracker:
    """Sums up what is measured under each description until it is reset."""

    def __init__(self) -> None:
        self.rows: dict[str, dict[str, float]] = {}

    def save(self, description: str, **values: float) -> None:
        own = self.rows.setdefault(description, {})
        for k, v in values.items():
            own[k] = round(own.get(k, 0.0) + v, 4)

    def reset(self) -> None:
        self.rows.clear()

    @contextmanager
    def measure(self, description: str) -> Iterator[None]:
        wall, cpu, rss = time.time(), time.process_time(), _rss()
        try:
            yield
        finally:
            self.save(description, wall_s=time.time() - wall, cpu_s=time.process_time() - cpu, rss_gb=_rss(), rss_delta_gb=_rss() - rss)


def _rss() -> float:
    return resource.getrusage(resource.RUSAGE_SELF).ru_maxrss / 1e6
