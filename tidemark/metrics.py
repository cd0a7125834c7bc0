"""Counters and gauges of tables, transactions and reconcilers."""

from __future__ import annotations

import threading
from collections import defaultdict


class NoMetrics:
    """The interface; records nothing."""

    def duration(self, what: str, key: str, seconds: float) -> None:
        pass

    def gauge(self, what: str, key: str, value: float) -> None:
        pass

    def count(self, what: str, key: str, n: int = 1) -> None:
        pass


class Metrics(NoMetrics):
    """Keeps the last durations and gauges and the sums of counts, by name and key.

    Keys are handle/table, handle/a+b with sorted names for transactions over several tables, and module/name/operation for reconcilers.
    """

    def __init__(self) -> None:
        self._lock = threading.Lock()
        self.durations: dict[tuple[str, str], float] = {}
        self.gauges: dict[tuple[str, str], float] = {}
        self.counts: dict[tuple[str, str], int] = defaultdict(int)

    def duration(self, what: str, key: str, seconds: float) -> None:
        with self._lock:
            self.durations[what, key] = seconds

    def gauge(self, what: str, key: str, value: float) -> None:
        with self._lock:
            self.gauges[what, key] = value

    def count(self, what: str, key: str, n: int = 1) -> None:
        with self._lock:
            self.counts[what, key] += n


def txn_key(handle: str, tables: list[str]) -> str:
    return f"{handle}/{'+'.join(sorted(tables))}"
