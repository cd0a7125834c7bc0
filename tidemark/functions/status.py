"""Reconciliation status values, sets of them, and the durations and delays that go with them."""

from __future__ import annotations

import itertools
import json
import time
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import Column
from pyspark.sql import functions as F

KINDS = ("Pending", "Refreshing", "Done", "Error")
#: One-byte index keys of the kinds.
KIND_KEYS = {"Pending": b"P", "Refreshing": b"R", "Done": b"D", "Error": b"E"}
SCHEMA = "struct<kind: string, updated_at: double, error: string, id: bigint>"
_ids = itertools.count(1)


def kind_key(kind: str) -> bytes:
    return KIND_KEYS.get(kind, b"?")


def kind_key_column(kind: Column) -> Column:
    out = F.lit("?")
    for name, key in KIND_KEYS.items():
        out = F.when(kind == name, F.lit(key.decode())).otherwise(out)
    return out.cast("binary")


@dataclass(frozen=True)
class Status:
    kind: str = "Pending"
    updated_at: float = 0.0
    error: str = ""
    id: int = 0

    @property
    def waiting(self) -> bool:
        """Pending or refreshing."""
        return self.kind in ("Pending", "Refreshing")

    def __str__(self) -> str:
        age = pretty_since(self.updated_at)
        return f"Error: {self.error} ({age} ago)" if self.kind == "Error" else f"{self.kind} ({age} ago)"

    def to_json(self) -> str:
        out = {"kind": self.kind, "updated-at": self.updated_at, "id": self.id}
        return json.dumps(out | ({"error": self.error} if self.error else {}))

    @staticmethod
    def from_json(text: str) -> Status:
        got = json.loads(text)
        if got["kind"] not in KINDS:
            raise ValueError(f"unknown status kind {got['kind']!r}")
        return Status(got["kind"], float(got.get("updated-at", 0)), got.get("error", ""), int(got.get("id", 0)))

    def row(self) -> dict:
        return asdict(self)


def _now(kind: str, error: str = "", now: float | None = None) -> Status:
    return Status(kind, time.time() if now is None else now, error, next(_ids))


def pending(now: float | None = None) -> Status:
    return _now("Pending", now=now)


def refreshing(now: float | None = None) -> Status:
    return _now("Refreshing", now=now)


def done(now: float | None = None) -> Status:
    return _now("Done", now=now)


def error(message: str, now: float | None = None) -> Status:
    return _now("Error", message, now)


@dataclass(frozen=True)
class StatusSet:
    """Statuses by reconciler name; a name that isn't known is pending with the set's id."""

    id: int = field(default_factory=lambda: next(_ids))
    created_at: float = field(default_factory=time.time)
    by_name: tuple[tuple[str, Status], ...] = ()

    def pending(self) -> StatusSet:
        """All known names pending again, under a new id."""
        new = next(_ids)
        return StatusSet(new, time.time(), tuple((n, Status("Pending", time.time(), "", new)) for n, _ in self.by_name))

    def get(self, name: str) -> Status:
        return dict(self.by_name).get(name, Status("Pending", self.created_at, "", self.id))

    def set(self, name: str, status: Status) -> StatusSet:
        return replace(self, by_name=tuple(sorted((dict(self.by_name) | {name: status}).items())))

    def all(self) -> dict[str, Status]:
        return dict(self.by_name)

    def __str__(self) -> str:
        parts = []
        for kind, head in (("Error", "Errored"), ("Pending", "Pending"), ("Refreshing", "Refreshing"), ("Done", "Done")):
            if own := [f"{n} ({s.error})" if kind == "Error" else n for n, s in self.by_name if s.kind == kind]:
                parts.append(f"{head}: {' '.join(own)}")
        return ", ".join(parts) if parts else "Pending"

    def to_json(self) -> str:
        return json.dumps({n: json.loads(s.to_json()) for n, s in self.by_name})


def pretty_duration(seconds: float) -> str:
    """One decimal in the largest fitting unit of us, ms, s, m and h."""
    for unit, size, limit in (("us", 1e-6, 1e-3), ("ms", 1e-3, 1.0), ("s", 1.0, 60.0), ("m", 60.0, 3600.0)):
        if seconds < limit:
            return f"{seconds / size:.1f}{unit}"
    return f"{seconds / 3600:.1f}h"


def pretty_since(at: float, now: float | None = None) -> str:
    return pretty_duration((time.time() if now is None else now) - at)


def pretty_duration_column(seconds: Column) -> Column:
    show = lambda size, unit: F.format_string(f"%.1f{unit}", seconds / size)
    return F.when(seconds < 1e-3, show(1e-6, "us")).when(seconds < 1, show(1e-3, "ms")).when(seconds < 60, show(1.0, "s")).when(seconds < 3600, show(60.0, "m")).otherwise(show(3600.0, "h"))


def backoff(attempt: int, least: float = 0.1, most: float = 60.0) -> float:
    """least doubled for each attempt, no more than most."""
    return min(most, least * 2.0**attempt)


def backoff_column(attempt: Column, least: float = 0.1, most: float = 60.0) -> Column:
    return F.least(F.lit(most), F.lit(least) * F.pow(F.lit(2.0), attempt))
